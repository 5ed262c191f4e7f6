"""Two-stage evaluation: flow scores, session scores, triage, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.operators.evaluate import classification_report, confusion_matrix, attack_recall
from flowlens.operators.joins import session_join
from flowlens.operators.triage import batch_triage, trigger_rate
from flowlens.plans.training import FlowClassifier
from flowlens.schema import BENIGN, FILE_KEY, FLOW_KEY, SESSION_KEY


HELD_OUT_PCT = 15


def held_out_session(seed: int = 42) -> Column:
    """Is a flow's or window's session, in its capture, kept from every fit? Both stages use this split.

    A share of the sessions' MD5 digests, so that any engine can tell the sides apart.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *FILE_KEY, *SESSION_KEY).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < HELD_OUT_PCT


def score_sessions(model: PipelineModel, windows: DataFrame) -> DataFrame:
    """Window summaries with their attack probability ``t_score``."""
    return model.transform(windows).withColumn("t_score", vector_to_array("probability")[1]).select(
        *[c for c in FILE_KEY if c in windows.columns], *SESSION_KEY, "win", "label", "t_score"
    )


def triage_flows(
    classifier: FlowClassifier, sequence_model: PipelineModel, flows: DataFrame, windows: DataFrame,
    keep: Sequence[str] = (*FILE_KEY, *FLOW_KEY, "label"),
) -> DataFrame:
    """Verdict per flow; sessions are matched within their capture, flows without one fall back to stage 1."""
    scored = classifier.score(flows, list(keep)).select(*keep, "pred_label", "x_score")
    return batch_triage(session_join(scored, score_sessions(sequence_model, windows)))


def evaluation_report(triaged: DataFrame) -> DataFrame:
    """The whole report of a triaged flow table as rows: section, name, other, value.

    Sections: confusion (true and predicted class), report (class and metric), recall
    (label), triggers (flows, triggered, rate). ``triaged`` is stored by the caller.
    """
    binary = triaged.select((F.col("label") != BENIGN).cast("int").cast("string").alias("true"), F.col("pred").cast("string").alias("pred"))
    row = lambda section, name, other, value: F.struct(
        F.lit(section).alias("section"), name.alias("name"), other.alias("other"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    confusion = confusion_matrix(binary, "true", "pred").select(row("confusion", F.col("true_class"), F.col("pred_class"), F.col("n")).alias("r"))
    metrics = classification_report(binary, "true", "pred").select(F.explode(F.array(*[
        row("report", F.col("class"), F.lit(m), F.col(m)) for m in ("precision", "recall", "f1", "support")])).alias("r"))
    recall = attack_recall(triaged).select(row("recall", F.col("label"), none, F.col("recall")).alias("r"))
    triggers = trigger_rate(triaged).select(F.explode(F.array(*[
        row("triggers", F.lit(m), none, F.col(m)) for m in ("flows", "triggered", "trigger_rate")])).alias("r"))
    return confusion.unionByName(metrics).unionByName(recall).unionByName(triggers).select("r.*")
