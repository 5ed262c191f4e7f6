"""Two-stage verdicts from a flow score ``x`` and a sequence score ``t``."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

# Verdict texts and thresholds of the two rules.
ATTACK_LOUD = "ATTACK (Loud)"
ATTACK_STEALTH = "ATTACK (Stealth - Transformer Verified)"
BENIGN_VERIFIED = "BENIGN (Transformer Verified)"
ATTACK_FLOW = "ATTACK (XGBoost)"
BENIGN_FLOW = "BENIGN (XGBoost)"
LOUD = 0.9
UNSURE_LOW, UNSURE_HIGH = 0.4, 0.6
STEALTH_RATE = 5.0
STEALTH_LENGTH = 100.0
WEIGHT_T, WEIGHT_X = 0.7, 0.3
TRIGGER = 0.1
VETO = 0.15
GAIN = 2.5
CONSENSUS = 0.45


def attack_score(probability: Column, labels: list[str], benign: str = "Benign") -> Column:
    """1 - P(Benign) from a model's probability vector; Benign is found by name."""
    return 1 - vector_to_array(probability)[labels.index(benign)]


def row_cascade(df: DataFrame, x: str = "x_score", t: str = "t_score") -> DataFrame:
    """Per-flow cascade: loud, then stealth or unsure with a sequence, then the flow score.

    Needs packet_rate and frame_len_mean. Adds ``verdict`` and ``final_score``.
    """
    xs, ts = F.col(x), F.col(t)
    unsure = (xs > UNSURE_LOW) & (xs < UNSURE_HIGH)
    stealthy = (F.col("packet_rate") < STEALTH_RATE) | (F.col("frame_len_mean") < STEALTH_LENGTH)
    verify = (xs <= LOUD) & (unsure | stealthy) & ts.isNotNull()
    blended = ts * WEIGHT_T + xs * WEIGHT_X
    return df.withColumn("final_score", F.when(verify, blended).otherwise(xs)).withColumn(
        "verdict",
        F.when(xs > LOUD, ATTACK_LOUD)
        .when(verify & (blended > 0.5), ATTACK_STEALTH)
        .when(verify, BENIGN_VERIFIED)
        .when(xs > 0.5, ATTACK_FLOW)
        .otherwise(BENIGN_FLOW),
    )


def batch_triage(
    df: DataFrame, x: str = "x_score", t: str = "t_score",
    trigger: float = TRIGGER, veto: float = VETO, consensus: float = CONSENSUS,
) -> DataFrame:
    """Wide-net triage: every score above ``trigger`` is checked against its sequence.

    Adds ``triggered``, ``outcome`` and ``pred``. Without a sequence score the
    flow score alone decides.
    """
    xs, ts = F.col(x), F.col(t)
    calibrated = F.least(F.greatest(ts * GAIN, F.lit(0.0)), F.lit(1.0))
    combined = calibrated * WEIGHT_T + xs * WEIGHT_X
    outcome = (
        F.when(ts.isNull(), "flow_only")
        .when(xs <= trigger, "cleared")
        .when(ts < veto, "vetoed")
        .when(combined > consensus, "verified")
        .otherwise("below_consensus")
    )
    return (
        df.withColumn("triggered", (ts.isNotNull() & (xs > trigger)).cast("int"))
        .withColumn("outcome", outcome)
        .withColumn(
            "pred",
            F.when(F.col("outcome") == "verified", 1)
            .when(F.col("outcome") == "flow_only", (xs > 0.5).cast("int"))
            .otherwise(0),
        )
    )


def trigger_rate(triaged: DataFrame) -> DataFrame:
    return triaged.agg(
        F.count(F.lit(1)).alias("flows"), F.sum("triggered").alias("triggered"),
        F.avg("triggered").alias("trigger_rate"),
    )


def triage_share(triaged: DataFrame) -> DataFrame:
    """Rows and percentage per outcome; the total is summed over the counts, one row per outcome."""
    return triaged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())
    )


def confidence_filter(
    df: DataFrame, probs: Column, pred: str = "pred_label", threshold: float = 0.9, benign: str = "Benign"
) -> DataFrame:
    """Predictions whose highest class probability is below ``threshold`` become Benign."""
    return df.withColumn(pred, F.when(F.array_max(probs) < threshold, benign).otherwise(F.col(pred)))
