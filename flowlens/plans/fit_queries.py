"""Registered queries: fitted models.

What a fit gives differs from engine to engine, so these queries report what must hold for any right fit:
which rows were fitted and scored, and whether losses, shares and scores are what the method promises.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from flowlens.functions.cleaning import numeric_columns
from flowlens.functions.features import engineer_features, feature_names
from flowlens.operators import boosting as B
from flowlens.operators import models as M
from flowlens.operators import scaling as SC
from flowlens.operators import sequences as S
from flowlens.operators.split import permutation_split
from flowlens.plans.hybrid import evaluation_report, held_out_session, score_sessions, triage_flows
from flowlens.plans.oracle import window_labels_sql, windows_sql
from flowlens.plans.registry import FILE_ORDER_KEY, ROW_KEY, Tables, query
from flowlens.plans.training import QUICK, FlowClassifier, train_flow_classifier
from flowlens.schema import FILE_KEY, FLOW_FEATURES, SESSION_KEY, WINDOW_SIZE, WINDOW_STRIDE
from flowlens.session import materialize, scratch_path
from flowlens.sources.datasets import write_by_day

IDS = [*FILE_KEY, "first_packet_id"]


def split_table(t: Tables):
    """The split flows, written once; every fit and score below reads them several times."""
    return materialize(t.split_rows, "split-flows")


def in_unit(score: str):
    return F.min(F.col(score).between(0, 1))


@query("scl_06_principal_components", """
    select label, count(*) as n, true as centred, true as ordered, true as standardised from flows group by label""")
def _(t):
    """Components of z-scores: means of zero, falling shares of at most one, and the variance their share says."""
    flows = materialize(t.flows, "flows")
    names = numeric_columns(flows)
    projected, shares = SC.principal_components(flows, names)
    projected = materialize(projected.select("label", *[F.col("components")[i].alias(f"pc{i + 1}") for i in (0, 1)]), "components")
    whole = projected.agg(*[f(f"pc{i}").alias(f"{f.__name__}{i}") for f in (F.avg, F.var_pop) for i in (1, 2)]).first()
    varying = sum(v > 0 for v in flows.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in names]).first())
    centred = all(abs(whole[f"avg{i}"]) < 1e-6 for i in (1, 2))
    standardised = all(abs(whole[f"var_pop{i + 1}"] / varying - shares[i]) < 1e-3 for i in (0, 1))
    ordered = 1 + 1e-9 >= shares[0] + shares[1] and shares[0] >= shares[1] >= 0
    return projected.groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumns({
        "centred": F.lit(centred), "ordered": F.lit(bool(ordered)), "standardised": F.lit(standardised)})


def weighted_loss(scored, score: str = "x_score"):
    """Of the binary fit's weighted rows: mean log-loss, and that of their weighted share of attacks alone."""
    weighed = M.with_positive_weight(scored, M.FLOW_POSITIVE_WEIGHT)
    p = F.least(F.greatest(F.col(score), F.lit(1e-15)), F.lit(1 - 1e-15))
    share = F.sum(F.col("w") * F.col("y")) / F.sum("w")
    entropy = -(share * F.log(share) + (1 - share) * F.log(1 - share))
    return weighed, (-F.sum(F.col("w") * F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))) / F.sum("w")), entropy


@query("ml_01_binary_classifier", """
    select split, count(*) as n, count(*) filter (where label <> 'Benign') as attacks, true as scores_in_range,
      case when split = 'train' then true end as below_share from split_rows group by split""")
def _(t):
    """Rows and attacks per side; on the fitted side the weighted loss is below that of the share of attacks."""
    rows = split_table(t)
    model = M.fit_binary(rows.filter("split = 'train'"), FLOW_FEATURES)
    weighed, loss, entropy = weighted_loss(M.score_binary(model, rows, FLOW_FEATURES))
    return weighed.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").cast("bigint").alias("attacks"), in_unit("x_score").alias("scores_in_range"),
        F.when(F.col("split") == "train", loss < entropy).alias("below_share"))


def flow_classifier(rows):
    return train_flow_classifier(rows.filter("split = 'train'"), IDS, settings=QUICK, file_key=FILE_ORDER_KEY())


@query("ml_02_multiclass_classifier", """
    select label, count(*) as n, true as scored, true as sums_to_one, true as named, true as no_worse_than_shares
    from split_rows where split = 'test' group by label""")
def _(t):
    """Test flows per label: each has one probability per class, which sum to one, and a label that was learned."""
    rows = split_table(t)
    classifier = flow_classifier(rows)
    scored = classifier.score(rows.filter("split = 'test'"), [*IDS, "label"])
    chosen = dict((r, held) for r, _, held in classifier.model.losses)
    total = F.aggregate("probs", F.lit(0.0), lambda a, x: a + x)
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), (F.min(F.size("probs")) == len(classifier.labels)).alias("scored"),
        (F.max(F.abs(total - 1)) < 1e-9).alias("sums_to_one"), F.min(F.col("pred_label").isin(*classifier.labels)).alias("named"),
        F.lit(bool(chosen[classifier.model.best_round] <= chosen[0])).alias("no_worse_than_shares"))


ROUND_PARTS = """
    select *, row_number() over (order by (first_packet_id * 7919 + 104729) % 1000003, first_packet_id)
      <= cast(floor(count(*) over () * 0.9e0) as bigint) as fits from split_rows where split = 'train'"""


@query("ml_02_boosting_rounds", """
    select count(*) filter (where fits) as fitted, count(*) filter (where not fits) as held_out,
      count(distinct label) filter (where fits) as classes, true as starts_at_shares, true as train_loss_falls, true as chosen_is_least,
      true as stopped_in_time
    from round_parts""", {"round_parts": ROUND_PARTS})
def _(t):
    """Rounds of the boosted classifier: from the loss of the classes' weighted shares, below it on the fitted side, to the least held-out loss."""
    rows = split_table(t).filter("split = 'train'").drop("split")
    parts = permutation_split(rows, ["first_packet_id"], key=ROW_KEY()).withColumn("held_out", F.col("split") == "eval")
    parts = materialize(engineer_features(parts, [*IDS, "label", "held_out"]), "rounds")
    settings = QUICK
    model = B.fit_boosted(parts, feature_names(), "held_out", IDS, settings)
    table = B.losses(t.spark, model)
    weights = M.class_weights(parts.filter("not held_out")).select("label", "weight")
    fitted = parts.filter("not held_out").join(weights, "label").groupBy("label").agg(F.sum("weight").alias("w"))
    entropy = fitted.agg((F.log(F.sum("w")) - F.sum(F.col("w") * F.log("w")) / F.sum("w")).alias("e")).scalar()
    first, last, least = (F.min_by("train_loss", "round"), F.max_by("train_loss", "round"), F.min("held_out_loss"))
    chosen = F.max(F.when(F.col("chosen"), F.col("held_out_loss")))
    counts = [parts.filter(c).agg(F.count(F.lit(1))).scalar() for c in ("not held_out", "held_out")]
    return table.agg(
        first.alias("first"), last.alias("last"), least.alias("least"), chosen.alias("best"), F.max("round").alias("rounds"),
        F.max(F.when(F.col("chosen"), F.col("round"))).alias("at")).select(
            counts[0].alias("fitted"), counts[1].alias("held_out"), F.lit(len(model.labels)).cast("bigint").alias("classes"),
            (F.abs(F.col("first") - entropy) < 1e-6).alias("starts_at_shares"),
            (F.col("last") < F.col("first")).alias("train_loss_falls"), (F.col("best") == F.col("least")).alias("chosen_is_least"),
            ((F.col("rounds") == settings.rounds) | (F.col("rounds") == F.col("at") + settings.patience)).alias("stopped_in_time"))


@query("ml_02_saved_classifier", "select true as equal, count(*) as flows from split_rows where split = 'test'")
def _(t):
    """Test flows whose label or score changes when the classifier is saved and loaded: none."""
    rows = split_table(t)
    classifier = flow_classifier(rows)
    path = scratch_path(t.spark, "classifier")
    classifier.save(path)
    scores = lambda c, n: c.score(rows.filter("split = 'test'"), [*IDS, "label"]).select(
        *IDS, F.struct("pred_label", F.round("x_score", 12).alias("x_score")).alias(n))
    both = scores(classifier, "before").join(scores(FlowClassifier.load(t.spark, path), "after"), IDS, "full")
    return both.groupBy(F.col("before").eqNullSafe(F.col("after")).alias("equal")).agg(F.count(F.lit(1)).alias("flows"))


@query("ml_06_early_stopping", """
    select case when fits then 'train' else 'eval' end as split, count(*) as n, true as stopped_in_time from round_parts group by 1""",
    {"round_parts": ROUND_PARTS})
def _(t):
    rows = split_table(t).filter("split = 'train'").drop("split")
    parts = permutation_split(rows, ["first_packet_id"], key=ROW_KEY()).withColumn("held_out", F.col("split") == "eval")
    parts = materialize(parts, "early-stop")
    model = M.fit_binary_early_stop(parts, FLOW_FEATURES, "held_out")
    losses = M.log_loss(M.score_binary(model, parts, FLOW_FEATURES), by=["split"])
    return losses.select("split", "n", F.lit(1 <= model.stages[-1].getNumTrees <= 100).alias("stopped_in_time"))


@query("ml_07_permutation_importance", f"""
    select feature, true as finite, (select count(*) from split_rows where split = 'test') as rows_scored
    from (values {", ".join(f"('{f}')" for f in FLOW_FEATURES)}) as t(feature)""")
def _(t):
    rows = split_table(t)
    model = M.fit_binary(rows.filter("split = 'train'"), FLOW_FEATURES)
    added = M.permutation_importance(model, rows.filter("split = 'test'"), FLOW_FEATURES, IDS)
    return added.select("feature", (F.abs("added_loss") < float("inf")).alias("finite"), F.col("n").alias("rows_scored"))


@query("top_05_feature_importance", "select unnest(range(1, 16))::int as place, true as ordered, true as share")
def _(t):
    """Places of the features with most gain: gains fall, are shares of one, and belong to known features."""
    rows = split_table(t)
    classifier = flow_classifier(rows)
    top = B.top_importances(t.spark, classifier.model)
    order = Window.orderBy(F.desc("importance"), "feature")
    placed = top.withColumn("place", F.row_number().over(order)).withColumn("before", F.lag("importance").over(order))
    return placed.select(
        "place", (F.col("importance") <= F.coalesce("before", F.lit(1.0))).alias("ordered"),
        (F.col("importance").between(0, 1) & F.col("feature").isin(*feature_names())).alias("share"))


def sequence_model(t: Tables):
    """Stage 2, fitted on the windows of sessions that are not held out; and all windows with ``held_out``."""
    windows, names = M.window_summary(t.clean, per_file=True, label_domain=t.domain)
    windows = materialize(windows.withColumn("held_out", held_out_session()), "windows")
    return M.fit_sequence_model(windows.filter("not held_out"), names), windows


HELD_OUT = (
    "('0x' || substr(md5(concat_ws('|', '42', capture_day, capture_file, ip_src, ip_dst)), 1, 8))::bigint % 100 < 15")
SESSION_WINDOWS = {
    "wide_window_rows": windows_sql("capture_day, capture_file, ip_src, ip_dst", WINDOW_SIZE, WINDOW_STRIDE),
    "wide_window_labels": window_labels_sql("capture_day, capture_file, ip_src, ip_dst", "wide_window_rows"),
}


@query("ml_08_sequence_score", f"""
    select label, count(*) as n, true as scores_in_range, true as below_share from wide_window_labels where {HELD_OUT} group by label""",
    SESSION_WINDOWS)
def _(t):
    """Held-out windows per label; on the fitted side the weighted loss is below that of the share of attacks."""
    model, windows = sequence_model(t)
    fitted = score_sessions(model, windows.filter("not held_out"))
    weighed = M.with_positive_weight(fitted, M.SEQUENCE_POSITIVE_WEIGHT)
    y, p = F.col("y"), F.least(F.greatest(F.col("t_score"), F.lit(1e-15)), F.lit(1 - 1e-15))
    share = F.sum(F.col("w") * y) / F.sum("w")
    below = weighed.agg((
        -F.sum(F.col("w") * F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))) / F.sum("w")
        < -(share * F.log(share) + (1 - share) * F.log(1 - share))).alias("below")).scalar()
    return score_sessions(model, windows.filter("held_out")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), in_unit("t_score").alias("scores_in_range")).withColumn("below_share", below)


@query("ml_09_vector_scoring", f"""
    select label, count(*) as n, true as scores_agree from wide_window_labels where {HELD_OUT} group by label""", SESSION_WINDOWS)
def _(t):
    """Stored vectors of held-out windows scored by the fitted session model: the scores their packets' summaries get."""
    model, windows = sequence_model(t)
    vectors = S.window_vectors(t.clean, per_file=True).filter(held_out_session())
    scored = score_sessions(model, M.vector_summary(vectors)).withColumnRenamed("t_score", "from_vector")
    direct = score_sessions(model, windows.filter("held_out")).drop("label")
    both = scored.join(direct, [*FILE_KEY, *SESSION_KEY, "win"], "left")
    return both.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.coalesce(F.abs(F.col("from_vector") - F.col("t_score")) < 1e-3, F.lit(False))).alias("scores_agree"))


@query("ml_10_continual_training", """
    with d as (select capture_day, lead(capture_day) over (order by capture_day) as after, count(*) filter (where split = 'train') as own,
        count(*) filter (where split = 'train' and (first_packet_id * 7919 + 104729) % 1000003 % 1000 < 50) as kept, count(*) as n
      from split_rows group by 1)
    select capture_day as trained_through, after as tested_on, lead(n) over (order by capture_day) as n, true as in_range,
      cast(own + coalesce(sum(kept) over (order by capture_day rows between unbounded preceding and 1 preceding), 0) as bigint) as rows_fitted
    from d qualify after is not null""")
def _(t):
    """Each day's model on the next day's flows, and how many rows it was fitted on."""
    path = scratch_path(t.spark, "days")
    write_by_day(t.split_rows, path)
    rows = t.spark.read.parquet(path)
    days = [r[0] for r in rows.select("capture_day").distinct().orderBy("capture_day").collect()]
    models = M.continual_training(rows.filter("split = 'train'"), FLOW_FEATURES, days, IDS, key=ROW_KEY())
    steps = [
        M.log_loss(M.score_binary(model, rows.filter(F.col("capture_day") == after), FLOW_FEATURES)).select(
            F.lit(day).alias("trained_through"), F.lit(after).alias("tested_on"), "n", F.col("accuracy").between(0, 1).alias("in_range"),
            F.lit(fitted).cast("bigint").alias("rows_fitted"))
        for (day, model, fitted), after in zip(models, days[1:])
    ]
    return reduce(DataFrame.unionByName, steps)


@query("run_02_hybrid_evaluation", f"""
    with h as (select *, label <> 'Benign' as attack from file_flows where {HELD_OUT})
    select 'confusion' as section, cast(null as varchar) as name, count(*)::double as value from h
    union all select 'report', cast(attack::int as varchar), count(*)::double from h group by 2
    union all select 'recall', label, 1.0::double from h group by 2
    union all select 'triggers', 'flows', count(*)::double from h""")
def _(t):
    """Both stages fitted on one side of the sessions, triaged and reported on the other.

    Of the report, the counts: all of the confusion matrix, the support of each class, labels with a recall, flows.
    """
    rows = materialize(t.file_flows.withColumn("held_out", held_out_session()), "flows")
    classifier = train_flow_classifier(rows.filter("not held_out"), IDS, settings=QUICK, file_key=FILE_ORDER_KEY())
    model, windows = sequence_model(t)
    test, seen = rows.filter("held_out"), windows.filter("held_out")
    triaged = materialize(triage_flows(classifier, model, test, seen), "triaged")
    report = materialize(evaluation_report(triaged.select("label", "pred", "triggered")), "report")
    support = report.filter("section = 'report' and other = 'support' and name in ('0', '1') and value > 0")
    parts = [
        report.filter("section = 'confusion'").groupBy("section", F.lit(None).cast("string").alias("name")).agg(F.sum("value").alias("value")),
        support.select("section", "name", "value"),
        report.filter("section = 'recall'").select("section", "name", F.when(F.col("value").between(0, 1), 1.0).alias("value")),
        report.filter("section = 'triggers' and name = 'flows'").select("section", "name", "value"),
    ]
    return reduce(DataFrame.unionByName, parts)
