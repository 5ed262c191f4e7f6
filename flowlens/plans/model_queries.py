"""Registered queries: features, scaling, model tables, triage and evaluation."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flowlens.functions.features import engineer_features
from flowlens.operators import evaluate as E
from flowlens.operators import models as M
from flowlens.operators import scaling as SC
from flowlens.operators import sequences as S
from flowlens.operators import triage as TR
from flowlens.plans.oracle import FLOW_KEY as KEY_SQL
from flowlens.plans.registry import Tables, query, r6
from flowlens.session import materialize
from flowlens.schema import FLOW_FEATURES, FLOW_KEY, LABELS, SERVICE_PORTS

# ---- features ----------------------------------------------------------------

NONZERO_DURATION = "case when flow_duration_sec = 0 then 0.001e0 else flow_duration_sec end"
NONZERO_MEAN = "case when frame_len_mean = 0 then 0.001e0 else frame_len_mean end"
FEATURE_SQL = {
    "fe_01_base": {
        "packet_count": "frame_len_count", "total_bytes": "frame_len_sum", "avg_packet_size": "frame_len_mean",
        "packet_size_std": "coalesce(frame_len_std, 0)", "ttl_mean": "ip_ttl_mean", "window_size_mean": "tcp_window_mean",
        "flow_duration": "flow_duration_sec", "packet_rate": "packet_rate",
    },
    "fe_02_logs": {
        "log_packet_count": "ln(1 + frame_len_count)", "log_total_bytes": "ln(1 + frame_len_sum)",
        "log_packet_rate": "ln(1 + packet_rate)", "log_duration": "ln(1 + flow_duration_sec)",
    },
    "fe_03_rates": {
        "bytes_per_sec": f"frame_len_sum / {NONZERO_DURATION}",
        "log_bytes_per_sec": f"ln(1 + least(frame_len_sum / {NONZERO_DURATION}, 1e9))",
        "packet_size_cv": f"least(coalesce(frame_len_std, 0) / {NONZERO_MEAN}, 100)",
    },
    "fe_04_size_flags": {
        "is_single_packet": "(frame_len_count = 1)::int", "is_micro_flow": "(frame_len_count <= 5)::int",
        "is_large_flow": "(frame_len_count > 100)::int", "is_small_payload": "(frame_len_mean < 100)::int",
    },
    "fe_05_protocols": {
        "proto_tcp": "(ip_proto = 6)::int", "proto_udp": "(ip_proto = 17)::int", "proto_icmp": "(ip_proto = 1)::int",
        "proto_other": "(ip_proto not in (6, 17, 1))::int",
    },
    "fe_06_services": {
        f"dst_is_{s}": f"(tcp_dstport in ({', '.join(map(str, ports))}))::int" for s, ports in SERVICE_PORTS.items()
    },
    "fe_07_ports": {
        "src_ephemeral": "(tcp_srcport > 1024)::int", "dst_ephemeral": "(tcp_dstport > 1024)::int",
        "both_ephemeral": "(tcp_srcport > 1024 and tcp_dstport > 1024)::int",
        "dstport_value": "least(tcp_dstport, 65535)", "srcport_value": "least(tcp_srcport, 65535)",
    },
    "fe_08_signatures": {
        "low_ttl": "(ip_ttl_mean < 32)::int", "unusual_ttl": "(round_even(ip_ttl_mean, 0) not in (32, 64, 128, 255))::int",
        "zero_window": "(tcp_window_mean = 0)::int", "large_window": "(tcp_window_mean > 60000)::int",
    },
    "fe_09_interactions": {
        "bytes_x_packets": "ln(1 + frame_len_sum * frame_len_count)", "rate_x_size": "packet_rate * frame_len_mean / 1e6",
    },
}


def _feature_sql(parts, table="flows"):
    picks = ", ".join(f"round(cast({e} as double), 6) as {n}" for n, e in parts.items())
    return f"select {KEY_SQL}, label, {picks} from {table}"


def _register_features():
    groups = dict(FEATURE_SQL)
    groups["fe_00_all_features"] = {n: e for parts in FEATURE_SQL.values() for n, e in parts.items()}
    for name, parts in groups.items():
        @query(name, _feature_sql(parts))
        def _(t, names=tuple(parts)):
            return r6(engineer_features(t.flows, [*FLOW_KEY, "label"]).select(*FLOW_KEY, "label", *names))


_register_features()


@query("fe_10_finite", _feature_sql({
    "packet_rate": "case when isinf(packet_rate) then 0 else packet_rate end",
    "log_packet_rate": "case when isinf(packet_rate) then 0 else ln(1 + packet_rate) end",
    "rate_x_size": "case when isinf(packet_rate) then 0 else packet_rate * frame_len_mean / 1e6 end",
    "ttl_mean": "coalesce(ip_ttl_mean, 0)",
    "low_ttl": "(coalesce(ip_ttl_mean, 0) < 32)::int",
    "unusual_ttl": "(round_even(coalesce(ip_ttl_mean, 0), 0) not in (32, 64, 128, 255))::int",
}, """(select * replace (case when frame_len_count = 1 then 'inf'::double else packet_rate end as packet_rate,
          case when frame_len_count = 2 then null else ip_ttl_mean end as ip_ttl_mean) from flows)"""))
def _(t):
    """Infinite rates and absent TTLs end as zeros."""
    odd = t.flows.withColumns({
        "packet_rate": F.when(F.col("frame_len_count") == 1, float("inf")).otherwise(F.col("packet_rate")),
        "ip_ttl_mean": F.when(F.col("frame_len_count") != 2, F.col("ip_ttl_mean")),
    })
    names = ["packet_rate", "log_packet_rate", "rate_x_size", "ttl_mean", "low_ttl", "unusual_ttl"]
    return r6(engineer_features(odd, [*FLOW_KEY, "label"]).select(*FLOW_KEY, "label", *names))


# ---- scaling -----------------------------------------------------------------

SCALER = {
    "scaler": " union all ".join(
        f"select '{c}' as feature, avg({c}) as mean, stddev_pop({c}) as std from split_rows where split = 'train'" for c in FLOW_FEATURES)
}


def _scaled(table):
    picks = ", ".join(
        f"({c} - (select mean from scaler where feature = '{c}')) / "
        f"(select case when std = 0 then 1 else std end from scaler where feature = '{c}') as {c}" for c in FLOW_FEATURES)
    return f"select capture_day, capture_file, first_packet_id, {picks} from {table}"


def train_scaler(t: Tables):
    """Fitted on the train side only, so held-out rows do not leak into it."""
    return SC.fit_flow_scaler(t.split_rows.filter("split = 'train'"), FLOW_FEATURES)


@query("scl_01_flow_scaler", "select feature, round(mean, 5) as mean, round(std, 5) as std from scaler", SCALER)
def _(t):
    return r6(train_scaler(t), digits=5)


SEQ_SCALER = {
    "seq_scaler": """
    select feature_idx, sum(v) / (200.0e0 * (select count(*) from window_labels)) as mean,
      sqrt(sum(v * v) / (200.0e0 * (select count(*) from window_labels)) - power(sum(v) / (200.0e0 * (select count(*) from window_labels)), 2)) as std
    from window_steps group by 1"""
}


@query("scl_02_sequence_scaler", "select feature_idx, round(mean, 5) as mean, round(std, 5) as std from seq_scaler", SEQ_SCALER)
def _(t):
    return r6(SC.fit_sequence_scaler(S.window_vectors(t.clean)), digits=5)


@query("scl_03_scaled_flows", "select capture_day, capture_file, first_packet_id, " + ", ".join(
    f"round({c}, 6) + 0.0e0 as {c}" for c in FLOW_FEATURES) + " from z", SCALER | {"z": _scaled("file_flows")})
def _(t):
    scaled = SC.apply_flow_scaler(t.file_flows, train_scaler(t), FLOW_FEATURES)
    return scaled.select("capture_day", "capture_file", "first_packet_id", *[(F.round(c, 6) + 0.0).alias(c) for c in FLOW_FEATURES])


@query("scl_04_scaled_sequences", """
    select ip_src, ip_dst, win, round(sum(cast(cast((v - mean) / case when std = 0 then 1 else std end as float) as double))
      + (200 * 9 - count(*)) / 9 * (select sum(cast(cast(-mean / case when std = 0 then 1 else std end as float) as double))
          from seq_scaler), 2) + 0.0e0 as scaled_sum
    from window_steps join seq_scaler using (feature_idx) group by 1, 2, 3""", SEQ_SCALER)
def _(t):
    """Sum of every scaled vector, of 32-bit values; padding steps count with the value of a scaled zero."""
    vectors = materialize(S.window_vectors(t.clean), "vectors")  # read by the fit and by the scaling
    scaled = SC.apply_sequence_scaler(vectors, SC.fit_sequence_scaler(vectors))
    total = F.aggregate("sequence_features", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return scaled.select("ip_src", "ip_dst", "win", (F.round(total, 2) + 0.0).alias("scaled_sum"))


@query("scl_05_scaled_ranges", " union all ".join(
    f"select '{c}' as feature, round(avg({c}), 6) + 0.0e0 as mean, round(stddev_pop({c}), 6) as std from z" for c in FLOW_FEATURES),
    SCALER | {"z": _scaled("(select * from split_rows where split = 'test')")})
def _(t):
    ranges = SC.scaled_ranges(t.split_rows.filter("split = 'test'"), train_scaler(t), FLOW_FEATURES)
    return ranges.select("feature", (F.round("mean", 6) + 0.0).alias("mean"), F.round("std", 6).alias("std"))


# ---- model tables ------------------------------------------------------------

CLASS_SQL = {
    "classes": """
    select label, count(*) as n, row_number() over (order by label) - 1 as label_idx,
      case when label = 'Benign' then 1.0e0 else least(sqrt(max(count(*)) over () / count(*)) * 1.5e0, 10.0e0) end as weight
    from split_rows where split = 'train' group by 1"""
}


@query("ml_03_class_weights", "select label, n, round(weight, 6) as weight from classes", CLASS_SQL)
def _(t):
    return r6(M.class_weights(t.split_rows.filter("split = 'train'"))).select("label", "n", "weight")


@query("ml_04_label_encoding", "select label, cast(label_idx as int) as label_idx from classes", CLASS_SQL)
def _(t):
    return M.label_encoding(t.split_rows.filter("split = 'train'"))


@query("ml_05_known_labels", """
    select capture_day, capture_file, first_packet_id, s.label, cast(label_idx as int) as label_idx from split_rows s join (
      select label, row_number() over (order by label) - 1 as label_idx from split_rows where split = 'train' and capture_day < 'D03' group by 1) c
    using (label) where split = 'test'""")
def _(t):
    """Test rows whose label the first three days already had."""
    encoder = M.label_encoding(t.split_rows.filter("split = 'train' and capture_day < 'D03'"))
    known = M.encode_known(t.split_rows.filter("split = 'test'"), encoder)
    return known.select("capture_day", "capture_file", "first_packet_id", "label", "label_idx")


# ---- triage ------------------------------------------------------------------

PICK = [*FLOW_KEY, "x_score", "t_score"]


@query("tri_01_attack_score", f"select {KEY_SQL}, round(x_score, 9) as attack_score from scored")
def _(t):
    x = F.col("x_score")
    probability = array_to_vector(F.array(x * 0.25, 1 - x, x * 0.75))
    scored = t.scored.withColumn("probability", probability)
    score = TR.attack_score(F.col("probability"), ["Alpha", "Benign", "Gamma"])
    return scored.select(*FLOW_KEY, F.round(score, 9).alias("attack_score"))


VERIFY = "x_score <= 0.9e0 and ((x_score > 0.4e0 and x_score < 0.6e0) or packet_rate < 5 or frame_len_mean < 100) and t_score is not null"
BLEND = "t_score * 0.7e0 + x_score * 0.3e0"


@query("tri_02_row_cascade", f"""
    select {KEY_SQL}, round(case when {VERIFY} then {BLEND} else x_score end, 6) as final_score,
      case when x_score > 0.9e0 then 'ATTACK (Loud)' when {VERIFY} and {BLEND} > 0.5e0 then 'ATTACK (Stealth - Transformer Verified)'
        when {VERIFY} then 'BENIGN (Transformer Verified)' when x_score > 0.5e0 then 'ATTACK (XGBoost)' else 'BENIGN (XGBoost)' end as verdict
    from scored""")
def _(t):
    return r6(TR.row_cascade(t.scored).select(*FLOW_KEY, "final_score", "verdict"))


@query("tri_03_batch_triage", f"select {KEY_SQL}, triggered, outcome, pred from triaged")
def _(t):
    return t.triaged.select(*FLOW_KEY, "triggered", "outcome", "pred")


@query("tri_04_trigger_rate", """
    select count(*) as flows, cast(sum(triggered) as bigint) as triggered, round(avg(triggered), 9) as trigger_rate from triaged""")
def _(t):
    return r6(TR.trigger_rate(t.triaged), digits=9)


@query("tri_05_triage_share", """
    select outcome, count(*) as n, round(count(*) * 100.0e0 / (select count(*) from triaged), 6) as share_pct from triaged group by 1""")
def _(t):
    return r6(TR.triage_share(t.triaged))


@query("tri_06_confidence_filter", """
    select label, case when greatest(x_score, 1 - x_score) < 0.9e0 then 'Benign' when x_score > 0.5 then 'Attack' else 'Benign' end as pred_label,
      count(*) as n from scored group by 1, 2""")
def _(t):
    x = F.col("x_score")
    guessed = t.scored.withColumn("pred_label", F.when(x > 0.5, "Attack").otherwise("Benign"))
    sure = TR.confidence_filter(guessed, F.array(x, 1 - x))
    return sure.groupBy("label", "pred_label").agg(F.count(F.lit(1)).alias("n"))


# ---- evaluation --------------------------------------------------------------

LABEL_LIST = ", ".join(f"'{x}'" for x in LABELS)
GUESSED = {
    "guessed": f"""
    select *, case when pred = 0 then 'Benign' when frame_len_sum % 3 = 0 then label
      else list_extract([{LABEL_LIST}], cast((frame_len_sum * 7 + frame_len_count) % 9 + 1 as int)) end as pred_label from file_triaged""",
    "cells": "select label as t, pred_label as p, count(*) as n from guessed group by 1, 2",
    "per_class": """
    select class, support, predicted, hits, case when predicted > 0 then hits / predicted else 0 end as precision,
      case when support > 0 then hits / support else 0 end as recall
    from (select class, sum(support) as support, sum(predicted) as predicted, sum(hits) as hits from (
      select t as class, n as support, 0 as predicted, case when t = p then n else 0 end as hits from cells
      union all select p, 0, n, 0 from cells) group by 1)""",
    "report": """
    select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from per_class""",
}


def guessed(t: Tables):
    """Multi-class predictions: triage decides benign or not, arithmetic picks the class."""
    table = F.array(*[F.lit(x) for x in LABELS])
    pick = F.element_at(table, ((F.col("frame_len_sum") * 7 + F.col("frame_len_count")) % 9 + 1).cast("int"))
    return t.file_triaged.withColumn(
        "pred_label",
        F.when(F.col("pred") == 0, "Benign").when(F.col("frame_len_sum") % 3 == 0, F.col("label")).otherwise(pick),
    )


@query("evl_01_confusion_binary", """
    select t.c as true_class, p.c as pred_class, (select count(*) from triaged where (label <> 'Benign')::int = t.c and pred = p.c) as n
    from (values (0), (1)) as t(c), (values (0), (1)) as p(c)""")
def _(t):
    rows = t.triaged.withColumn("truth", (F.col("label") != "Benign").cast("int"))
    return E.confusion_matrix(rows, "truth", "pred")


@query("evl_01_confusion_labels", """
    select t.c as true_class, p.c as pred_class, coalesce(n, 0) as n
    from (select t as c from cells union select p from cells) t cross join (select t as c from cells union select p from cells) p
    left join cells on cells.t = t.c and cells.p = p.c""", GUESSED)
def _(t):
    return E.confusion_matrix(guessed(t), "label", "pred_label")


@query("evl_02_report", """
    select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from report
    union all select 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
      cast(sum(support) as bigint) from report
    union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from report
    union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from report""", GUESSED)
def _(t):
    return r6(E.classification_report(guessed(t), "label", "pred_label"))


@query("evl_03_attack_recall", """
    select label, count(*) as n, round(case when label = 'Benign' then 1 - avg(pred) else avg(pred) end, 9) as recall from triaged group by 1""")
def _(t):
    return r6(E.attack_recall(t.triaged), digits=9)


@query("evl_03_class_recall", """
    select label, count(*) as n, round(avg((label = pred_label)::int), 9) as recall from guessed group by 1""", GUESSED)
def _(t):
    return r6(E.class_recall(guessed(t), "label", "pred_label"), digits=9)


@query("evl_04_overall_recall", """
    select round(avg(pred) filter (label <> 'Benign'), 9) as attack_recall, round(avg(1 - pred) filter (label = 'Benign'), 9) as benign_recall
    from triaged""")
def _(t):
    return r6(E.overall_recall(t.triaged), digits=9)


# Thresholds of the reported sweep.
SWEEP = [0.13, 0.15, 0.17, 0.19, 0.21, 0.23, 0.25]


@query("evl_05_threshold_sweep", " union all ".join(
    f"select {x}e0 as threshold, round(avg((t_score > {x}e0)::int) filter (label = 'Benign'), 9) as fp_rate, "
    f"round(avg((t_score > {x}e0)::int) filter (label <> 'Benign'), 9) as recall from scored where t_score is not null" for x in SWEEP))
def _(t):
    return r6(E.threshold_sweep(t.scored, "t_score", SWEEP), digits=9)


@query("evl_06_accuracy_gap", """
    with s as (select g.*, r.split from guessed g join split_rows r using (capture_day, capture_file, first_packet_id))
    select round(a, 9) as train_accuracy, round(b, 9) as test_accuracy, round(abs(a - b), 9) as gap from (
      select avg((label = pred_label)::int) filter (split = 'train') as a, avg((label = pred_label)::int) filter (split = 'test') as b from s)""", GUESSED)
def _(t):
    t.store("file_scored").__dict__["file_flows"] = t.file_scored
    sides = t.split_rows.select("capture_day", "capture_file", "first_packet_id", "split")
    rows = guessed(t).join(sides, ["capture_day", "capture_file", "first_packet_id"])
    return r6(E.accuracy_gap(rows, "label", "pred_label"), digits=9)


@query("evl_07_score_health", """
    select capture_day, capture_file, count(*) as n, min(t_score) as low, max(t_score) as high, round(avg(t_score), 9) as mean,
      round(avg(t_score) filter (label <> 'Benign'), 9) as attack_mean, round(stddev_pop(t_score), 9) as std, stddev_pop(t_score) < 0.1 as collapsed
    from file_scored where t_score is not null group by grouping sets ((capture_day, capture_file), ())""")
def _(t):
    return r6(E.score_health(t.file_scored, "t_score"), digits=9)


@query("evl_08_day_accuracy", """
    select capture_day, count(*) as n, count(*) filter (label <> 'Benign') as attacks,
      round(avg(((label <> 'Benign')::int = pred)::int), 9) as accuracy, round(avg(pred) filter (label <> 'Benign'), 9) as attack_recall
    from file_triaged group by 1""")
def _(t):
    return r6(E.day_accuracy(t.file_triaged), digits=9)


@query("evl_09_score_means", """
    select (label <> 'Benign')::int as is_attack, round(avg(x_score), 9) as mean_x_score, round(avg(t_score), 9) as mean_t_score from scored group by 1""")
def _(t):
    return r6(E.score_means(t.scored, ["x_score", "t_score"]), digits=9)
