"""Profiles, splits, scaling, triage, evaluation and features on hand-made rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.features import engineer_features, feature_names
from flowlens.operators import evaluate as E
from flowlens.operators import profile as P
from flowlens.operators import scaling as SC
from flowlens.operators import split as SP
from flowlens.operators import timeline as TL
from flowlens.operators import triage as TR
from flowlens.operators.models import class_weights
from test_packets import PACKET, at, packet


def test_port_entropy(spark):
    rows = [packet(i, at(i), dport=p) for i, p in enumerate([80, 80, 443, 443])] + [packet(9, at(130), dport=80)]
    found = TL.port_entropy(spark.createDataFrame(rows, PACKET)).orderBy("bin").collect()
    assert [r["port_entropy"] for r in found] == pytest.approx([math.log(2), 0.0, 0.0])


def test_packet_rate_fills_empty_seconds(spark):
    rows = [packet(0, at(0)), packet(1, at(0)), packet(2, at(86_403))]
    found = TL.packet_rate(spark.createDataFrame(rows, PACKET))
    assert found.count() == 86_404
    assert found.agg(F.sum("packets"), F.max("packets")).first() == (3, 2)


def test_ks(spark):
    split = [("Benign", float(x)) for x in (1, 2, 3)] + [("A", float(x)) for x in (4, 5, 6)]
    equal = [(label, float(x)) for label in ("Benign", "A") for x in (1, 2, 3)]
    for rows, distance in ((split, 1.0), (equal, 0.0)):
        df = spark.createDataFrame(rows, "label string, x double")
        assert P.ks_distance(df, ["x"]).first()["ks"] == pytest.approx(distance)


@pytest.mark.parametrize("n", [1, 2, 5, 100])
def test_exact_quantiles(spark, n):
    values = np.random.default_rng(n).lognormal(0, 3, n).round(2)
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    row = P.exact_quantiles(P.value_counts(df, []), [], {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert [row["a"], row["b"], row["c"]] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.9])))


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10, 10)], "v double")
    counts = [r["n"] for r in P.histogram(df, F.col("v"), 10).orderBy("bin").collect()]
    assert counts == [1, 1, 0, 0, 0, 1, 0, 0, 0, 2]


def flows_with_attacks(spark, attacks, benign):
    rows = [("D0", "f", i, "A" if i < attacks else "Benign") for i in range(attacks + benign)]
    return spark.createDataFrame(rows, "capture_day string, capture_file string, id long, label string")


@pytest.mark.parametrize("attacks,quota", [(0, 0), (1, 0), (2, 1), (20, 3)])
def test_split_quota(spark, attacks, quota):
    split = SP.stratified_split(flows_with_attacks(spark, attacks, 41), ["id"])
    test = split.filter("split = 'test'")
    assert test.filter("label = 'A'").count() == quota
    assert test.filter("label = 'Benign'").count() == 6
    assert split.count() == attacks + 41
    assert SP.overlap_rows(split, ["capture_file", "id"]).count() == 0


def test_split_is_repeatable(spark):
    df = flows_with_attacks(spark, 50, 500)
    picks = [
        {r["id"] for r in SP.stratified_split(d, ["id"]).filter("split = 'test'").collect()}
        for d in (df, df.repartition(7))
    ]
    assert picks[0] == picks[1]
    other = {r["id"] for r in SP.stratified_split(df, ["id"], seed=1).filter("split = 'test'").collect()}
    assert other != picks[0]


def test_attack_priority_keeps_every_attack_file(spark):
    rows = [("D0", f"f{f}", i, "A" if f < 3 and i == 0 else "Benign") for f in range(10) for i in range(20)]
    df = spark.createDataFrame(rows, "capture_day string, capture_file string, id long, label string")
    kept = SP.attack_priority(df, 90).groupBy("capture_file").count().collect()
    assert len(kept) == 5 and all(r["count"] == 20 for r in kept)
    assert {"f0", "f1", "f2"} <= {r["capture_file"] for r in kept}


def test_golden_files_per_day(spark):
    rows = [(f"D{d}", f"D{d}f{i}") for d, n in ((0, 3), (1, 45)) for i in range(n)]
    golden = SP.golden_files(spark.createDataFrame(rows, "capture_day string, capture_file string"))
    assert dict(golden.groupBy("capture_day").count().collect()) == {"D0": 1, "D1": 2}


def test_sample_size(spark):
    df = spark.range(500).withColumnRenamed("id", "i")
    assert SP.sample_rows(df, 100, ["i"]).distinct().count() == 100
    assert SP.sample_rows(df, 900, ["i"]).count() == 500


def test_class_weights(spark):
    rows = [("Benign",)] * 1000 + [("A",)] * 10 + [("B",)] + [("C",)] * 500
    found = {r["label"]: r["weight"] for r in class_weights(spark.createDataFrame(rows, "label string")).collect()}
    assert found == pytest.approx({"Benign": 1.0, "A": 10.0, "B": 10.0, "C": math.sqrt(2) * 1.5})


def test_scaler_divides_constant_by_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (None, 5.0)], "a double, b double")
    scaled = SC.apply_flow_scaler(df, SC.fit_flow_scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert [r["a"] for r in scaled] == [0.0, 0.0, None]
    assert [r["b"] for r in scaled] == pytest.approx([-math.sqrt(1.5), 0.0, math.sqrt(1.5)])
    clamped = SC.apply_flow_scaler(df, SC.fit_flow_scaler(df, ["a"]), ["a"], clamp=True)
    assert [r["a"] for r in clamped.collect()] == [0.0, 0.0, 0.0]


def test_sequence_scaler_pools_steps(spark):
    data = np.random.default_rng(3).normal(5, 2, (7, 4 * 9)).astype(np.float32)
    df = spark.createDataFrame([([float(x) for x in row],) for row in data], "sequence_features array<float>")
    pooled = data.reshape(-1, 9).astype(np.float64)
    found = SC.fit_sequence_scaler(df).orderBy("feature_idx").collect()
    np.testing.assert_allclose([r["mean"] for r in found], pooled.mean(axis=0), rtol=1e-9)
    np.testing.assert_allclose([r["std"] for r in found], pooled.std(axis=0), rtol=1e-9)
    scaled = SC.apply_sequence_scaler(df, SC.fit_sequence_scaler(df)).collect()
    expected = ((pooled - pooled.mean(axis=0)) / pooled.std(axis=0)).reshape(7, -1)
    np.testing.assert_allclose(sorted(r[0][0] for r in scaled), sorted(expected[:, 0]), rtol=1e-5)


FLOW = (
    "ip_src string, ip_proto int, tcp_srcport int, tcp_dstport int, frame_len_count long, frame_len_sum long, "
    "frame_len_mean double, frame_len_std double, ip_ttl_mean double, tcp_window_mean double, "
    "flow_duration_sec double, packet_rate double, label string"
)


def test_feature_count_and_order(spark):
    names = feature_names()
    assert len(names) == len(set(names)) == 43
    assert (names[0], names[14], names[23], names[32], names[42]) == (
        "packet_count", "packet_size_cv", "dst_is_http", "src_ephemeral", "rate_x_size",
    )


@pytest.mark.parametrize("ttl,low,unusual", [(31.0, 1, 1), (32.0, 0, 0), (63.5, 0, 0), (64.5, 0, 0), (65.5, 0, 1), (None, 1, 1)])
def test_ttl_features(spark, ttl, low, unusual):
    df = spark.createDataFrame([("a", 6, 1, 80, 1, 60, 60.0, None, ttl, 0.0, 0.0, 1000.0, "Benign")], FLOW)
    row = engineer_features(df).first()
    assert (row["low_ttl"], row["unusual_ttl"], row["packet_size_std"]) == (low, unusual, 0.0)
    assert row["bytes_per_sec"] == pytest.approx(60_000)


def triage_rows(spark, rows):
    return spark.createDataFrame(rows, "x_score double, t_score double, packet_rate double, frame_len_mean double")


def test_batch_triage_boundaries(spark):
    cases = [
        (0.1, 0.9, "cleared", 0), (0.1001, 0.1499, "vetoed", 0), (0.1001, 0.15, "below_consensus", 0),
        (1.0, 0.15, "verified", 1), (0.6, None, "flow_only", 1), (0.5, None, "flow_only", 0), (0.5, 0.9, "verified", 1),
    ]
    found = TR.batch_triage(triage_rows(spark, [(x, t, 1.0, 1.0) for x, t, _, _ in cases])).collect()
    assert [(r["outcome"], r["pred"]) for r in found] == [(o, p) for _, _, o, p in cases]


def test_row_cascade(spark):
    cases = [
        (0.95, 0.0, 1.0, 50.0, "ATTACK (Loud)"),
        (0.5, 0.9, 50.0, 500.0, "ATTACK (Stealth - Transformer Verified)"),
        (0.2, 0.1, 1.0, 500.0, "BENIGN (Transformer Verified)"),
        (0.7, 0.0, 50.0, 500.0, "ATTACK (XGBoost)"),
        (0.6, None, 1.0, 50.0, "ATTACK (XGBoost)"),
        (0.4, 0.9, 5.0, 100.0, "BENIGN (XGBoost)"),
    ]
    found = TR.row_cascade(triage_rows(spark, [c[:4] for c in cases])).collect()
    assert [r["verdict"] for r in found] == [c[4] for c in cases]


def test_report_zero_division_and_zero_cells(spark):
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "A")], "t string, p string")
    rows = {r["class"]: r for r in E.classification_report(df, "t", "p").collect()}
    assert (rows["B"]["precision"], rows["B"]["recall"], rows["B"]["f1"]) == (0.0, 0.0, 0.0)
    assert rows["accuracy"]["f1"] == pytest.approx(1 / 3)
    assert rows["macro avg"]["recall"] == pytest.approx(0.5 / 3)
    assert E.confusion_matrix(df, "t", "p").count() == 9


def test_correlations_are_pairwise_complete(spark):
    """Against numpy per pair: NULLs, a constant column, large offsets, infinities, and plans with one scan and no fan-out."""
    import numpy as np

    rng = np.random.default_rng(0)
    a = rng.normal(1e9, 1, 400)
    rows = [(float(x), float(2 * x + 0.1 * rng.normal()), None if i % 3 else float(-x + rng.normal()), 5.0, float("inf") if i == 7 else float(i), i)
            for i, x in enumerate(a)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f int").repartition(7)
    found = {(r["feature_a"], r["feature_b"]): r["r"] for r in P.correlation_matrix(df, list("abcdef"), merge_tasks=3).collect()}
    table = {k: np.array([np.nan if r[i] is None else r[i] for r in rows], float) for i, k in enumerate("abcdef")}
    assert len(found) == 15
    for (x, y), r in found.items():
        both = ~np.isnan(table[x]) & ~np.isnan(table[y])
        if "d" in (x, y) or "e" in (x, y) and (7 % 3 == 0 or "c" not in (x, y)):
            assert np.isnan(r)
        else:
            assert abs(r - np.corrcoef(table[x][both], table[y][both])[0, 1]) < 1e-7
    plan = P.correlation_matrix(df, list("abcdef"))._jdf.queryExecution().toString()
    assert "Generate" not in plan and "explode" not in plan
    assert [r["r"] for r in P.correlation_matrix(df.limit(0), ["a", "b"]).collect()] == [None]
    assert {(r["feature_a"], r["feature_b"]) for r in P.redundant_pairs(df, list("abcf")).collect()} == {("b", "a")} | (
        {("c", "a")} if abs(found["c", "a"]) > 0.95 else set()) | ({("c", "b")} if abs(found["c", "b"]) > 0.95 else set())


@pytest.mark.parametrize("rows, expected", [
    ([("Benign", 1.0, 5.0), ("Benign", 2.0, 6.0)], {"a": math.nan, "b": math.nan}),
    ([("Botnet", 1.0, 5.0)] * 49, {"a": math.nan, "b": math.nan}),
    ([("Benign", 1.0, 5.0), ("Botnet", 2.0, 5.0), ("Botnet", 4.0, None)], {"a": math.sqrt(4 / 7), "b": math.nan}),
    ([("Benign", 1.0, None)], {"a": math.nan, "b": None}),
    ([], {"a": None, "b": None}),
])
def test_target_correlation_without_variation(spark, rows, expected):
    """One class only, a constant feature, a single row and no rows: NaN or NULL as in the check SQL, and no error."""
    df = spark.createDataFrame(rows, "label string, a double, b double").repartition(3)
    found = {r["feature"]: r["r"] for r in P.target_correlation(df, ["a", "b"]).collect()}
    assert found == {k: None if r is None else pytest.approx(r, nan_ok=True) for k, r in expected.items()}
