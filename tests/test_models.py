"""Model plumbing: class order, early stopping, pairing and scoring. Quality is not tested."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import boosting as B
from flowlens.operators import models as M
from flowlens.operators.triage import attack_score

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(600).select(
        F.col("id"), F.concat(F.lit("D"), F.col("id") % 3).alias("capture_day"),
        (F.pmod(F.xxhash64("id"), F.lit(100)) / 10.0).alias("a"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)) / 10.0).alias("b"),
    )
    label = F.when(F.col("a") > 8, "Zeta").when(F.col("a") > 6, "Alpha").otherwise("Benign")
    return df.withColumn("label", label).cache()


def test_multiclass_finds_benign_by_name(rows):
    model, labels = M.fit_multiclass(rows, FEATURES, trees=5, depth=4)
    assert labels == ["Alpha", "Benign", "Zeta"]
    scored = M.score_multiclass(model, labels, rows, FEATURES)
    assert scored.filter("abs(x_score - (1 - probs[1])) > 1e-12").count() == 0
    assert scored.filter("label = pred_label").count() > 550
    assert [r["feature"] for r in M.feature_importances(model, FEATURES, 1).collect()] == ["a"]
    raw = model.transform(rows).select(attack_score(F.col("probability"), labels).alias("x")).agg(F.sum("x")).first()[0]
    assert raw == pytest.approx(scored.agg(F.sum("x_score")).first()[0])


def test_unseen_labels_are_dropped(spark, rows):
    model, labels = M.fit_multiclass(rows.filter("label <> 'Zeta'"), FEATURES, trees=2, depth=2)
    scored = M.score_multiclass(model, labels, rows, FEATURES)
    assert scored.filter("label = 'Zeta'").count() == 0


def test_early_stopping_and_importance(rows):
    flagged = rows.withColumn("held_out", F.col("id") % 10 == 0)
    model = M.fit_binary_early_stop(flagged, FEATURES, "held_out", rounds=15, depth=2, step=0.3, tolerance=0.05)
    assert 1 <= model.stages[-1].getNumTrees <= 15
    added = {r["feature"]: r["added_loss"] for r in M.permutation_importance(model, rows, FEATURES, ["id"]).collect()}
    assert set(added) == set(FEATURES) and added["a"] > added["b"]


def test_continual_training_reads_a_day_and_the_sample(spark, rows, tmp_path, monkeypatch):
    path, read = str(tmp_path / "days"), []
    rows.write.partitionBy("capture_day").parquet(path)
    whole = M.materialize
    monkeypatch.setattr(M, "materialize", lambda df, name: read.append(df) or whole(df, name))
    models = M.continual_training(spark.read.parquet(path), FEATURES, ["D0", "D1", "D2"], ["id"], rounds=3, retained_pct=10.0, key=F.col("id"))
    assert [(day, n) for day, _, n in models] == [("D0", 200), ("D1", 200 + 34), ("D2", 200 + 34 + 33)]
    for day, df in zip(["D0", "D1", "D2"], read):
        files = [f for f in df.inputFiles() if "capture_day=" in f]
        assert files and all(f"capture_day={day}/" in f for f in files) or "PartitionFilters" in df._jdf.queryExecution().toString()
        assert df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("FileScan") == (1 if day == "D0" else 2)


def pooled_logistic(center):
    """Loader of a network that takes the logistic of the mean-pooled, log-scaled window."""

    def load():
        def predict(batch):
            steps = np.log1p(np.abs(batch.reshape(len(batch), -1, 9)))
            return 1.0 / (1.0 + np.exp(center - steps.mean(axis=(1, 2))))

        return predict

    return load


def test_vector_scores_match_numpy(spark):
    data = np.random.default_rng(0).normal(3, 1, (11, 1800)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "i int, sequence_features array<float>")
    load = pooled_logistic(2.0)
    found = [r["t_score"] for r in M.score_vectors(df, load, batch=4).orderBy("i").collect()]
    np.testing.assert_allclose(found, load()(data), rtol=1e-5)


def test_window_summary_counts_padding(tables):
    windows, names = M.window_summary(tables.clean, label_domain=tables.domain)
    assert len(names) == 45
    row = windows.filter("packets < 200").select(
        "packets", "bytes", "frame_len_avg", "frame_len_last", "packet_direction_avg"
    ).first()
    assert row["frame_len_avg"] == pytest.approx(row["bytes"] / 200)
    assert row["frame_len_last"] == 0.0
    assert row["packet_direction_avg"] == pytest.approx(row["packets"] / 200)


def boosted_by_hand(x, y, w, rounds, depth, step, ridge, alpha, least_weight, least_gain, cuts):
    """Softmax boosting on whole arrays, a cut at a time: margins after each round."""
    classes, n = int(y.max()) + 1, len(y)
    shrink = lambda g: np.sign(g) * max(abs(g) - alpha, 0)
    share = np.bincount(y, w) / w.sum()
    margins, history = np.tile(np.log(share), (n, 1)), []
    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        update = np.zeros_like(margins)
        for k in range(classes):
            g, h = w * (p[:, k] - (y == k)), 2 * w * p[:, k] * (1 - p[:, k])
            todo = [(np.arange(n), 0)]
            while todo:
                rows, level = todo.pop()
                whole = shrink(g[rows].sum()) ** 2 / (h[rows].sum() + ridge)
                best = (least_gain, None)
                for f in range(x.shape[1]) if level < depth else ():
                    for c in cuts[f]:
                        left = rows[x[rows, f] <= c]
                        right = rows[x[rows, f] > c]
                        if min(h[left].sum(), h[right].sum()) < least_weight:
                            continue
                        gain = sum(shrink(g[s].sum()) ** 2 / (h[s].sum() + ridge) for s in (left, right)) - whole
                        if gain > best[0] + 1e-9:
                            best = (gain, (left, right))
                if best[1] is None:
                    update[rows, k] = -step * shrink(g[rows].sum()) / (h[rows].sum() + ridge)
                else:
                    todo += [(s, level + 1) for s in best[1]]
        margins += update
        history.append(margins.copy())
    return history


def test_boosting_matches_plain_arithmetic(rows):
    s = B.Settings(rounds=3, patience=3, depth=3, step=0.3, row_share=1.0, feature_share=1.0, least_weight=2.0, bins=8, keep_every=2)
    flagged = rows.withColumn("held", F.col("id") % 10 == 0)
    model = B.fit_boosted(flagged, FEATURES, "held", ["id"], s)
    assert model.labels == ["Alpha", "Benign", "Zeta"] and [r for r, _, _ in model.losses] == [0, 1, 2, 3] and model.best_round == 3
    data = flagged.filter("not held").orderBy("id").toPandas()
    weight = {r["label"]: r["weight"] for r in M.class_weights(flagged.filter("not held")).collect()}
    x, y = data[FEATURES].to_numpy(), data["label"].map(model.labels.index).to_numpy()
    w = data["label"].map(weight).to_numpy()
    history = boosted_by_hand(x, y, w, 3, s.depth, s.step, s.ridge, s.alpha, s.least_weight, s.least_gain, model.edges)
    for (_, loss, _), margins in zip(model.losses[1:], history):
        p = np.exp(margins[np.arange(len(y)), y]) / np.exp(margins).sum(axis=1)
        assert loss == pytest.approx(-(w * np.log(p)).sum() / w.sum(), rel=1e-5)
    scored = model.score(flagged.filter("not held")).orderBy("id").toPandas()
    margins = history[-1]
    expected = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    np.testing.assert_allclose(np.array(scored["probs"].tolist()), expected, atol=1e-6)
    np.testing.assert_allclose(scored["x_score"], 1 - expected[:, 1], atol=1e-6)
    assert model.importances()["a"] > 0.9 and sum(model.importances().values()) == pytest.approx(1)


def test_boosting_stops_before_it_learns_noise(spark, rows):
    noisy = rows.withColumn("label", F.when(F.rand(1) < 0.5, "Alpha").otherwise("Benign")).withColumn("held", F.col("id") % 4 == 0)
    noisy = spark.createDataFrame(noisy.collect(), noisy.schema)
    model = B.fit_boosted(noisy, FEATURES, "held", ["id"], B.Settings(rounds=12, patience=2, depth=4, step=0.6, least_weight=1.0, bins=16))
    assert len(model.losses) < 13 and len(model.trees) == model.best_round <= len(model.losses) - 3
    found = {r["round"]: r for r in B.losses(spark, model).collect()}
    assert min(found, key=lambda r: found[r]["held_out_loss"]) == model.best_round and found[model.best_round]["chosen"]
    assert found[max(found)]["train_loss"] < found[0]["train_loss"]


def test_a_pass_over_the_rows_per_level(rows, monkeypatch):
    passes, whole = [], B._pass
    monkeypatch.setattr(B, "_pass", lambda *a: passes.append(len(a[3])) or whole(*a))
    flagged = rows.withColumn("held", F.col("id") % 10 == 0)
    B.fit_boosted(flagged, FEATURES, "held", ["id"], B.Settings(rounds=2, depth=2, step=0.3, least_weight=1.0, bins=8))
    assert len(passes) == 2 * 2 + 1  # all classes at once; the last pass judges the last round


def test_boosted_rows_of_every_kind(spark, rows):
    model = B.fit_boosted(rows.withColumn("held", F.lit(False)), FEATURES, "held", ["id"], B.Settings(rounds=2, depth=2, step=0.5, bins=4))
    assert len(model.trees) == 2 and all(np.isnan(h) for _, _, h in model.losses)
    odd = spark.createDataFrame([(1, None, None, "Benign"), (2, float("nan"), 1e300, "New"), (3, -1e300, float("inf"), None)],
                                "id long, a double, b double, label string")
    assert model.score(odd).filter("abs(aggregate(probs, 0d, (s, x) -> s + x) - 1) < 1e-9").count() == 3
    assert model.score(odd.limit(0)).count() == 0
    again = B.BoostedTrees.from_rows(model.to_rows(spark))
    assert (again.labels, again.features, again.edges, again.best_round) == (model.labels, model.features, model.edges, 2)
    x = np.random.default_rng(0).integers(0, 4, (50, 2)).astype(np.uint8)
    assert (again.probabilities(x) == model.probabilities(x)).all()


@pytest.fixture(scope="module")
def classifier(tables):
    from flowlens.plans.hybrid import held_out_session
    from flowlens.plans.training import train_flow_classifier
    from flowlens.session import materialize

    flows = materialize(tables.file_flows.withColumn("held_out", held_out_session()), "flows")
    return flows, train_flow_classifier(flows.filter("not held_out"), ["capture_day", "capture_file", "first_packet_id"],
                                        settings=B.Settings(rounds=3, depth=3, step=0.3))


def test_saved_classifier_scores_alike(spark, classifier, tmp_path):
    from flowlens.plans.training import FlowClassifier

    flows, fitted = classifier
    fitted.save(str(tmp_path / "c"))
    loaded = FlowClassifier.load(spark, str(tmp_path / "c"))
    assert (loaded.labels, loaded.features) == (fitted.labels, fitted.features)
    scores = [sorted(map(tuple, c.score(flows, ["first_packet_id", "label"]).select("first_packet_id", "pred_label", "x_score").collect()))
              for c in (fitted, loaded)]
    assert scores[0] == scores[1] and len(scores[0]) > 0


def test_report_of_held_out_sessions(tables, classifier):
    from flowlens.plans.hybrid import evaluation_report, held_out_session, triage_flows
    from flowlens.session import materialize

    flows, fitted = classifier
    windows, names = M.window_summary(tables.clean, per_file=True, label_domain=tables.domain)
    windows = materialize(windows.withColumn("held_out", held_out_session()), "windows")
    key = ["capture_day", "capture_file", "ip_src", "ip_dst"]
    sides = [windows.filter(c).select(*key).distinct() for c in ("held_out", "not held_out")]
    assert sides[0].count() > 0 and sides[0].intersect(sides[1]).count() == 0
    assert sides[1].intersect(flows.filter("held_out").select(*key).distinct()).count() == 0
    model = M.fit_sequence_model(windows.filter("not held_out"), names)
    triaged = materialize(triage_flows(fitted, model, flows.filter("held_out"), windows.filter("held_out")), "triaged")
    report = {(r["section"], r["name"], r["other"]): r["value"] for r in evaluation_report(triaged).collect()}
    n = triaged.count()
    assert sum(v for (s, _, _), v in report.items() if s == "confusion") == n == report["triggers", "flows", None]
    assert report["triggers", "trigger_rate", None] == pytest.approx(report["triggers", "triggered", None] / n)
    attacks = triaged.filter("label <> 'Benign'").count()
    assert report.get(("report", "1", "support"), 0) == attacks
    hits = sum(report["recall", r["label"], None] * r["count"] for r in triaged.filter("label <> 'Benign'").groupBy("label").count().collect())
    assert hits == pytest.approx(report.get(("confusion", "1", "1"), 0))


def test_weighted_scores_keep_the_weighted_share(rows):
    """An unpenalised intercept makes the weighted mean score the weighted attack share."""
    (_, model, _), = M.continual_training(rows.withColumn("capture_day", F.lit("D0")), FEATURES, ["D0"], ["id"], rounds=100)
    scored = M.with_positive_weight(M.score_binary(model, rows, FEATURES), M.FLOW_POSITIVE_WEIGHT)
    mean, share = scored.agg(F.sum(F.expr("w * x_score")) / F.sum("w"), F.sum(F.expr("w * y")) / F.sum("w")).first()
    assert mean == pytest.approx(share, abs=1e-3)


def test_components_share_the_whole_variance(rows):
    from flowlens.operators import scaling as SC

    wide = rows.withColumn("c", F.col("a") * 2 - F.col("b")).withColumn("d", F.lit(3.0))
    _, shares = SC.principal_components(wide, ["a", "b", "c", "d"], k=4)
    assert sum(shares) == pytest.approx(1) and shares[0] >= shares[1] and shares[2] == pytest.approx(0, abs=1e-9)
