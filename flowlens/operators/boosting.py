"""Multi-class boosted trees with softmax loss, grown level by level on histograms.

Features are cut into quantile bins once. A level of all trees of a round, one per class, is
one pass over the rows: every task adds gradients and curvatures by (tree, leaf, feature, bin),
Spark adds the tasks' sums, and the driver, which sees nothing else, picks the cuts. So what
it sees follows the model's size (classes, leaves, features, bins), not the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.operators.models import class_weights, label_encoding
from flowlens.schema import BENIGN
from flowlens.session import materialize


@dataclass(frozen=True)
class Settings:
    """Defaults of the boosted flow classifier."""

    rounds: int = 500
    patience: int = 30
    depth: int = 10
    step: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    least_weight: float = 5.0
    least_gain: float = 0.1
    alpha: float = 0.1
    ridge: float = 1.0
    bins: int = 64
    seed: int = 42
    #: Rounds after which the margins of all rows are written, so that passes apply few trees.
    keep_every: int = 8


@dataclass
class Trees:
    """One tree per class as heaps: children of node i are 2i+1 and 2i+2; a leaf has the feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(classes: int, depth: int) -> "Trees":
        shape = (classes, 2 ** (depth + 1) - 1)
        return Trees(np.full(shape, -1, np.int32), np.zeros(shape, np.int32), np.zeros(shape), np.zeros(shape))

    def leaves(self, x: np.ndarray, k: int) -> np.ndarray:
        """The leaf of tree ``k`` that each row of bins falls in."""
        node, at = np.zeros(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[k, node]
            inner = f >= 0
            if not inner.any():
                return node
            node = np.where(inner, 2 * node + 1 + (x[at, f] > self.cut[k, node]), node)

    def margins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([self.value[k, self.leaves(x, k)] for k in range(len(self.value))])


@dataclass
class BoostedTrees:
    """A fit: features with their bin edges, class names with the logarithms of their weighted shares, from which margins
    start, trees of the rounds kept, and the losses by round."""

    features: list[str]
    labels: list[str]
    base: list[float]
    edges: list[list[float]]
    trees: list[Trees]
    losses: list[tuple[int, float, float]] = field(default_factory=list)
    best_round: int = 0

    def importances(self) -> dict[str, float]:
        """Share of each feature in the total gain of all cuts."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            inner = t.feature >= 0
            np.add.at(total, t.feature[inner], t.gain[inner])
        return dict(zip(self.features, (total / total.sum() if total.sum() else total).tolist()))

    def to_rows(self, spark: SparkSession) -> DataFrame:
        """The model as a table: one row per node, bin edge and class, for :meth:`from_rows`."""
        rows = [("label", i, 0, 0, 0, float(b), 0.0, name) for i, (name, b) in enumerate(zip(self.labels, self.base))]
        for i, (name, cuts) in enumerate(zip(self.features, self.edges)):
            rows.append(("feature", i, 0, 0, 0, 0.0, 0.0, name))
            rows += [("edge", i, j, 0, 0, float(c), 0.0, None) for j, c in enumerate(cuts)]
        for r, t in enumerate(self.trees):
            used = (t.feature >= 0) | (t.value != 0)
            rows += [("node", r, int(k), int(i), int(t.feature[k, i]), float(t.value[k, i]), float(t.gain[k, i]), str(t.cut[k, i]))
                     for k, i in zip(*np.nonzero(used))]
        rows += [("depth", int(np.log2(t.feature.shape[1] + 1)) - 1, 0, 0, 0, 0.0, 0.0, None) for t in self.trees[:1]]
        rows += [("loss", r, 0, 0, 0, float(a), float(b), None) for r, a, b in self.losses]
        rows.append(("best", self.best_round, 0, 0, 0, 0.0, 0.0, None))
        return spark.createDataFrame(rows, "kind string, a int, b int, c int, d int, v double, g double, name string")

    @staticmethod
    def from_rows(table: DataFrame) -> "BoostedTrees":
        rows: dict[str, list] = {}
        for r in table.orderBy("a", "b", "c").collect():
            rows.setdefault(r["kind"], []).append(r)
        labels, features = ([r["name"] for r in rows.get(kind, [])] for kind in ("label", "feature"))
        edges: list[list[float]] = [[] for _ in features]
        for r in rows.get("edge", []):
            edges[r["a"]].append(r["v"])
        best, trees = rows["best"][0]["a"], []
        for r in rows.get("node", []):
            while len(trees) <= r["a"]:
                trees.append(Trees.empty(len(labels), rows["depth"][0]["a"]))
            t, at = trees[r["a"]], (r["b"], r["c"])
            t.feature[at], t.cut[at], t.value[at], t.gain[at] = r["d"], int(r["name"]), r["v"], r["g"]
        while len(trees) < best:
            trees.append(Trees.empty(len(labels), rows["depth"][0]["a"]))
        base = [r["v"] for r in rows.get("label", [])]
        return BoostedTrees(features, labels, base, edges, trees, [(r["a"], r["v"], r["g"]) for r in rows.get("loss", [])], best)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        margins = np.tile(np.array(self.base), (len(x), 1))
        for t in self.trees:
            margins += t.margins(x)
        return _softmax(margins)

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probs`` (in the order of ``labels``), ``pred_label`` and ``x_score`` = 1 - P(Benign)."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def probabilities(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            model = shared.value
            for columns in batches:
                x = _binned([c.to_numpy(float) for c in columns], model.edges)
                yield pd.Series(list(model.probabilities(x)))

        names = F.array(*[F.lit(x) for x in self.labels])
        benign = F.col("probs")[self.labels.index(BENIGN)] if BENIGN in self.labels else F.lit(0.0)
        return df.withColumn("probs", probabilities(*_inputs(self.features))).withColumn(
            "pred_label", F.element_at(names, F.array_position("probs", F.array_max("probs")).cast("int"))
        ).withColumn("x_score", 1 - benign)


def _inputs(features: Sequence[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]


def _softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _binned(columns: Sequence[np.ndarray], edges: Sequence[Sequence[float]]) -> np.ndarray:
    """Bin b of a value: how many of its feature's edges are below it."""
    return np.column_stack([np.searchsorted(e, c, "left") for c, e in zip(columns, edges)]).astype(np.uint8)


def _kept(keys: np.ndarray, round_: int, settings: Settings) -> np.ndarray:
    """Rows of a round's sample, from their keys alone, so a task that runs again draws the same ones."""
    h = keys.astype(np.uint64) ^ np.uint64((round_ + 1) * 0x9E3779B97F4A7C15 + settings.seed & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) >> np.uint64(11) < settings.row_share * 2.0**53


def _packed(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    data = np.ascontiguousarray(matrix)
    offsets = np.arange(len(data) + 1, dtype=np.int32) * (data.shape[1] * data.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    n = len(column)
    bound = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[bound[0] : bound[-1]].view(kind).reshape(n, -1)


class _Rows:
    """The columns of a stored batch as arrays: bins, margins, class, weight, key, held out."""

    def __init__(self, batch: pa.RecordBatch):
        self.x, self.margins = _unpacked(batch.column("x"), np.uint8), _unpacked(batch.column("m"), np.float32)
        self.y, self.w, self.key = (batch.column(c).to_numpy() for c in ("y", "w", "key"))
        self.held = batch.column("held").to_numpy(zero_copy_only=False)


def _added(partial: DataFrame) -> dict[int, np.ndarray]:
    """Rows (slot, v) added up by slot: streamed in tasks, one row per slot to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, v in zip(batch.column("slot").to_pylist(), batch.column("v").to_pylist()):
                part = np.frombuffer(v)
                total[slot] = total[slot] + part if slot in total else part
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slot", "v"])

    return {r["slot"]: np.frombuffer(r["v"]) for r in partial.repartition("slot").mapInArrow(add, partial.schema).collect()}


def _pass(rows: DataFrame, recent: list[Trees], growing: Trees, active: list[list[int]], round_: int, settings: Settings):
    """Histograms of all active leaves, and in a round's first pass the loss of all rounds before it (slot -1)."""
    size, bins = growing.feature.shape[1], settings.bins
    shared = rows.sparkSession.sparkContext.broadcast((recent, growing))
    first = all(leaves in ([0], []) for leaves in active)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, current = shared.value
        total: dict[int, np.ndarray] = {}

        def add(slot: int, v: np.ndarray) -> None:
            total[slot] = total[slot] + v if slot in total else v

        for batch in batches:
            if not batch.num_rows:
                continue
            r = _Rows(batch)
            margins = r.margins.astype(float)
            for t in before:
                margins += t.margins(r.x)
            p = _softmax(margins)
            if first:
                loss = -np.log(np.maximum(p[np.arange(len(p)), r.y], 1e-15)) * r.w
                add(-1, np.array([loss[~r.held].sum(), r.w[~r.held].sum(), loss[r.held].sum(), r.w[r.held].sum()]))
            use = ~r.held & _kept(r.key, round_, settings)
            x, n_features = r.x[use].astype(np.int64), r.x.shape[1]
            cell = np.arange(n_features) * bins + x
            for k, leaves in enumerate(active):
                if not leaves:
                    continue
                place = np.full(size, -1, np.int64)
                place[leaves] = np.arange(len(leaves))
                at = place[current.leaves(r.x[use], k)]
                there = at >= 0
                pk, w = p[use, k][there], r.w[use][there]
                g = w * (pk - (r.y[use][there] == k))
                h = np.maximum(2 * w * pk * (1 - pk), 1e-16)
                index = (at[there, None] * (n_features * bins) + cell[there]).ravel()
                length = len(leaves) * n_features * bins
                sums = [np.bincount(index, np.repeat(v, n_features), length).reshape(len(leaves), -1) for v in (g, h)]
                for j, leaf in enumerate(leaves):
                    add(k * size + leaf, np.concatenate([sums[0][j], sums[1][j]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slot", "v"])

    found = _added(rows.mapInArrow(tally, "slot int, v binary"))
    shared.unpersist()
    return found


def _shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def _cut(trees: Trees, k: int, leaf: int, sums: np.ndarray, allowed: np.ndarray, s: Settings) -> bool:
    """Cut a leaf where the gain is largest, if any cut is worth it, and set the values of its children."""
    g, h = sums.reshape(2, -1, s.bins)
    value = lambda g, h: -s.step * _shrunk(g, s.alpha) / (h + s.ridge)
    quality = lambda g, h: _shrunk(g, s.alpha) ** 2 / (h + s.ridge)
    g_all, h_all = g[0].sum(), h[0].sum()
    trees.value[k, leaf] = value(g_all, h_all)
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    gain = quality(left_g, left_h) + quality(g_all - left_g, h_all - left_h) - quality(g_all, h_all)
    fits = (left_h >= s.least_weight) & (h_all - left_h >= s.least_weight) & allowed[:, None]
    gain = np.where(fits, gain, -np.inf)
    at = np.unravel_index(int(gain.argmax()), gain.shape) if gain.size else (0, 0)
    if not gain.size or not gain[at] > s.least_gain:
        return False
    trees.feature[k, leaf], trees.cut[k, leaf], trees.gain[k, leaf] = at[0], at[1], gain[at]
    trees.value[k, 2 * leaf + 1] = value(left_g[at], left_h[at])
    trees.value[k, 2 * leaf + 2] = value(g_all - left_g[at], h_all - left_h[at])
    trees.value[k, leaf] = 0.0
    return True


def _store(rows: DataFrame, recent: list[Trees]) -> DataFrame:
    """The rows with the margins of ``recent`` added to theirs, written."""
    shared = rows.sparkSession.sparkContext.broadcast(recent)

    def update(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                r = _Rows(batch)
                margins = r.margins.astype(float)
                for t in shared.value:
                    margins += t.margins(r.x)
                batch = batch.set_column(batch.schema.get_field_index("m"), "m", _packed(margins.astype(np.float32)))
            yield batch

    return materialize(rows.mapInArrow(update, rows.schema), "boosting")


def quantile_edges(df: DataFrame, features: Sequence[str], bins: int, error: float = 0.001) -> list[list[float]]:
    """Up to ``bins`` - 1 distinct quantiles of each feature, by mergeable sketches of the given rank error, in one pass."""
    probabilities = [i / bins for i in range(1, bins)]
    picked = df.select(*[c.alias(f"f{i}") for i, c in enumerate(_inputs(features))])
    return [sorted(set(q)) for q in picked.approxQuantile(picked.columns, probabilities, error)]


def fit_boosted(
    rows: DataFrame, features: Sequence[str], held_out: str, ids: Sequence[str], settings: Settings = Settings(),
) -> BoostedTrees:
    """Softmax boosting over all labels, stopped by the weighted log-loss of the rows where ``held_out`` is true.

    Margins start at the classes' shares, so round 0 is what those alone give. Classes are alphabetical, weighted by ``class_weights`` of the fitted rows. NULL features are 0; rows with a
    label that no fitted row has are left out. ``ids`` name the columns that tell rows apart: a round's
    sample of rows follows from them. The model ends with its best round; without held-out
    rows all rounds are kept.
    """
    spark, s = rows.sparkSession, settings
    fitted = rows.filter(~F.col(held_out))
    encoder = label_encoding(fitted).join(class_weights(fitted).select("label", "weight"), "label")
    encoder = encoder.join(fitted.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    known = encoder.orderBy("label_idx").collect()  # one row per class
    if not known:
        raise ValueError("no rows to fit")
    labels, share = [r["label"] for r in known], np.array([r["n"] * r["weight"] for r in known])
    base = np.log(share / share.sum())
    edges = quantile_edges(fitted, features, s.bins)
    classes, n_features = len(labels), len(features)
    given = rows.join(encoder, "label").select(
        F.col("label_idx").alias("y"), F.col("weight").cast("double").alias("w"), F.col(held_out).alias("held"),
        F.xxhash64(*ids).alias("key"), *[c.alias(f"f{i}") for i, c in enumerate(_inputs(features))])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _binned([batch.column(f"f{i}").to_numpy() for i in range(n_features)], edges)
            margins = np.tile(base.astype(np.float32), (len(x), 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("y", "w", "held", "key")), _packed(x), _packed(margins)],
                names=["y", "w", "held", "key", "x", "m"])

    stored = materialize(given.mapInArrow(binned, "y int, w double, held boolean, key long, x binary, m binary"), "boosting")
    rng = np.random.default_rng(s.seed)
    model = BoostedTrees(list(features), labels, base.tolist(), edges, [])
    recent: list[Trees] = []
    best = (np.inf, 0)
    for round_ in range(s.rounds + 1):
        growing = Trees.empty(classes, s.depth)
        size = growing.feature.shape[1]
        active = [[0] if round_ < s.rounds else []] * classes
        found = _pass(stored, recent, growing, active, round_, s)
        train_loss, train_weight, held_loss, held_weight = found[-1]
        loss = held_loss / held_weight if held_weight else np.nan
        model.losses.append((round_, float(train_loss / train_weight), float(loss)))
        if loss < best[0]:
            best = (loss, round_)
        if round_ == s.rounds or held_weight and round_ - best[1] >= s.patience:
            break
        allowed = rng.random((classes, n_features)) < s.feature_share
        allowed[~allowed.any(axis=1)] = True
        for level in range(s.depth):
            if level:
                found = _pass(stored, recent, growing, active, round_, s)
            active = [
                [child for leaf in leaves if k * size + leaf in found and _cut(growing, k, leaf, found[k * size + leaf], allowed[k], s)
                 for child in (2 * leaf + 1, 2 * leaf + 2)] for k, leaves in enumerate(active)]
            if not any(active):
                break
        model.trees.append(growing)
        recent.append(growing)
        if len(recent) == s.keep_every:
            stored, recent = _store(stored, recent), []
    model.best_round = best[1] if best[0] < np.inf else len(model.trees)
    model.trees = model.trees[: model.best_round]
    return model


def losses(spark: SparkSession, model: BoostedTrees) -> DataFrame:
    """round, train_loss, held_out_loss (NULL without held-out rows) and whether the model ends with that round."""
    rows = [(r, a, None if np.isnan(b) else b, r == model.best_round) for r, a, b in model.losses]
    return spark.createDataFrame(rows, "round int, train_loss double, held_out_loss double, chosen boolean")


def top_importances(spark: SparkSession, model: BoostedTrees, k: int = 15) -> DataFrame:
    """The k features with most gain, most first: feature, importance."""
    rows = [(f, float(v)) for f, v in model.importances().items()]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature").limit(k)
