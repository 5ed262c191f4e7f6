"""Components against numpy's eigenvectors, whitened rows against plain arithmetic."""

from fractions import Fraction

import numpy as np
import pytest

from flowlens.llm import queries, whitening

RNG = np.random.default_rng(7)


def spectra(n):
    return {
        "spread": np.linspace(1, 2, n), "equal": np.ones(n), "wide": 10.0 ** RNG.uniform(-10, 3, n),
        "two values": np.r_[np.ones(n // 2), np.full(n - n // 2, 2.0)], "rank one": np.r_[np.zeros(n - 1), 1.0],
        "whole": np.arange(n) + 0.0,
    }


@pytest.mark.parametrize("n", [1, 2, 3, 16, 64])
def test_components(n):
    turn = np.linalg.qr(RNG.standard_normal((n, n)))[0]
    for name, values in spectra(n).items():
        for matrix in (turn @ np.diag(values) @ turn.T, np.diag(values)):
            found, vectors = whitening.components(matrix)
            scale = max(values.max(), 1e-300)
            assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * scale, name
            assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-13, name
            assert np.abs(matrix @ vectors - vectors * found).max() <= 1e-12 * scale, name


def test_polar_factor():
    matrix = RNG.standard_normal((30, 30))
    matrix += matrix.T
    values, vectors = np.linalg.eigh(matrix)
    assert np.abs(whitening.polar(matrix) - vectors * np.sign(values) @ vectors.T).max() < 1e-11


def expected(rows, most=4):
    """(id, deviation) and whitened values of each kept row, explained shares: with exact sums and numpy's eigenvectors."""
    kept = [(i, [int(np.floor(256 * float(c))) for c in v]) for i, v in rows
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, total)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        white = np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, total)]) @ vectors[:, :most] / np.sqrt(values[:most])
        out.append((i, sum((n * c - s) ** 2 for c, s in zip(x, total)), white))
    return n, out, values[:most] / values.sum()


def compare(rows, found, most=4):
    n, kept, explained = expected(rows, most)
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-9
    by_id = {}
    for r in found:
        by_id.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    assert set(by_id) == {(i, d) for i, d, _ in kept}
    assert len(found) == len(kept) * len(explained)
    ours = np.array([[by_id[i, d][k + 1][0] for k in range(len(explained))] for i, d, _ in kept])
    theirs = np.array([w for _, _, w in kept])
    sign = np.sign((ours * theirs).sum(axis=0))
    assert np.abs(ours - theirs * sign).max() < 1e-8


def test_every_embedding(spark, sf_dir, table):
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings").collect()]
    compare(rows, queries.QUERIES["op12_whitening"](spark, sf_dir).collect())


def test_odd_rows(spark):
    base = [(i, [float(v) for v in np.float32(RNG.normal(0.1, 0.3, 6) * np.arange(1, 7))]) for i in range(50)]
    rows = base + [(3, base[3][1]), (3, base[3][1]), (100, None), (101, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (None, base[5][1]),
                   (102, [float("nan")] * 6), (103, [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, [-0.0] * 6), (105, [1e-9, -1e-9] * 3)]
    schema = "vec_id long, embedding array<float>, component string, n string, x string, id string"
    df = spark.createDataFrame([(*r, "c", "n", "x", "i") for r in rows], schema).repartition(5)
    compare(rows, whitening.whiten(df).collect())
    longer = spark.createDataFrame([(*r, "c", "n", "x", "i") for r in [*rows, (200, [1.0]), (201, [])]], schema)
    compare(rows, whitening.whiten(longer).collect())
    assert whitening.whiten(df.limit(0)).collect() == []
    assert whitening.whiten(df.where("vec_id = 3")).collect() == []


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 2.0]), (3, [4e9, 1.0]), (4, [1e30, 1.0])], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df).collect()}
    assert found[3] is None and set(found) == {1, 2, 3}
    small = {r["vec_id"]: r["deviation"] for r in whitening.whiten(df.where("vec_id < 3")).collect()}
    assert small == {1: 256**2 + 512**2, 2: 256**2 + 512**2}
