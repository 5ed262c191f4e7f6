"""Windows against a plain-Python sliding loop."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import sequences as S
from flowlens.operators import timeline as TL
from flowlens.schema import SEQUENCE_FEATURES
from test_packets import PACKET, at, packet


def lengths(spark, sizes):
    rows, i = [], 0
    for n in sizes:
        for k in range(n):
            rows.append(packet(i, at(k * 7), src=f"s{n:04d}", length=60 + i % 50, label="ab"[(k // 30) % 2]))
            i += 1
    return spark.createDataFrame(rows, PACKET).withColumn("payload_ratio", (F.col("frame_len") - 40) / F.col("frame_len"))


def expected_windows(packets, size, stride):
    """{(src, win): (vector, label)} by the loop rule."""
    rows = sorted(packets.collect(), key=lambda r: (r["ip_src"], r["packet_ts"], r["packet_id"]))
    sessions = {}
    for r in rows:
        sessions.setdefault(r["ip_src"], []).append(r)
    out = {}
    for src, group in sessions.items():
        starts = [0] if len(group) <= size else range(0, len(group) - size + 1, stride)
        for win, start in enumerate(starts):
            part = group[start:start + size]
            vector = np.zeros((size, len(SEQUENCE_FEATURES)), dtype=np.float32)
            for j, r in enumerate(part):
                vector[j] = [1 if c == "packet_direction" else r[c] for c in SEQUENCE_FEATURES]
            counts = Counter(r["label"] for r in part)
            label = min(counts, key=lambda x: (-counts[x], x))
            out[src, win] = (vector.ravel(), label)
    return out


def test_window_counts(spark):
    df = lengths(spark, [1, 199, 200, 201, 249, 250, 400])
    counts = dict(S.session_windows(df).groupBy("ip_src").count().collect())
    assert [counts[f"s{n:04d}"] for n in (1, 199, 200, 201, 249, 250, 400)] == [1, 1, 1, 1, 1, 2, 5]


@pytest.mark.parametrize("size,stride,groups", [(20, 5, 4), (20, 5, 64), (12, 8, 7), (10, 10, 3), (6, 9, 2), (200, 50, 64)])
def test_vectors_and_labels(spark, size, stride, groups):
    df = lengths(spark, [1, size - 1, size, size + 1, 3 * size + 1, 10 * size + 7]).cache()
    expected = expected_windows(df, size, stride)
    found = S.window_vectors(df, size, stride, blocks_per_group=groups).collect()
    assert len(found) == len(expected) == len({(r["ip_src"], r["win"]) for r in found})
    for r in found:
        vector, label = expected[r["ip_src"], r["win"]]
        assert r["label"] == label
        np.testing.assert_array_equal(np.array(r["sequence_features"], dtype=np.float32), vector)
    summary = S.session_windows(df, size, stride).collect()
    assert {(r["ip_src"], r["win"]): r["label"] for r in summary} == {k: v[1] for k, v in expected.items()}


def test_bidirectional_direction(spark):
    rows = [packet(0, at(0), "b", "a"), packet(1, at(1), "a", "b"), packet(2, at(2), "b", "a")]
    numbered = S.number_packets(spark.createDataFrame(rows, PACKET), bidirectional=True)
    assert [r["packet_direction"] for r in numbered.orderBy("packet_id").collect()] == [1, 0, 1]
    assert numbered.select("n").distinct().collect()[0][0] == 3


def test_cap(spark):
    df = spark.createDataFrame(
        [(f"d{f}", "f", f"s{s}", "d", w) for f in range(2) for s in range(4) for w in range(5)],
        "capture_day string, capture_file string, ip_src string, ip_dst string, win long",
    )
    assert S.cap_per_file(df, None).count() == 40
    kept = S.cap_per_file(df, 7).orderBy("capture_day", "seq_idx").collect()
    assert [(r["ip_src"], r["win"]) for r in kept[:7]] == [("s0", w) for w in range(5)] + [("s1", 0), ("s1", 1)]
    assert len(kept) == 14


def test_flooded_minute_gives_the_same_windows(spark):
    """One session sends everything within a second, many packets at the same microsecond."""
    rows = [packet(i, at(0), src="flood" if i % 9 else "calm", length=60 + i % 50, label="ab"[i % 7 == 0]) for i in range(3000)]
    df = spark.createDataFrame(rows, PACKET).withColumn("payload_ratio", F.col("frame_len") / 100.0)
    whole = S.number_packets(df).select("packet_id", "rn", "n")
    cut = S.number_packets(df, rows_per_slice=100).select("packet_id", "rn", "n")
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))
    gaps = [TL.interarrival(df, ["ip_src"], rows_per_slice=n).select("packet_id", "interarrival_sec") for n in (10**9, 100)]
    assert sorted(map(str, gaps[0].collect())) == sorted(map(str, gaps[1].collect()))
