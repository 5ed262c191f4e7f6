"""Sliced ranks, sums and lags against plain windows, with one group holding most rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from flowlens.functions.ordering import (
    KEY_SPACE, hash_key, key_slice, previous_time, refined_slices, running_sums, sliced_row_number, time_slice, value_slice,
)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [
        ("hot" if rng.random() < 0.6 else f"g{rng.randrange(20)}", rng.randrange(500), i, rng.randrange(1, 9))
        for i in range(3000)
    ]
    return spark.createDataFrame(data, "g string, k long, id long, v long").withColumns({
        "coarse": F.floor(F.col("k") / 100), "fine": F.floor(F.col("k") / 7),
        # coarse and fine slices must nest
        "nested": F.floor(F.col("k") / 20),
    })


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


@pytest.mark.parametrize("slices", [["coarse"], ["fine"], ["coarse", "nested"]])
def test_rank_and_count(rows, slices):
    group = Window.partitionBy("g")
    plain = rows.select(
        "id", F.row_number().over(group.orderBy("k", "id")).cast("long").alias("rn"),
        F.count(F.lit(1)).over(group).alias("n"),
    )
    sliced = sliced_row_number(rows, "rn", ["g"], ["k", "id"], slices, count_as="n")
    assert same(sliced.select("id", "rn", "n"), plain)


@pytest.mark.parametrize("group", [["g"], []])
def test_running_sum(rows, group):
    upto = Window.partitionBy(*group).orderBy("k", "id").rowsBetween(Window.unboundedPreceding, 0)
    plain = rows.select("id", F.sum("v").over(upto).alias("s"), F.sum("v").over(Window.partitionBy(*group)).alias("t"))
    sliced = running_sums(rows, {"s": "v"}, group, ["k", "id"], ["coarse", "nested"], totals=True)
    assert same(sliced.select("id", "s", "s_total"), plain)


def test_previous_time(spark, rows):
    timed = rows.withColumn("ts", F.timestamp_seconds(F.col("k") * 40).cast("timestamp_ntz"))
    plain = timed.select("id", F.lag("ts").over(Window.partitionBy("g").orderBy("ts", "id")).alias("p"))
    lagged = previous_time(timed.withColumn("s", time_slice("ts", 600)), "p", "ts", ["g"], ["ts", "id"], "s")
    key = lambda r: (r[0], str(r[1]))
    assert sorted(map(key, lagged.select("id", "p").collect())) == sorted(map(key, plain.collect()))


def test_slices_are_monotone(spark):
    values = [-1e12, -5.0, -0.1, 0.0, 1e-9, 0.5, 0.51, 1.0, 7.0, 1000.0, 1000.5, 1e15]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_slice("v").alias("s"))
    found = [r["s"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert found == sorted(found)


def test_hash_key_range_and_spread(rows):
    keyed = rows.select(hash_key(42, "id").alias("k")).withColumn("s", key_slice("k"))
    low, high, distinct, top = keyed.agg(F.min("k"), F.max("k"), F.countDistinct("k"), F.max("s")).first()
    assert 0 <= low and high < KEY_SPACE and distinct > 2900 and top < 1024


@pytest.fixture(scope="module")
def flood(spark):
    """A session that sends 30,000 packets in one minute, a third of them at one instant, beside quiet ones."""
    rng = random.Random(3)
    data = [("hot", rng.choice([30_000_000, rng.randrange(60_000_000), rng.randrange(1000)]), i) for i in range(30_000)]
    data += [(f"q{i % 40}", rng.randrange(600_000_000), 100_000 + i) for i in range(1500)]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "g string, us long, packet_id long")
    return df.withColumn("packet_ts", F.timestamp_micros("us").cast("timestamp_ntz")).withColumn("_slice", time_slice("packet_ts")).cache()


def test_no_part_of_a_flooded_minute_holds_more_than_its_share(flood):
    order = ["packet_ts", "packet_id"]
    cut, slices, counts = refined_slices(flood, ["g"], "_slice", order, 2000)
    assert slices == ["_slice", "_fine"] and counts is None
    sizes = {(r["g"], r["_slice"], r["_fine"]): r["count"] for r in cut.groupBy("g", *slices).count().collect()}
    assert sum(sizes.values()) == 31_500 and max(sizes.values()) < 2000
    assert sum(g == "hot" for g, _, _ in sizes) >= 20 and all(f == 0 for g, _, f in sizes if g != "hot")
    ranked = sliced_row_number(cut, "rn", ["g"], order, slices, count_as="n").select("packet_id", "rn", "n")
    group = Window.partitionBy("g")
    plain = flood.select(
        "packet_id", F.row_number().over(group.orderBy(*order)).cast("long").alias("rn"), F.count(F.lit(1)).over(group).alias("n"))
    assert same(ranked, plain)


def test_quiet_slices_are_left_whole(flood):
    cut, slices, counts = refined_slices(flood, ["g"], "_slice", ["packet_ts", "packet_id"], 100_000)
    assert slices == ["_slice"] and cut is flood and counts.agg(F.sum("_own")).first()[0] == 31_500
    ranked = sliced_row_number(cut, "rn", ["g"], ["packet_ts", "packet_id"], slices, per_slice=counts)
    assert same(ranked.select("packet_id", "rn"), sliced_row_number(flood, "rn", ["g"], ["packet_ts", "packet_id"], slices).select("packet_id", "rn"))
