"""Time-binned tables, inter-arrival times and top talkers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.cleaning import is_internal
from flowlens.functions.ordering import epoch_us, previous_time, refined_slices, time_slice
from flowlens.schema import FILE_KEY


def time_bin(ts: Column | str, unit: str) -> Column:
    return F.date_trunc(unit, F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def time_spine(bounds: DataFrame, group: Sequence[str], unit: str, name: str = "bin") -> DataFrame:
    """Every bin between ``lo`` and ``hi`` of each group; days first, so the bins spread over tasks."""
    day, step = F.expr("interval 1 day"), F.expr(f"interval 1 {unit}")
    days = bounds.withColumn("_day", F.explode(F.sequence(time_bin("lo", "day"), F.col("hi"), day)))
    if unit == "second":
        days = days.repartition(*group, "_day")
    first = F.greatest(F.col("_day"), F.col("lo"))
    last = F.least(F.col("_day") + day - step, F.col("hi"))
    return days.select(*group, F.explode(F.sequence(first, last, step)).alias(name))


def binned(
    df: DataFrame,
    unit: str,
    measures: dict[str, Column],
    group: Sequence[str] = (),
    ts: str = "packet_ts",
    name: str = "bin",
) -> DataFrame:
    """Measures per time bin and group, with a zero row for every empty bin in between."""
    group = list(group)
    rows = df.withColumn(name, time_bin(ts, unit))
    counts = rows.groupBy(*group, name).agg(*[c.alias(n) for n, c in measures.items()])
    bounds = counts.groupBy(*group).agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    filled = time_spine(bounds.filter(F.col("lo").isNotNull()), group, unit, name)
    return filled.join(counts, [*group, name], "left").select(
        *group, name, *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures]
    )


def packet_rate(packets: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Packets per second, empty seconds included."""
    return binned(packets, "second", {"packets": F.count(F.lit(1))}, group)


def intensity(flows: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Packets per minute of flow start; each group is filled between its own ends."""
    return binned(flows, "minute", {"packets": F.sum("frame_len_count")}, group, ts="timestamp_min")


def file_timeline(flows: DataFrame) -> DataFrame:
    """Packets per minute over all files, with a row for each minute inside some file's range.

    The per-file series only add zeros to the sum, so minutes are summed once
    and the file ranges decide which empty minutes show.
    """
    rows = flows.withColumn("bin", time_bin("timestamp_min", "minute"))
    sums = rows.groupBy("bin").agg(F.sum("frame_len_count").alias("packets"))
    ranges = rows.groupBy(*FILE_KEY).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    shown = time_spine(ranges, FILE_KEY, "minute").select("bin").distinct()
    return shown.join(sums, "bin", "left").select("bin", F.coalesce("packets", F.lit(0)).alias("packets"))


def mark_windows(bins: DataFrame, attack_log: DataFrame, name: str = "bin", unit: str = "minute") -> DataFrame:
    """Bins with the number of attack windows that touch them.

    Windows become the list of bins they touch, counted per bin, so the join is
    on the bin and never multiplies rows.
    """
    touched = (
        attack_log.filter(F.col("start_ts") <= F.col("end_ts"))
        .select(time_bin("start_ts", unit).alias("lo"), time_bin("end_ts", unit).alias("hi"))
    )
    hits = time_spine(touched, [], unit, name).groupBy(name).agg(F.count(F.lit(1)).alias("attack_windows"))
    return bins.join(hits, name, "left").withColumn(
        "attack_windows", F.coalesce("attack_windows", F.lit(0))
    ).withColumn("in_attack", F.col("attack_windows") > 0)


def interarrival(
    packets: DataFrame, group: Sequence[str] = FILE_KEY, ts: str = "packet_ts", slice_seconds: int = 60,
    rows_per_slice: int = 2_000_000,
) -> DataFrame:
    """Seconds since the preceding packet of the group; NULL on its first packet.

    Slices of more than ``rows_per_slice`` packets are cut further, by what they hold.
    """
    rows = packets.withColumn("_slice", time_slice(ts, slice_seconds))
    cut, slices, _ = refined_slices(rows, group, "_slice", [ts, "packet_id"], rows_per_slice)
    cut = cut.withColumn("_place", F.struct(*slices)).drop(*slices)
    lagged = previous_time(cut, "_prev", ts, group, [ts, "packet_id"], "_place")
    gap = (epoch_us(ts) - epoch_us("_prev")) / F.lit(1e6)
    return lagged.withColumn("interarrival_sec", gap).drop("_prev", "_place")


def port_entropy(packets: DataFrame, group: Sequence[str] = (), unit: str = "minute") -> DataFrame:
    """Natural-log entropy of destination ports per bin; bins without ports are 0.

    H = ln N - sum(n ln n) / N, so two plain aggregates are enough.
    """
    rows = packets.filter(F.col("tcp_dstport").isNotNull()).withColumn("bin", time_bin("packet_ts", unit))
    per_port = rows.groupBy(*group, "bin", "tcp_dstport").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").cast("double")
    entropy = F.log(total) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / total
    per_bin = per_port.groupBy(*group, "bin").agg(entropy.alias("port_entropy"))
    bounds = per_bin.groupBy(*group).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spine = time_spine(bounds.filter(F.col("lo").isNotNull()), group, unit)
    return spine.join(per_bin, [*group, "bin"], "left").select(
        *group, "bin", F.coalesce("port_entropy", F.lit(0.0)).alias("port_entropy")
    )


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the lower value."""
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), column).limit(k)
    )


def top_internal_targets(flows: DataFrame, k: int = 5) -> DataFrame:
    return top_values(flows.filter(is_internal("ip_dst")), "ip_dst", k)


def busiest_minutes(flows: DataFrame, k: int = 10) -> DataFrame:
    """The k busiest minutes, by flow starts, of the most targeted internal host."""
    victim = top_internal_targets(flows, 1).select("ip_dst").scalar()
    return (
        flows.filter(F.col("ip_dst") == victim)
        .groupBy("ip_dst", time_bin("timestamp_min", "minute").alias("minute"))
        .agg(F.count(F.lit(1)).alias("flows"))
        .orderBy(F.desc("flows"), "minute").limit(k)
    )
