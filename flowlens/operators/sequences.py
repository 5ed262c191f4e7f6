"""Sliding windows over packet sessions.

A session of at most ``size`` packets is one window; a longer one starts a
window every ``stride`` packets while a full window fits, and its ragged tail
falls out.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.ordering import refined_slices, sliced_row_number, time_slice
from flowlens.operators.flows import mode_in_domain
from flowlens.schema import (
    FILE_KEY,
    MAX_SEQUENCES_PER_FILE, SEQUENCE_FEATURES, SESSION_KEY, WINDOW_SIZE, WINDOW_STRIDE,
)

_SLICE = "_slice"
ROWS_PER_SLICE = 2_000_000


def _session_key(per_file: bool) -> list[str]:
    return [*(["capture_day", "capture_file"] if per_file else []), *SESSION_KEY]


def number_packets(
    packets: DataFrame,
    per_file: bool = False,
    bidirectional: bool = False,
    slice_seconds: int = 60,
    ts: str = "packet_ts",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Packets with position ``rn``, session size ``n`` and ``packet_direction``.

    Sessions are directed, so the direction is 1 on every row; ``bidirectional``
    folds both directions into one session and compares with its first sender. A minute in
    which a session sends more than ``rows_per_slice`` packets is cut further, by what it holds.
    """
    rows = packets.filter(F.col("ip_src").isNotNull() & F.col("ip_dst").isNotNull())
    key = _session_key(per_file)
    if bidirectional:
        rows = rows.withColumn("_sender", F.col("ip_src")).withColumns(
            {"ip_src": F.least("_sender", "ip_dst"), "ip_dst": F.greatest("_sender", "ip_dst")}
        )
    rows = rows.withColumn(_SLICE, time_slice(ts, slice_seconds))
    order = [ts, "packet_id"]
    cut, slices, counts = refined_slices(rows, key, _SLICE, order, rows_per_slice)
    numbered = sliced_row_number(cut, "rn", key, order, slices, count_as="n", per_slice=counts)
    if not bidirectional:
        return numbered.withColumn("packet_direction", F.lit(1)).drop(*slices)
    first = rows.groupBy(*key).agg(F.min_by("_sender", F.struct(ts, "packet_id")).alias("_first"))
    return (
        numbered.join(first, key)
        .withColumn("packet_direction", (F.col("_sender") == F.col("_first")).cast("int"))
        .drop(*slices, "_first", "_sender")
    )


def last_window(n: Column, size: int, stride: int) -> Column:
    return F.when(n <= size, F.lit(0)).otherwise(F.floor((n - size) / stride)).cast("bigint")


def session_windows(
    packets: DataFrame,
    size: int = WINDOW_SIZE,
    stride: int = WINDOW_STRIDE,
    per_file: bool = False,
    bidirectional: bool = False,
    label_domain: list[str] | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per window: packet count, sums and label.

    Rows fan out to the windows they belong to and are combined before the
    shuffle, so what travels is about one row per window.
    """
    key = _session_key(per_file)
    numbered = number_packets(packets, per_file, bidirectional)
    last = last_window(F.col("n"), size, stride)
    rn = F.col("rn")
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((rn - size) / stride).cast("bigint"))
    high = F.least(F.floor((rn - 1) / stride).cast("bigint"), last)
    # sequence() counts down when low > high, so tail rows must be gone first
    placed = numbered.filter((rn <= last * stride + size) & (low <= high)).withColumn(
        "win", F.explode(F.sequence(low, high))
    )
    label = mode_in_domain(label_domain) if label_domain else F.mode("label", True)
    aggs = {
        "packets": F.count(F.lit(1)),
        "bytes": F.sum("frame_len"),
        "flags_sum": F.sum("tcp_flags"),
        "payload_ratio_sum": F.sum("payload_ratio"),
        "direction_sum": F.sum("packet_direction"),
        "label": label,
    } | (extra or {})
    return placed.groupBy(*key, "win").agg(*[c.alias(n) for n, c in aggs.items()])


def window_vectors(
    packets: DataFrame,
    size: int = WINDOW_SIZE,
    stride: int = WINDOW_STRIDE,
    per_file: bool = False,
    bidirectional: bool = False,
    blocks_per_group: int = 64,
) -> DataFrame:
    """Flat float vectors of ``size`` steps x 9 features, zero padded, with the window label.

    Packets are gathered into blocks of gcd(size, stride); a window is a run of
    blocks. Block runs are laid out in groups that each carry a short halo of the
    next group's blocks, so packets are shuffled about once instead of once per
    window they appear in, and a long session spreads over many groups.
    """
    block = gcd(size, stride)
    span, step = size // block, stride // block
    per_group = max(blocks_per_group, span)
    key = _session_key(per_file)
    numbered = number_packets(packets, per_file, bidirectional)
    last = last_window(F.col("n"), size, stride)
    values = F.array(*[F.col(c).cast("float") for c in SEQUENCE_FEATURES])
    own = F.floor(F.col("_block") / per_group).cast("bigint")
    in_halo = (F.col("_block") % per_group < span - 1) & (own > 0)
    rows = (
        numbered.filter(F.col("rn") <= last * stride + size)
        .select(
            *key, "rn", "label", values.alias("_values"),
            last.alias("_last"),
            F.floor((F.col("rn") - 1) / block).cast("bigint").alias("_block"),
        )
        .withColumn("_group", F.explode(F.when(in_halo, F.array(own, own - 1)).otherwise(F.array(own))))
    )
    blocks = (
        rows.repartition(*key, "_group")
        .groupBy(*key, "_group", "_block", "_last")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "_values", "label"))).alias("_rows"))
    )
    order = Window.partitionBy(*key, "_group").orderBy("_block")
    ahead = [F.lead("_rows", i).over(order).alias(f"_rows{i}") for i in range(1, span)]
    starts = (
        blocks.select(*key, "_group", "_block", "_last", "_rows", *ahead)
        .filter(
            (F.floor(F.col("_block") / per_group) == F.col("_group"))
            & (F.col("_block") % step == 0)
            & (F.col("_block") / step <= F.col("_last"))
        )
    )
    pieces = [F.col("_rows")] + [F.coalesce(F.col(f"_rows{i}"), F.slice("_rows", 1, 0)) for i in range(1, span)]
    steps = starts.select(
        *key, (F.col("_block") / step).cast("bigint").alias("win"), F.concat(*pieces).alias("_steps")
    )
    flat = F.flatten(F.transform("_steps", lambda r: r["_values"]))
    width = size * len(SEQUENCE_FEATURES)
    padded = F.concat(flat, F.array_repeat(F.lit(0.0).cast("float"), F.lit(width) - F.size(flat)))
    return steps.select(
        *key, "win", padded.alias("sequence_features"),
        array_mode(F.transform("_steps", lambda r: r["label"])).alias("label"),
    )


def array_mode(values: Column) -> Column:
    """Most frequent string of a short array, lowest on ties."""
    counted = F.transform(
        F.array_distinct(values),
        lambda v: F.struct((-F.size(F.filter(values, lambda x: x == v))).alias("c"), v.alias("v")),
    )
    return F.array_min(counted)["v"]


def cap_per_file(windows: DataFrame, cap: int | None = MAX_SEQUENCES_PER_FILE) -> DataFrame:
    """At most ``cap`` windows per capture (all, if None), in session and window order.

    Adds ``seq_idx``, the 0-based position in the capture.
    """
    ranked = sliced_row_number(
        windows, "_rank", FILE_KEY, ["ip_src", "ip_dst", "win"], ["ip_src", "ip_dst"]
    )
    kept = ranked if cap is None else ranked.filter(F.col("_rank") <= cap)
    return kept.withColumn("seq_idx", F.col("_rank") - 1).drop("_rank")
