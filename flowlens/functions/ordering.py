"""Running sums, ranks and lags that survive a hot group.

A plain window puts a whole group in one task. Here a group is cut into slices
by columns that are monotone in the sort order: each (group, slice) is ordered
on its own, one small aggregate holds the totals per slice, and the prefix of
those totals is joined back on (group, slice), the partitioning the rows already
have. Slices come from row values only, so a recomputed task gives the same rows.
Group and slice columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.session import materialize

KEY_SPACE = 1_000_003
KEY_SLICES = 1024


def epoch_us(ts: Column | str) -> Column:
    """Microseconds since the epoch of an NTZ timestamp (session zone is UTC)."""
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def time_slice(ts: Column | str, seconds: int = 60) -> Column:
    return F.floor(epoch_us(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def value_slice(value: Column | str, per_unit: int = 64) -> Column:
    """Monotone logarithmic bucket of a double; fine near zero, coarse in the tail."""
    col = F.col(value) if isinstance(value, str) else value
    return F.floor(F.signum(col) * F.log1p(F.abs(col)) * per_unit).cast("bigint")


def hash_key(seed: int, *cols: str) -> Column:
    """Repeatable pseudo-random key in [0, KEY_SPACE)."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(KEY_SPACE))


def key_slice(key: Column | str, slices: int = KEY_SLICES) -> Column:
    col = F.col(key) if isinstance(key, str) else key
    return F.floor(col * F.lit(slices) / F.lit(KEY_SPACE)).cast("int")


def running_sums(
    df: DataFrame,
    values: dict[str, str],
    group: Sequence[str],
    order: Sequence[str],
    slices: Sequence[str] = (),
    totals: bool = False,
) -> DataFrame:
    """Inclusive running sums ``{output: input}`` inside each group.

    ``slices`` go from coarse to fine and nest; with none, the group is ordered
    in one window, so pass none only for pre-aggregated input. ``totals`` adds
    ``<output>_total``, the sum over the whole group.
    """
    group, slices = list(group), list(slices)
    part = group + slices
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = df.withColumns({out: F.sum(src).over(upto) for out, src in values.items()})
    if not slices:
        if totals:
            whole = Window.partitionBy(*group)
            local = local.withColumns(
                {f"{out}_total": F.sum(src).over(whole) for out, src in values.items()}
            )
        return local
    per_slice = df.groupBy(*part).agg(*[F.sum(src).alias(f"_own_{out}") for out, src in values.items()])
    ahead = running_sums(
        per_slice,
        {f"_ahead_{out}": f"_own_{out}" for out in values},
        group, [slices[-1]], slices[:-1], totals,
    )
    keep = [F.col(c) for c in part]
    for out in values:
        keep.append((F.col(f"_ahead_{out}") - F.col(f"_own_{out}")).alias(f"_before_{out}"))
        if totals:
            keep.append(F.col(f"_ahead_{out}_total").alias(f"{out}_total"))
    joined = local.join(ahead.select(*keep), part)
    return joined.withColumns(
        {out: F.col(out) + F.col(f"_before_{out}") for out in values}
    ).drop(*[f"_before_{out}" for out in values])


def refined_slices(
    df: DataFrame, group: Sequence[str], slice_col: str, order: Sequence[str], most: int, out: str = "_fine", per_part: int = 64
) -> tuple[DataFrame, list[str], DataFrame | None]:
    """Cut slices of more than ``most`` rows at splitters drawn from their own rows.

    Returns the rows, the slice columns from coarse to fine, and the rows per slice where none
    had to be cut. Rows are counted per (group, slice), once and stored. A heavy slice gets
    splitters from a sample of its rows by a hash of ``order``, about ``per_part`` to half of
    ``most``, so its parts hold fewer rows than ``most``; only rows equal in all of ``order`` stay
    together. What the splitters take follows the number of heavy slices, and rows of
    other slices get part 0.
    """
    part = [*group, slice_col]
    counts = materialize(df.groupBy(*part).agg(F.count(F.lit(1)).alias("_own")), "slice-counts")
    heavy = counts.filter(F.col("_own") > most)
    if not heavy.limit(1).count():
        return df, [slice_col], counts
    heavy = heavy.withColumn("_parts", F.ceil(F.col("_own") * 2 / most).cast("int"))
    drawn = F.pmod(F.xxhash64(F.lit(7), *order), F.lit(1 << 30)) < F.lit(float(per_part << 30)) * F.col("_parts") / F.col("_own")
    sample = df.join(heavy, part).filter(drawn).groupBy(*part, "_parts").agg(
        F.sort_array(F.collect_list(F.struct(*order))).alias("_sample"))
    at = F.transform(
        F.sequence(F.lit(1), F.col("_parts") - 1), lambda i: F.element_at("_sample", F.ceil(i * F.size("_sample") / F.col("_parts")).cast("int")))
    splitters = materialize(sample.select(*part, F.array_distinct(at).alias("_splitters")), "splitters")
    below = F.size(F.filter("_splitters", lambda s: s < F.struct(*order)))
    placed = df.join(splitters, part, "left").withColumn(out, F.coalesce(F.when(F.col("_splitters").isNotNull(), below), F.lit(0)))
    return placed.drop("_splitters"), [slice_col, out], None


def sliced_row_number(
    df: DataFrame,
    out: str,
    group: Sequence[str],
    order: Sequence[str],
    slices: Sequence[str],
    count_as: str | None = None,
    per_slice: DataFrame | None = None,
) -> DataFrame:
    """1-based ``row_number`` per group, and the group size as ``count_as``.

    ``per_slice`` may give the rows of each (group, slice) as ``_own``, if they are known.
    """
    group, slices = list(group), list(slices)
    part = group + slices
    local = df.withColumn(out, F.row_number().over(Window.partitionBy(*part).orderBy(*order)).cast("bigint"))
    if per_slice is None:
        per_slice = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_own"))
    ahead = running_sums(per_slice, {"_ahead": "_own"}, group, [slices[-1]], slices[:-1], count_as is not None)
    keep = [*part, (F.col("_ahead") - F.col("_own")).alias("_before")]
    if count_as:
        keep.append(F.col("_ahead_total").alias(count_as))
    return local.join(ahead.select(*keep), part).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def previous_time(
    df: DataFrame, out: str, ts: str, group: Sequence[str], order: Sequence[str], slice_col: str
) -> DataFrame:
    """Time of the preceding row in the group; ``ts`` leads the sort order."""
    group = list(group)
    part = group + [slice_col]
    local = df.withColumn(out, F.lag(ts).over(Window.partitionBy(*part).orderBy(*order)))
    last = df.groupBy(*part).agg(F.max(ts).alias("_last"))
    carried = last.select(
        *part, F.lag("_last").over(Window.partitionBy(*group).orderBy(slice_col)).alias("_carried")
    )
    return local.join(carried, part).withColumn(out, F.coalesce(out, "_carried")).drop("_carried")
