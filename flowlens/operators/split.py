"""Repeatable samples and splits.

Order comes from a sampling key in [0, KEY_SPACE); by default a seeded hash of
row values, so a rerun or a recomputed task picks the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.cleaning import is_attack
from flowlens.functions.ordering import hash_key, key_slice, running_sums, sliced_row_number
from flowlens.operators.audit import file_classes
from flowlens.schema import BENIGN, FILE_KEY

SEED = 42
TEST_RATIO = 0.15
GOLDEN_RATE = 0.05
TOP_ROWS = 100_000


def _ordered(df: DataFrame, ids: Sequence[str], key: Column | None, seed: int) -> DataFrame:
    chosen = key if key is not None else hash_key(seed, *ids)
    return df.withColumn("_key", chosen.cast("bigint")).withColumn("_slice", key_slice("_key"))


def _ranked(
    df: DataFrame, group: Sequence[str], ids: Sequence[str], key: Column | None, seed: int, count_as: str | None = None
) -> DataFrame:
    keyed = _ordered(df, ids, key, seed)
    return sliced_row_number(keyed, "_rank", group, ["_key", *ids], ["_slice"], count_as).drop("_slice")


def _first_rows(keyed: DataFrame, ids: Sequence[str], want: Callable[[Column], Column]) -> Column:
    """Condition that holds for the first ``want(total)`` rows by (_key, ids).

    Counts per key (at most KEY_SPACE rows) locate the key in which the quota
    ends; only the rows of that key are ordered, to find the last row that fits.
    All other rows are decided by a comparison, without a shuffle.
    """
    per_key = keyed.groupBy("_key", "_slice").agg(F.count(F.lit(1)).alias("_own"))
    upto = running_sums(per_key, {"_upto": "_own"}, [], ["_key"], ["_slice"], totals=True)
    before, quota = F.col("_upto") - F.col("_own"), want(F.col("_upto_total"))
    edge = upto.filter((quota > before) & (quota <= F.col("_upto"))).select(
        F.struct(F.col("_key").alias("key"), (quota - before).alias("need")).alias("e")
    )
    near = keyed.withColumn("_edge", edge.scalar()).filter(F.col("_key") == F.col("_edge.key"))
    order = Window.partitionBy("_key").orderBy(*ids)
    row_key = F.struct("_key", *ids)
    last = near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == F.col("_edge.need"))
    return F.coalesce(row_key <= last.select(row_key.alias("k")).scalar(), F.lit(False))


def sample_rows(df: DataFrame, n: int, ids: Sequence[str], key: Column | None = None, seed: int = SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) by sampling key; ``ids`` identify a row.

    Up to ``TOP_ROWS`` are the first rows of every task merged in one pass. Larger
    samples are found by their last key, which reads the input three times but moves no rows.
    """
    keyed = _ordered(df, ids, key, seed)
    if n <= TOP_ROWS:
        return keyed.orderBy("_key", *ids).limit(n).drop("_key", "_slice")
    taken = _first_rows(keyed, ids, lambda total: F.least(F.lit(n), total))
    return keyed.filter(taken).drop("_key", "_slice")


def first_files(flows: DataFrame, n: int) -> DataFrame:
    """Rows of the first ``n`` captures by day and name."""
    names = flows.select(*FILE_KEY).distinct().orderBy(*FILE_KEY).limit(n)
    return flows.join(names, FILE_KEY, "left_semi")


def files_up_to(flows: DataFrame, max_rows: int) -> DataFrame:
    """Whole files in name order until ``max_rows`` is reached; the last one may overshoot."""
    counts = flows.groupBy(*FILE_KEY).agg(F.count(F.lit(1)).alias("n"))
    reached = running_sums(counts, {"_upto": "n"}, [], FILE_KEY, ["capture_day"])
    kept = reached.filter(F.col("_upto") - F.col("n") < max_rows).select(*FILE_KEY)
    return flows.join(kept, FILE_KEY, "left_semi")


def attack_priority(
    flows: DataFrame, max_total: int = 12_000_000, file_key: Column | None = None, seed: int = SEED
) -> DataFrame:
    """Every attack-bearing file, then shuffled benign files until ``max_total`` rows.

    The running total is over one row per file, sliced by key.
    """
    files = file_classes(flows).withColumn(
        "_key", (file_key if file_key is not None else hash_key(seed, *FILE_KEY)).cast("bigint")
    ).withColumns({"_benign": (~F.col("has_attack")).cast("int"), "_slice": key_slice("_key")})
    loaded = running_sums(files, {"_upto": "n"}, [], ["_key", *FILE_KEY], ["_benign", "_slice"])
    kept = loaded.filter(F.col("has_attack") | (F.col("_upto") - F.col("n") < max_total))
    return flows.join(kept.select(*FILE_KEY), FILE_KEY, "left_semi")


def stratified_split(
    flows: DataFrame, ids: Sequence[str], key: Column | None = None,
    test_ratio: float = TEST_RATIO, seed: int = SEED,
) -> DataFrame:
    """``split`` = train or test, drawn per file for attack and benign rows apart.

    A file gives ``max(1, int(ratio * n))`` attacks to test when it has at least
    two, and ``int(ratio * n)`` benign rows.
    """
    rows = flows.withColumn("_attack", is_attack())
    ranked = _ranked(rows, [*FILE_KEY, "_attack"], ids, key, seed, count_as="_n")
    share = F.floor(F.col("_n") * F.lit(test_ratio))
    quota = F.when(F.col("_attack") == 0, share).when(F.col("_n") > 1, F.greatest(F.lit(1), share)).otherwise(0)
    return ranked.withColumn(
        "split", F.when(F.col("_rank") <= quota, "test").otherwise("train")
    ).drop("_rank", "_key", "_n", "_attack")


def split_summary(split_rows: DataFrame) -> DataFrame:
    """Train and test rows per label, test share, and whether an attack is on both sides."""
    return (
        split_rows.groupBy("label").pivot("split", ["train", "test"]).count()
        .select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("train", "test")])
        .withColumn("test_pct", F.col("test") * 100.0 / (F.col("train") + F.col("test")))
        .withColumn(
            "coverage",
            F.when(F.col("label") == BENIGN, "n/a")
            .when((F.col("train") > 0) & (F.col("test") > 0), "ok").otherwise("fail"),
        )
    )


def overlap_rows(split_rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur in both train and test; a valid split has none."""
    side = lambda s: split_rows.filter(F.col("split") == s).select(*key)
    return side("train").intersect(side("test"))


def golden_files(
    files: DataFrame, rate: float = GOLDEN_RATE, file_key: Column | None = None, seed: int = SEED
) -> DataFrame:
    """Per day ``max(1, int(rate * files))`` held-out files, from (capture_day, capture_file) rows."""
    names = files.select("capture_day", "capture_file").distinct().withColumn(
        "_key", (file_key if file_key is not None else hash_key(seed, "capture_day", "capture_file")).cast("bigint")
    )
    day = Window.partitionBy("capture_day")
    return (
        names.withColumn("_rank", F.row_number().over(day.orderBy("_key", "capture_file")))
        .withColumn("_n", F.count(F.lit(1)).over(day))
        .filter(F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(rate))))
        .select("capture_day", "capture_file")
    )


def golden_set(table: DataFrame, golden: DataFrame) -> DataFrame:
    """Rows of the held-out files; apply to flows and sequences alike to keep pairs together."""
    return table.join(golden, ["capture_day", "capture_file"], "left_semi")


def repair_sequences(
    sequences: DataFrame, test_rows: DataFrame, ids: Sequence[str], key: Column | None = None,
    test_ratio: float = TEST_RATIO, seed: int = SEED,
) -> DataFrame:
    """Test sequences for the test flows of each file.

    Where every test row index fits the file's sequences and some match, those
    are taken; otherwise a proportional sample of at least one. Inputs carry
    capture_day, capture_file and ``row_idx``.
    """
    tested = test_rows.select(*FILE_KEY, "row_idx").distinct()
    tops = tested.groupBy(*FILE_KEY).agg(F.max("row_idx").alias("_top"))
    ranked = _ranked(sequences, FILE_KEY, ids, key, seed, count_as="_n")
    marked = ranked.join(tested.withColumn("_match", F.lit(1)), [*FILE_KEY, "row_idx"], "left")
    matched = (
        marked.groupBy(*FILE_KEY).agg(F.count("_match").alias("_matches"), F.max("_n").alias("_size"))
        .join(tops, FILE_KEY)
        .select(*FILE_KEY, ((F.col("_size") > F.col("_top")) & (F.col("_matches") > 0)).alias("_by_index"))
    )
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(test_ratio)))
    return (
        marked.join(matched, FILE_KEY)
        .filter(F.when(F.col("_by_index"), F.col("_match") == 1).otherwise(F.col("_rank") <= quota))
        .withColumn("picked_by", F.when(F.col("_by_index"), "index").otherwise("sample"))
        .drop("_rank", "_key", "_n", "_match", "_by_index")
    )


def evaluation_quota(
    files: DataFrame, limit: int | None = None, file_key: Column | None = None, seed: int = SEED
) -> DataFrame:
    """How many rows each file adds to an evaluation of ``limit`` rows (all, if None) in shuffled file order.

    ``files`` has capture_day, capture_file, n and triggers; the last file is cut and its
    triggers are prorated.
    """
    keyed = files.withColumn(
        "_key", (file_key if file_key is not None else hash_key(seed, *FILE_KEY)).cast("bigint")
    )
    sliced = keyed.withColumn("_slice", key_slice("_key"))
    upto = running_sums(sliced, {"_upto": "n"}, [], ["_key", *FILE_KEY], ["_slice"])
    take = F.col("n") if limit is None else F.least(F.col("n"), F.lit(limit) - (F.col("_upto") - F.col("n")))
    return (
        upto.withColumn("take", take).filter(F.col("take") > 0)
        .withColumn(
            "triggers_counted",
            F.when(F.col("take") == F.col("n"), F.col("triggers").cast("bigint"))
            .otherwise(F.floor(F.col("triggers") * (F.col("take") / F.col("n")))),
        )
        .select(*FILE_KEY, "n", "triggers", "take", "triggers_counted")
    )


def evaluation_rows(rows: DataFrame, quota: DataFrame) -> DataFrame:
    """The first ``take`` rows of each file, by 0-based ``row_idx``."""
    return (
        rows.join(quota.select(*FILE_KEY, "take"), FILE_KEY)
        .filter(F.col("row_idx") < F.col("take")).drop("take")
    )


def permutation_split(
    df: DataFrame, ids: Sequence[str], fraction: float = 0.9, key: Column | None = None, seed: int = SEED
) -> DataFrame:
    """Exact train/eval split of a permutation: the first ``int(fraction * n)`` rows train."""
    keyed = _ordered(df, ids, key, seed)
    trains = _first_rows(keyed, ids, lambda total: F.floor(total * F.lit(fraction)))
    return keyed.withColumn("split", F.when(trains, "train").otherwise("eval")).drop("_key", "_slice")


def mixed_batches(
    df: DataFrame, ids: Sequence[str], batches: int, key: Column | None = None, seed: int = SEED
) -> DataFrame:
    """Rows in ``batches`` buckets by sampling key, each mixing days and classes, sorted by key."""
    keyed = _ordered(df, ids, key, seed).drop("_slice")
    placed = keyed.withColumn("batch", F.pmod("_key", F.lit(batches)).cast("int"))
    return placed.repartition("batch", (F.col("_key") / 1024).cast("int")).sortWithinPartitions("batch", "_key").drop("_key")
