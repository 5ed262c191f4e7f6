"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.rows import col, pack, unpack
from flowlens.session import materialize

#: A source's weight is its size to this power: between its share (1) and equal weights (0).
EVENNESS = 0.5
SEED = 17
#: A Poisson variable of a larger mean is a sum of variables of this mean at most, whose table is short.
MEAN_STEP = 8
TABLE = 48
SALTS = 16


def _md5(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 sum, the same in any SQL engine."""
    return F.conv(F.substring(_md5(*parts), 1, 13), 16, 10).cast("double") / F.lit(16.0**13)


def rates(packed: DataFrame, weights: DataFrame | None = None, budget: float | None = None) -> DataFrame:
    """source and mean repetition rate: target weight times ``budget`` over the source's characters.

    All rows count. Without ``weights`` (source, weight) a source weighs the square root of
    its size; ``budget`` (characters to draw) is the table's own size if not given. A NULL
    source is a source; one without characters has rate 1, one without a weight rate 0.
    """
    sizes = packed.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.pow("chars", F.lit(EVENNESS)))
    else:
        given = weights.select(F.col("source").alias("of"), F.col("weight").cast("double").alias("weight"))
        weighed = sizes.join(given, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").fillna(0.0, ["weight"])
    chars, weight = weighed.agg(F.sum("chars"), F.sum("weight")).first()
    rate = F.col("weight") / F.lit(weight or 1.0) * F.lit(float((chars or 0.0) if budget is None else budget)) / F.col("chars")
    return weighed.select("source", F.when(F.col("chars") > 0, rate).otherwise(F.lit(1.0)).alias("rate"))


def with_tables(rated: DataFrame) -> DataFrame:
    """rate -> parts and cdf: the distribution function of each part's Poisson variable at 0 to 48."""
    parts = F.greatest(F.ceil(F.col("rate") / MEAN_STEP), F.lit(1)).cast("int")
    logs = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(TABLE + 1)])
    steps = F.transform(logs, lambda log, k: F.exp(-F.col("mean") + k * F.ln(F.col("mean")) - log))
    sums = F.transform(F.sequence(F.lit(1), F.lit(TABLE + 1)), lambda n: F.aggregate(
        F.slice(F.col("steps"), F.lit(1), n), F.lit(0.0), lambda a, p: a + p))
    table = rated.withColumn("parts", parts).withColumn("mean", F.col("rate") / F.col("parts"))
    return table.withColumn("steps", steps).withColumn("cdf", sums).drop("steps", "mean")


def replicated(packed: DataFrame, rated: DataFrame, seed: int = SEED) -> DataFrame:
    """Packed rows with ``rate``, ``copies``, ``copy`` (from 1) and ``key``, in the order of ``key``.

    A row's count inverts the Poisson distribution of its source's rate at numbers hashed
    from seed and id, so a recomputed task draws the same copies. Rows meet the stored
    table of rates on (source, salt): Spark broadcasts it where its files are small, and
    where they are not, a source with most of the rows is many keys.
    """
    salted = with_tables(rated).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    salted = materialize(salted, "rates")
    name = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    rows = packed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    rows = rows.join(salted, (rows["salt"] == salted["salt"]) & rows["source"].eqNullSafe(salted["of"])).drop("salt", "of")
    drawn = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(str(seed)), name, j.cast("string")))
    count = F.aggregate(drawn, F.lit(0), lambda a, u: a + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    rows = rows.withColumn("copies", F.when(F.col("rate") > 0, count).otherwise(F.lit(0))).drop("parts", "cdf")
    rows = rows.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    rows = rows.withColumn("key", _md5(F.lit(str(seed)), name, F.lit("copy"), F.col("copy").cast("string")))
    return rows.repartitionByRange("key").sortWithinPartitions("key")


def _packed(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return pack(df, id_col, text_col).withColumn("source", F.col("rest").getField(source_col).cast("string"))


def mix_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: DataFrame | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """One row per copy drawn, in shuffled order: id, source, text, rate, copies, copy, key.

    NULL texts count no characters; NULL ids draw alike, repeated rows as many copies each;
    other columns are not in it; an empty table gives an empty one.
    """
    packed = _packed(df, id_col, text_col, source_col)
    drawn = replicated(packed, rates(packed, weights, budget), seed)
    return drawn.select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("text").alias(text_col), "rate", "copies", "copy", "key")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: DataFrame | None = None, budget: float | None = None, seed: int = SEED) -> DataFrame:
    """The drawn copies as rows with the columns of ``df``, shuffled globally.

    Characters drawn from each source follow its weight in the mean. NULL texts count no
    characters; NULL ids draw alike; repeated rows draw the same number of copies each; an
    empty table gives an empty one.
    """
    packed = _packed(df, id_col, text_col, source_col)
    return unpack(replicated(packed, rates(packed, weights, budget), seed).select("text", "rest"), df, text_col)
