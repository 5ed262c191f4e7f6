"""URL filter by the ratio of two character language models, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.rows import col
from flowlens.session import materialize

ORDER = 5
STRENGTH = 4.0
CALIBRATION_SHARE = 4
ALPHABET = 97
SCORE_STEP = 0.001
#: (verdict, host, path prefix)
RULES = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    found = F.coalesce(url.contains("://"), F.lit(False))
    return F.when(found, host).otherwise(F.lit("")), F.when(found, path).otherwise(F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (``host`` and path prefix) and its verdict; NULL where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(prefix)
        name = F.when(fits, F.lit(at + prefix)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def contexts(text: Column) -> Column:
    """Each character of a text with the ``ORDER - 1`` before it; the text is preceded by marks and ends in one."""
    pad = F.concat(F.lit("\x02" * (ORDER - 1)), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(pad, i, F.lit(ORDER)))


def log_ratios(train: DataFrame, grams: DataFrame) -> DataFrame:
    """gram -> log of its last character's probability in accepted over that in rejected URLs.

    ``train`` has gram, good and bad counts. In each class the estimate of order k mixes
    the count with ``STRENGTH`` times that of order k - 1, from uniform upwards, as far as
    the context was seen; orders meet on equi-joins of distinct grams, none is broadcast.
    """
    table = grams.select("gram").distinct().withColumn("good", F.lit(1.0 / ALPHABET)).withColumn("bad", F.lit(1.0 / ALPHABET))
    for k in range(1, ORDER + 1):
        tail = F.substring(F.col("gram"), ORDER - k + 1, k)
        seen = train.groupBy(tail.alias("tail")).agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
        whole = train.groupBy(F.substring(F.col("gram"), ORDER - k + 1, k - 1).alias("context")).agg(
            F.sum("good").alias("gc"), F.sum("bad").alias("bc"))
        table = table.withColumn("tail", tail).withColumn("context", F.substring(F.col("gram"), ORDER - k + 1, k - 1))
        table = table.join(seen, "tail", "left").join(whole, "context", "left").fillna(0.0, ["g", "b", "gc", "bc"])
        table = table.select("gram", *[
            ((F.col(n) + STRENGTH * F.col(p)) / (F.col(c) + STRENGTH)).alias(p) for p, n, c in (("good", "g", "gc"), ("bad", "b", "bc"))])
    return table.select("gram", F.ln(F.col("good") / F.col("bad")).alias("ratio"))


def threshold(scored: DataFrame) -> float:
    """The score above which calibration URLs are accepted with the smallest mean of both error shares.

    Scores are counted in steps of a thousandth, so the sums run over at most some
    thousand steps. 0 where either class is missing.
    """
    steps = scored.groupBy(F.floor(F.col("score") / SCORE_STEP).alias("step")).agg(
        F.sum(F.expr("double(verdict = 'allow')")).alias("good"), F.sum(F.expr("double(verdict = 'block')")).alias("bad")).orderBy("step").toPandas()
    good, bad = steps["good"].sum(), steps["bad"].sum()
    if not good or not bad:
        return 0.0
    # refuse all steps up to this one: accepted URLs lost, rejected URLs kept
    error = steps["good"].cumsum() / good + 1 - steps["bad"].cumsum() / bad
    if error.min() >= 1:
        return 0.0
    at = int(error.idxmin())
    following = steps["step"].iloc[at + 1] if at + 1 < len(steps) else steps["step"].iloc[at] + 2
    return float((steps["step"].iloc[at] + 1 + following) / 2 * SCORE_STEP)


def url_key(url: Column) -> Column:
    """A 128-bit digest, which stands for a URL of any length beside each of its grams."""
    return F.unhex(F.md5(url.cast("binary")))


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """id, host, path, rule, verdict, score of every row.

    URLs that a rule accepts and rejects train the two models; a fourth of them, by hash,
    is kept back and calibrates the limit of the length-normalised log-likelihood
    difference. A rule's verdict stands; other URLs are allowed above the limit. NULL urls
    count as empty text for the score. Repeated rows and NULL ids are judged like others.
    With no rule-accepted or no rule-rejected URL the limit is 0.
    """
    host, path = host_and_path(F.col("url"))
    pages = df.select(col(id_col).alias("id"), col(url_col).cast("string").alias("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", name).withColumn("ruled", verdict)
    urls = rows.select(F.coalesce("url", F.lit("")).alias("url"), F.col("ruled").alias("verdict")).groupBy("url").agg(
        F.first("verdict").alias("verdict"), F.count(F.lit(1)).cast("double").alias("n"))
    urls = urls.withColumn("key", url_key(F.col("url"))).withColumn("held", F.pmod(F.xxhash64("url", F.lit(5)), F.lit(CALIBRATION_SHARE)) == 0)
    urls = materialize(urls.withColumn("grams", contexts(F.col("url"))), "urls")
    grams = urls.select(F.explode("grams").alias("gram"), "verdict", "held", "n")
    taught = materialize(grams.groupBy("gram").agg(*[
        F.sum(F.when((F.col("verdict") == v) & ~F.col("held"), F.col("n")).otherwise(0.0)).alias(c) for v, c in (("allow", "good"), ("block", "bad"))]), "grams")
    ratios = materialize(log_ratios(taught.filter("good > 0 or bad > 0"), taught), "ratios")
    summed = urls.select("key", F.explode("grams").alias("gram")).groupBy("key", "gram").count().join(ratios, "gram").groupBy("key").agg(
        (F.sum(F.col("count") * F.col("ratio")) / F.sum("count")).alias("score"))
    scored = materialize(urls.select("key", "verdict", "held").join(summed, "key"), "scores")
    limit = threshold(scored.filter("held and verdict is not null"))
    judged = rows.withColumn("key", url_key(F.coalesce("url", F.lit("")))).join(scored.select("key", "score"), "key")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("score") > limit, F.lit("allow")).otherwise(F.lit("block"))).alias("verdict"), "score")
