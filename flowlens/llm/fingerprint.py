"""I-Match fingerprints over randomised subsets of a lexicon, in SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.rows import col
from flowlens.llm.warc import bucket_of
from flowlens.session import materialize

#: Terms share 2**18 hash classes; a class is in the lexicon if its document frequency is in the band.
CLASSES = 1 << 18
#: The band, as natural logarithms of documents over the documents with a class.
LEAST_IDF, MOST_IDF = math.log(10), 12.0
#: (ways a level deals the lexicon out, how many of those subsets are used), coarse to fine.
LEVELS = ((1, 1), (16, 16), (256, 48), (4096, 48))
SUBSETS = sum(used for _, used in LEVELS)
LEAST_FILLED = 8
BUCKET_CHARS = 16_000_000
MOST_BUCKETS = 10_000
HASH_BITS = (1 << 44) - 1
NOT_A_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The distinct terms' hashes: lower-cased runs of letters and digits."""
    words = F.array_distinct(F.split(F.lower(text), NOT_A_TERM))
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def term_class(term: Column) -> Column:
    return F.pmod(term, F.lit(CLASSES))


def lexicon(texts: DataFrame, documents: int) -> Column:
    """One byte per term class, 1 where the class's inverse document frequency is in the band.

    Document frequencies are over all documents and the band is of their shares, so a table
    and its copies have one lexicon. The literal has a fixed size; counts are stored, as they are
    read again for every limit.
    """
    classes = F.explode(F.array_distinct(F.transform(terms(F.col("text")), term_class))).alias("class")
    counts = materialize(texts.select(classes).groupBy("class").count(), "term-classes")
    least, most = documents * math.exp(-MOST_IDF), documents * math.exp(-LEAST_IDF)
    kept = counts.filter((F.col("count") >= least) & (F.col("count") <= max(most, 1))).select("class").collect()
    flags = bytearray(CLASSES)
    for (c,) in kept:
        flags[c] = 1
    return F.lit(bytes(flags))


def in_lexicon(found: Column, flags: Column) -> Column:
    return F.filter(found, lambda t: F.substring(flags, (term_class(t) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01"))


def _deal(term: Column, ways: int) -> Column:
    return F.pmod(F.shiftright(term, 20), F.lit(ways))


def _dealt(inside: Column, ways: int, used: int) -> Column:
    return inside if ways == used else F.filter(inside, lambda t: _deal(t, ways) < used)


def _entry(ways: int, base: int):
    """The subset's number above 44 bits of the term's hash, the lowest of them set."""
    return lambda t: F.shiftleft(_deal(t, ways) + base, 44).bitwiseOR(t.bitwiseAND(HASH_BITS)).bitwiseOR(F.lit(1))


def subset_hashes(inside: Column) -> Column:
    """Hashes of the sorted distinct lexicon terms of every subset, 64 bits of the first, 16 of the others; NULL where a subset has none.

    A term is in subset s of a level when its hash deals it there; marks for every subset
    are sorted in before its terms, so one sort of numbers and one split serve all subsets.
    """
    entries, base = [], 0
    for ways, used in LEVELS:
        entries.append(F.transform(_dealt(inside, ways, used), _entry(ways, base)))
        base += used
    marks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(SUBSETS - 1).cast("long")), lambda s: F.shiftleft(s, 44))
    marked = F.sort_array(F.concat(*entries, marks))
    shown = F.transform(marked, lambda e: F.when(e.bitwiseAND(HASH_BITS) == 0, F.lit(";")).otherwise(F.concat(e.cast("string"), F.lit(","))))
    parts = F.slice(F.split(F.array_join(shown, ""), ";"), 2, SUBSETS)
    return F.transform(parts, lambda p, i: F.when(p != "", F.when(i == 0, F.xxhash64(p)).otherwise(F.pmod(F.xxhash64(p), F.lit(65_536)))))


def with_hashes(df: DataFrame, text_col: str, out: str, flags: Column) -> DataFrame:
    """Adds the subset hashes of a text. Without lexicon terms, the first is of all its terms, or of the text."""
    split = df.withColumn("all_terms", terms(F.col(text_col)))
    split = split.withColumn("inside", in_lexicon(F.col("all_terms"), flags)).withColumn(out, subset_hashes(F.col("inside")))
    rest = F.xxhash64(F.when(F.size("all_terms") > 0, F.array_join(F.sort_array("all_terms"), ",")).otherwise(F.col(text_col)))
    whole = F.coalesce(F.element_at(F.col(out), 1), rest)
    return split.withColumn(out, F.concat(F.array(whole), F.slice(F.col(out), 2, SUBSETS - 1))).drop("all_terms", "inside")


def fingerprint_text(hashes: Column) -> Column:
    """Sixteen hex digits of the hash of all lexicon terms, then four per subset, or four dashes for one without terms."""
    digits = lambda h, i: F.lpad(F.hex(h), F.when(i == 0, 16).otherwise(4), F.lit("0"))
    return F.array_join(F.transform(hashes, lambda h, i: F.when(h.isNull(), F.lit("----")).otherwise(digits(h, i))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal subset hashes, at the finest level where either text fills eight subsets.

    Equal first hashes, of all lexicon terms, give 1.
    """
    start, value = 2, None
    for _, used in LEVELS[1:]:
        pairs = F.zip_with(F.slice(a, start, used), F.slice(b, start, used), lambda x, y: F.when(
            x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce(x == y, F.lit(False))))
        filled = F.filter(pairs, lambda p: p.isNotNull())
        equal = F.size(F.filter(filled, lambda p: p))
        share = F.when(F.size(filled) > 0, equal / F.size(filled)).otherwise(F.lit(0.0))
        value = share if value is None else F.when(F.size(filled) >= LEAST_FILLED, share).otherwise(value)
        start += used
    return F.when(F.element_at(a, 1) == F.element_at(b, 1), F.lit(1.0)).otherwise(value)


def _buckets(texts: DataFrame, documents: int, chars: int) -> list[int]:
    """Ids that cut the documents into runs of about ``BUCKET_CHARS``; at most 10,000 of them."""
    count = min(MOST_BUCKETS, max(1, chars // BUCKET_CHARS), max(1, documents))
    if count < 2:
        return []
    shares = [k / count for k in range(1, count)]
    found = texts.agg(F.percentile_approx("id", shares, 100_000)).first()[0] or []
    return sorted(set(found))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text are.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    The next document is that with the next smaller id, after the last the first; NULL ids
    come last, and rows of one id follow by their text. NULL counts as empty. Texts are
    dealt out once, in runs of ids; a run's last text meets the first of the next run, which
    travels twice. A single row is its own next. An empty table gives an empty result.
    """
    texts = df.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text"))
    documents, chars = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    flags = lexicon(texts, documents)
    bounds = _buckets(texts, documents, chars)
    buckets = len(bounds) + 1
    own = texts.withColumn("bucket", bucket_of(F.col("id"), bounds))
    order = (F.col("id").isNotNull(), F.col("id"), F.col("text"))
    # a bucket without rows has no first row: the next bucket that has one takes its place
    filled = [r[0] for r in own.groupBy("bucket").agg(F.count(F.lit(1))).select("bucket").orderBy(F.desc("bucket")).collect()]
    heads = own.groupBy("bucket").agg(F.max("id").alias("id"))
    follows = {b: filled[(k + 1) % len(filled)] for k, b in enumerate(filled)}
    before = {v: k for k, v in follows.items()}
    place = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None)
    first = own.join(F.broadcast(heads.withColumnRenamed("id", "head")), "bucket").filter(F.col("id").eqNullSafe(F.col("head")))
    first = first.groupBy("bucket", "id").agg(F.max("text").alias("text"))
    extra = first.select("id", "text", F.element_at(place, F.col("bucket")).alias("bucket"), F.lit(True).alias("extra")) if before else None
    rows = own.select("id", "text", "bucket", F.lit(False).alias("extra"))
    rows = rows.unionByName(extra) if extra is not None else rows
    rows = with_hashes(rows, "text", "hashes", flags)
    run = Window.partitionBy("bucket").orderBy("extra", F.desc_nulls_last("id"), F.desc("text"))
    near = rows.withColumn("next_text", F.lead("text").over(run)).withColumn("next_hashes", F.lead("hashes").over(run)).filter("not extra")
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), size - half), F.substring(F.col("next_text"), F.lit(1), half))
    near = with_hashes(near.withColumn("edited", edited), "edited", "edited_hashes", flags)
    return near.select(
        F.col("id").alias(id_col), size.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("hashes")).alias("fingerprint"), fingerprint_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
