"""Repeated passages by content-defined chunking.

A gear rolling hash of the last 32 bytes is taken at the end of each word. Of every run of 30 words
the smallest value inside it is a cut, so a cut follows from the bytes near it, each run has one, and
an insertion moves none that is further away. The runs with one cut are a chunk, of as many words as
they reach over. Chunks are deduplicated by digests: of the bytes at the cut, by which copies meet,
and of the whole chunk. Where all chunks that meet are equal they are repeated as they stand; the
others, which differ somewhere beyond the cut, are compared run by run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowlens.llm.rows import col
from flowlens.llm.text import POWERS, U64, Words, chunks, mix
from flowlens.session import materialize

WINDOW = 32
MIN_WORDS = 30
GEAR = (mix(np.arange(1, 257, dtype=U64)) >> U64(32)).astype(np.uint32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At every byte, the sum of the gear values of the last 32 bytes, each shifted by its distance."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:  # sums over 1, 2, 4, ... bytes
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """For each run of ``size`` words, the word at whose end the gear hash is smallest, the first in a tie.

    ``start`` and ``end`` are the words' bytes and ``first`` the runs' first words. Only ends with
    32 bytes of the run before them count; a shorter run has its last word.
    """
    last = first + size - 1
    begin = np.minimum(np.searchsorted(end, start[first] + WINDOW), last)
    least, where = gear_hash(data)[end - 1], np.arange(len(end))
    best = np.empty(len(first), np.int64)
    width = 1
    while True:  # smallest of 1, 2, 4, ... ends; two of those ranges cover a run
        level = np.flatnonzero((last - begin + 1 >= width) & (last - begin + 1 < 2 * width))
        left, right = begin[level], last[level] - width + 1
        best[level] = np.where(least[right] < least[left], where[right], where[left])
        if 2 * width > size or len(least) <= width:
            return best
        less = least[width:] < least[:-width]
        least, where = np.where(less, least[width:], least[:-width]), np.where(less, where[width:], where[:-width])
        width *= 2


def cut_digests(data: np.ndarray, end: np.ndarray, run: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hashes of the 32 bytes before each cut's word ``end``; of a run that starts after that, the run's own hash."""
    out = run.copy()
    at = np.flatnonzero(end - start >= WINDOW)
    total = np.zeros(len(at), U64)
    for k in range(WINDOW):
        total += (data[end[at] - 1 - k].astype(U64) + U64(1)) * POWERS[k]
    out[at] = mix(total)
    return out


class Windows:
    """All runs of ``size`` words in some texts, byte for byte from their first word to their last.

    ``word`` numbers the first word within its text, ``doc`` the text, ``start`` and ``end`` are
    bytes of the chunk; ``hash`` is of the whole run, ``place`` the word at its cut and ``anchor``
    the digest of the bytes there.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        words = Words(data, offsets)
        n = len(words.start)
        left = np.repeat(words.first + words.count, words.count) - np.arange(n)
        at = np.flatnonzero(left >= size)
        self.doc, self.word = words.doc[at], at - words.first[words.doc[at]]
        self.start, self.end = words.start[at], words.end[at + size - 1]
        self.hash = self.anchor = np.zeros(0, U64)
        self.place = at
        if not len(at):
            return
        begin = words.start[0]
        place = np.arange(begin, len(data)) - np.repeat(words.start, np.diff(np.append(words.start, len(data))))
        value = mix(data[begin:].astype(U64) + U64(1) + (place.astype(U64) << U64(9)))
        spaced = mix(np.add.reduceat(value, words.start - begin))  # the word and what stands before the next
        edges = np.column_stack([words.start, words.end]).ravel() - begin
        value = np.append(value, U64(0))  # a word may end with the chunk
        plain = mix(np.add.reduceat(value, edges)[::2] + U64(1))
        total = np.zeros(n, U64)
        for k in range(size):
            total[: n - k] += (spaced if k < size - 1 else plain)[k:] * POWERS[k % len(POWERS)]
        self.hash = mix(total + U64(size))[at]
        self.place = cuts(data, words.start, words.end, at, size)
        self.anchor = cut_digests(data, words.end[self.place], self.hash, self.start)


def chunk_table(given: DataFrame, min_words: int) -> DataFrame:
    """The chunks of every text: id, anchor, span, start, length, word, words.

    ``anchor`` is the digest of the bytes at the chunk's cut, ``span`` that of the whole chunk.
    """

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                w = Windows(data, offsets, min_words)
                if not len(w.hash):
                    continue
                new = np.ones(len(w.hash), bool)
                new[1:] = (w.place[1:] != w.place[:-1]) | (w.doc[1:] != w.doc[:-1])
                lo = np.flatnonzero(new)
                count = np.diff(np.append(lo, len(new)))
                hi = lo + count - 1
                step = np.arange(len(new)) - np.repeat(lo, count)
                span = mix(np.add.reduceat(mix(w.hash + step.astype(U64)), lo) + count.astype(U64))
                ids = batch.column("id").slice(first, end - first).take(pa.array(w.doc[lo]))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(w.anchor[lo].view(np.int64)), pa.array(span.view(np.int64)),
                    pa.array((w.start[lo] - offsets[w.doc[lo]]).astype(np.int32)), pa.array((w.end[hi] - w.start[lo]).astype(np.int32)),
                    pa.array(w.word[lo].astype(np.int32)), pa.array((count + min_words - 1).astype(np.int32))],
                    names=["id", "anchor", "span", "start", "length", "word", "words"])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(table, f"id {kind}, anchor long, span long, start int, length int, word int, words int")


def window_table(asked: DataFrame, min_words: int) -> DataFrame:
    """The single runs of those chunks of a text whose ``anchors`` are beside it: id, hash, start, length, word."""

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                w = Windows(data, offsets, min_words)
                wanted = batch.column("anchors").slice(first, end - first)
                bound = np.searchsorted(w.doc, np.arange(len(wanted) + 1))
                keep = np.zeros(len(w.hash), bool)
                for i, (a, b) in enumerate(zip(bound, bound[1:])):
                    keep[a:b] = np.isin(w.anchor[a:b].view(np.int64), wanted[i].values.to_numpy())
                at = np.flatnonzero(keep)
                docs = w.doc[at]
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, end - first).take(pa.array(docs)), pa.array(w.hash[at].view(np.int64)),
                    pa.array((w.start[at] - offsets[docs]).astype(np.int32)), pa.array((w.end[at] - w.start[at]).astype(np.int32)),
                    pa.array(w.word[at].astype(np.int32))],
                    names=["id", "hash", "start", "length", "word"])

    kind = asked.schema["id"].dataType.simpleString()
    return asked.mapInArrow(table, f"id {kind}, hash long, start int, length int, word int")


def _shared(table: DataFrame, key: str, *more) -> DataFrame:
    """The keys that several ids have: key, first_id, copies; stored, as only a join of plain shuffles is split at a hot key."""
    found = table.groupBy(key).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("copies"), *more)
    return materialize(found.filter("first_id != last_id").drop("last_id"), "shared")


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Passages that other documents have too: id, start, length, words, first_id, copies, removed.

    Every run of ``min_words`` words that another document has byte for byte, from the first
    letter to the last; overlapping runs with the same ``first_id`` are one passage, so those of
    different ones may overlap. ``start`` and ``length`` are UTF-8 bytes; ``first_id`` is the
    smallest id that holds each run and ``copies`` how often the first one occurs. ``removed``
    is false in that document, which keeps its text. NULL ids, and texts that are NULL or
    empty, have no passage; repeated rows of one id are one document.
    """
    given = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).filter("id is not null")
    table = materialize(chunk_table(given, min_words), "chunks")
    # where all chunks with one anchor are equal, each run in them is repeated with them
    alike = (F.min("span") == F.max("span")).alias("alike")
    hits = materialize(table.drop("span").join(_shared(table, "anchor", alike), "anchor"), "hits")
    asked = hits.filter("not alike").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    windows = materialize(window_table(given.join(asked, "id"), min_words), "windows")
    parts = ["id", "start", "length", "word", "words", "first_id", "copies"]
    single = windows.join(_shared(windows, "hash"), "hash").withColumn("words", F.lit(min_words))
    pieces = hits.filter("alike").select(*parts).unionByName(single.select(*parts))
    order = Window.partitionBy("id", "first_id").orderBy("word", "words")
    before = F.max(F.col("word") + F.col("words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = pieces.withColumn("gap", F.coalesce(F.col("word") >= before, F.lit(True)).cast("int"))
    runs = runs.withColumn("run", F.sum("gap").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("id", "first_id", "run").agg(
        F.min(F.struct("start", "copies")).alias("first"), F.max(F.col("start") + F.col("length")).alias("end"),
        (F.max(F.col("word") + F.col("words")) - F.min("word")).alias("words"))
    return spans.select(
        F.col("id").alias(id_col), F.col("first.start").alias("start"), (F.col("end") - F.col("first.start")).alias("length"), "words",
        "first_id", F.col("first.copies").alias("copies"), (F.col("id") != F.col("first_id")).alias("removed"))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """id and text of every row, the passages that an earlier document keeps cut out. NULL texts stay NULL."""
    spans = repeated_passages(df, id_col, text_col, min_words).filter("removed").groupBy(id_col).agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                if text is not None and cuts:
                    raw, at, kept = text.encode(), 0, []
                    for c in cuts:
                        kept.append(raw[at : c["start"]])
                        at = max(at, c["start"] + c["length"])
                    text = b"".join([*kept, raw[at:]]).decode()
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    given = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    joined = given.join(spans.withColumnRenamed(id_col, "id"), "id", "left").select("id", "text", "spans")
    kind = given.schema["id"].dataType.simpleString()
    return joined.mapInArrow(strip, f"id {kind}, text string").withColumnsRenamed({"id": id_col, "text": text_col})
