"""Alignment of two tokenizers over the bytes they share, with corpus-wide counts of linked ids.

Inside a task everything is Arrow: lists of ids are flattened with their parent indices,
segmented cumulative sums give byte ends, a hash join on (document, end) keys finds where
both token streams end, and ``Table.group_by`` counts linked ids. Spark merges the counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.rows import col
from flowlens.llm.tokens import byte_entries, pieces, plain_ids
from flowlens.session import scratch_path

CHUNK_CHARS = 1 << 20
BUNDLE_CHARS = 8 << 20
END_BITS = 40
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Vocabularies(NamedTuple):
    """Files of the two tokenizers: byte-level BPE (A) as JSON and as ranks, sentence pieces (B)."""

    a: str
    ranks: str
    b: str


def public_vocabularies() -> Vocabularies:
    return Vocabularies(*map(public_tokenizers.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))


class _Side(NamedTuple):
    entry: pa.Array
    length: pa.Array
    digits: pa.Array


@lru_cache(maxsize=4)
def _sides(files: Vocabularies) -> tuple[_Side, _Side]:
    def side(entries: list[bytes]) -> _Side:
        entry = pa.array(entries, pa.large_binary())
        return _Side(entry, pc.cast(pc.binary_length(entry), pa.int64()), pa.array([str(i) for i in range(len(entries))]))

    return side(byte_entries(files.ranks)), side(pieces(files.b)[1])


def _lists(ids: list) -> pa.ListArray:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    flat = np.concatenate([np.asarray(i, np.int32) for i in ids]) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def _token_ends(ids: pa.ListArray, side: _Side, name: str) -> pa.Table:
    """One row per token: its id and the key (document, end), an end being the bytes up to and with it."""
    flat, parent = pc.list_flatten(ids), pc.cast(pc.list_parent_indices(ids), pa.int64())
    running = pc.cumulative_sum(side.length.take(flat))
    last = np.frombuffer(ids.offsets.buffers()[1], np.int32)[ids.offsets.offset:][: len(ids)] - 1
    before = pa.array(np.where(last >= 0, running.to_numpy()[np.maximum(last, 0)], 0) if len(flat) else np.zeros(len(ids), np.int64))
    end = pc.subtract(running, before.take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent, END_BITS), end), name: flat})


def _runs(values: pa.Array, closes: np.ndarray, separator: str) -> pa.Array:
    """Strings joined up to each position that closes a run."""
    offsets = pa.array(np.append(0, np.flatnonzero(closes) + 1), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, values), separator)


def link(texts: list[str], files: Vocabularies) -> tuple[pa.Table, pa.Table, pa.Array]:
    """Both tokenizers over some texts: documents, distinct linked ids per document, groups as text.

    The first table has COUNTS for each text, the second (doc, pair, n) with pair = A's id
    times 2**32 plus B's. Texts without tokens have zeros, no pairs and the group text ''.
    """
    a_side, b_side = _sides(files)
    a_ids = _lists([plain_ids(" " + t, files.a, files.ranks) if t else [] for t in texts])
    b_ids = _lists(pieces(files.b)[0].encode(texts, num_threads=1) if texts else [])
    wanted = pa.array([b" " + t.encode() for t in texts], pa.large_binary())
    same = pa.array([bool(t) for t in texts], pa.bool_())
    for ids, side in ((a_ids, a_side), (b_ids, b_side)):
        spelled = pc.binary_join(pa.LargeListArray.from_arrays(ids.offsets.cast(pa.int64()), side.entry.take(ids.values)), pa.scalar(b"", pa.large_binary()))
        same = pc.and_(same, pc.equal(spelled, wanted))
    kept = np.flatnonzero(same.to_numpy(zero_copy_only=False))
    counts = {name: np.zeros(len(texts), np.int64) for name in COUNTS}
    groups = np.full(len(texts), "", object)
    if not len(kept):
        none = pa.table({"doc": pa.array([], pa.int64()), "pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        return pa.table(counts), none, pa.array(groups, pa.large_string())
    a_ids, b_ids = a_ids.take(pa.array(kept)), b_ids.take(pa.array(kept))
    counts["n_a"][kept], counts["n_b"][kept] = (pc.list_value_length(ids).to_numpy() for ids in (a_ids, b_ids))

    ends = _token_ends(a_ids, a_side, "a").join(
        _token_ends(b_ids, b_side, "b"), "key", join_type="full outer", use_threads=False)
    key = ends["key"].to_numpy()
    ends = ends.take(pa.array(np.argsort(key, kind="stable"))).combine_chunks()
    a, b = (ends[name].combine_chunks() for name in ("a", "b"))
    has_a, has_b = (pc.is_valid(side).to_numpy(zero_copy_only=False) for side in (a, b))
    closes = has_a & has_b
    doc = pc.shift_right(ends["key"].combine_chunks(), END_BITS).to_numpy()
    # every document ends with a token of both, so the next id never comes from another document
    a_next, b_next = (pc.cast(pc.fill_null_backward(side), pa.int64()) for side in (a, b))
    pair = pc.add(pc.shift_left(a_next, 32), b_next)
    links = pa.table({"doc": kept[doc], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    counts["n_links"][kept] = np.bincount(doc, minlength=len(kept))
    counts["n_groups"][kept] = per_doc = np.bincount(doc[closes], minlength=len(kept))

    sides = [_runs(side.digits.take(ids.drop_null()), closes[has], ",")
             for side, ids, has in ((a_side, a, has_a), (b_side, b, has_b))]
    parts = pc.binary_join_element_wise(*sides, "|").cast(pa.large_string())
    offsets = pa.array(np.append(0, np.cumsum(per_doc)), pa.int64())
    groups[kept] = pc.binary_join(pa.LargeListArray.from_arrays(offsets, parts), pa.scalar(";", pa.large_string())).to_pylist()
    return pa.table(counts), links.rename_columns(["doc", "pair", "n"]), pa.array(groups, pa.large_string())


def _packed(place: np.ndarray, n: np.ndarray) -> bytes:
    """Rising places and their counts as steps, byte plane by byte plane, compressed."""
    steps = np.concatenate([np.diff(place, prepend=0), n]).astype("<u4")
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, links: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(data, decompressed_size=8 * links, codec="zstd", asbytes=True)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(steps[:links]), steps[links:]


STORED = (
    "kind string, bundle long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, "
    "distinct int, links binary, place int, pair long, n long"
)


def _chunks(texts: list[str], most: int) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts with their first place, of up to ``most`` characters or one longer text."""
    first = 0
    while first < len(texts):
        end, size = first + 1, len(texts[first])
        while end < len(texts) and size + len(texts[end]) <= most:
            size += len(texts[end])
            end += 1
        yield first, texts[first:end]
        first = end


def _bundles(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, list[str]]]:
    for batch in batches:
        for first, texts in _chunks([t or "" for t in batch.column(1).to_pylist()], most):
            yield batch.column(0).slice(first, len(texts)), texts


def _first_pass(files: Vocabularies, keep_groups: bool, bundle_chars: int, chunk_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = TaskContext.get().partitionId() << 32
        for ids, texts in _bundles(batches, bundle_chars):
            counts, links, digests, kept = [], [], [], []
            for first, part in _chunks(texts, chunk_chars):
                table, found, groups = link(part, files)
                counts.append(table)
                links.append(found.set_column(0, "doc", pc.add(found["doc"], first)))
                strings = groups.to_pylist()
                digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in strings]
                if keep_groups:
                    kept += strings
            counts, links = pa.concat_tables(counts), pa.concat_tables(links)
            pairs = links.group_by("pair", use_threads=False).aggregate([("n", "sum")])
            code, total = pairs["pair"].to_numpy(), pairs["n_sum"].to_numpy()
            rank = np.lexsort((code, -total))  # frequent pairs first: small steps between a document's places
            code, total = code[rank], total[rank]
            order = np.argsort(code)
            place = order[np.searchsorted(code, links["pair"].to_numpy(), sorter=order)] if len(code) else np.zeros(0, np.int64)
            doc, n = links["doc"].to_numpy(), links["n"].to_numpy()
            by = np.lexsort((place, doc))
            doc, place, n = doc[by], place[by], n[by]
            bound = np.searchsorted(doc, np.arange(len(texts) + 1))
            packed = [_packed(place[x:y], n[x:y]) if y > x else None for x, y in zip(bound, bound[1:])]
            size, here = len(texts), pa.repeat(pa.scalar(bundle, pa.int64()), len(texts))
            none = pa.nulls(size, pa.int64())
            yield pa.RecordBatch.from_arrays([
                ids, pa.repeat("doc", size), here, *(counts[c].combine_chunks() for c in COUNTS), pa.array(digests, pa.string()),
                pa.array(kept, pa.string()) if keep_groups else pa.nulls(size, pa.string()),
                pa.array(np.diff(bound), pa.int32()), pa.array(packed, pa.binary()), none.cast(pa.int32()), none, none,
            ], names=NAMES)
            for at in range(0, len(code), 100_000):
                size = len(code[at : at + 100_000])
                none, text = pa.nulls(size, pa.int64()), pa.nulls(size, pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.nulls(size, ids.type), pa.repeat("pair", size), pa.repeat(pa.scalar(bundle, pa.int64()), size),
                    none, none, none, none, text, text, none.cast(pa.int32()), pa.nulls(size, pa.binary()),
                    pa.array(np.arange(at, at + size), pa.int32()), pa.array(code[at : at + size]), pa.array(total[at : at + size]),
                ], names=NAMES)
            bundle += 1

    return run


NAMES = ["id", *(field.split()[0] for field in STORED.split(", "))]


class Alignment(NamedTuple):
    """``documents``: one row per row given; ``pairs``: a_id, b_id, links and whether no A id has more links with b_id."""

    documents: DataFrame
    pairs: DataFrame


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    order = np.argsort(right["place"].to_numpy())
    total, best = right["total"].to_numpy()[order], right["best"].to_numpy()[order]
    n_best, count_sum = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
    for row, (data, distinct) in enumerate(zip(left["links"], left["distinct"].to_numpy())):
        if distinct:
            place, n = _unpacked(data.as_py(), int(distinct))
            n_best[row] = n[best[place]].sum()
            count_sum[row] = (n * total[place]).sum()
    out = left.drop_columns(["bundle", "distinct", "links"])
    return out.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))


def align(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: Vocabularies | None = None, keep_groups: bool = False,
    bundle_chars: int = BUNDLE_CHARS, chunk_chars: int = CHUNK_CHARS,
) -> Alignment:
    """Tokens of A and B of each text, cut into groups where both end, and their links by overlapping bytes.

    ``documents`` has the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, with
    ``keep_groups``, ``groups``: ``a1,a2|b1;a3|b2,b3``. NULL and empty texts, and texts that a
    tokenizer does not spell byte for byte, have no tokens: zeros and ''. Repeated rows and
    rows without an id each give a row, and each counts. Other columns are not read. An
    empty table gives two empty ones.

    Texts are read once. Each task counts distinct pairs over bundles of some megabytes, so a pair meets
    its corpus-wide count as often as there are bundles, not documents; rows of one pair are at
    most one per bundle, rows of one B id at most as many as A has ids. The counts go back to
    their bundle, where a document keeps its links as steps between places in the bundle's list.
    """
    files = files or public_vocabularies()
    spark = df.sparkSession
    given = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    path = scratch_path(spark, "alignment")
    first = given.mapInArrow(_first_pass(files, keep_groups, bundle_chars, chunk_chars), f"id {kind}, {STORED}")
    first.write.partitionBy("kind").option("compression", "zstd").parquet(path)
    documents, bundled = (spark.read.schema(first.schema).parquet(path).where(F.col("kind") == k) for k in ("doc", "pair"))
    bundled = bundled.select("bundle", "place", "pair", "n")
    counted = bundled.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b_id", F.col("pair").bitwiseAND(0xFFFFFFFF))
    top = counted.groupBy("b_id").agg(F.max("total").alias("top"))
    pairs = counted.join(top, "b_id").select(
        "pair", F.shiftright("pair", 32).cast("int").alias("a_id"), F.col("b_id").cast("int"),
        F.col("total").alias("links"), (F.col("total") == F.col("top")).alias("best"))
    known = bundled.join(pairs, "pair").select("bundle", "place", F.col("links").alias("total"), "best")
    text = ["groups"] if keep_groups else []
    scored = documents.select("bundle", "id", *COUNTS, "groups_sha256", *text, "distinct", "links").groupBy("bundle").cogroup(
        known.groupBy("bundle")).applyInArrow(
            _finish, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
            + ("groups string, " if keep_groups else "") + "n_best long, count_sum long")
    return Alignment(scored.withColumnRenamed("id", id_col), pairs.drop("pair"))

