"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, StructField, StructType

from flowlens.llm.rows import col, pack, unpack
from flowlens.llm.text import U64, Words, chunks, counted, mix, to_binary16
from flowlens.session import materialize

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 10, 4
COUNTERS = 1 << 18
IDF_GAIN = 0.1
FILTER_BITS = 1 << 22
_GAMMA_LEVELS, _LOG_LEVELS = 1 << 12, 1 << 16


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of Gamma(2, 1), and logarithms of such quantiles at finer steps near zero."""
    grid = np.linspace(0, 40, 400_001)
    cdf = 1 - np.exp(-grid) * (1 + grid)
    gamma = np.interp((np.arange(_GAMMA_LEVELS) + 0.5) / _GAMMA_LEVELS, cdf, grid)
    fine = np.interp((np.arange(_LOG_LEVELS) + 0.5) / _LOG_LEVELS, cdf, grid)
    return gamma.astype(np.float32), np.log(fine).astype(np.float32)


def _nodes(words: Words, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Content keys: of the word sequence, or of the bytes where a text has no word."""
    hi, lo = words.sequence_keys()
    for i in np.flatnonzero(words.count == 0):
        digest = hashlib.sha256(b"no word:" + data[offsets[i] : offsets[i + 1]].tobytes()).digest()
        hi[i], lo[i] = np.frombuffer(digest[:16], ">u8")
    return hi, lo


def counter_sums(df: DataFrame, text_col: str, size: int = WORDS, counters: int = COUNTERS) -> np.ndarray:
    """In how many texts of ``df`` the shingles of each of ``counters`` hash classes occur; last entry: texts.

    Every text counts. The result has a fixed size whatever the table's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(counters + 1, np.int64)
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(0)):
                values, docs = Words(data, offsets).shingles(size)
                values, _, _ = counted(values, docs)
                sums[:-1] += np.bincount((values & U64(counters - 1)).astype(np.int64), minlength=counters)
                sums[-1] += end - first
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["slot", "n"])

    rows = df.select(col(text_col).cast("string")).mapInArrow(count, "slot long, n long")
    total = rows.groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros(counters + 1, np.int64)
    sums[total["slot"].to_numpy(int)] = total["n"].to_numpy(int)
    return sums


def shingle_weights(sums: np.ndarray, gain: float = IDF_GAIN) -> np.ndarray:
    """Inverse document frequency of each hash class: 1 for a shingle in every text up to 1 + gain.

    A class is shared by unrelated shingles, so what such sharing alone explains (its mean
    and four standard deviations) is taken off first; only frequent shingles stand out.
    """
    texts = max(2, int(sums[-1]))
    base = np.median(sums[:-1])
    frequency = np.maximum(1, sums[:-1] - base - 4 * np.sqrt(base + 1))
    return (1 + gain * np.log(texts / np.minimum(frequency, texts)) / np.log(texts)).astype(np.float32)


class Sampler:
    """ICWS of weighted sets: k samples each, combined into band keys."""

    def __init__(self, weights: np.ndarray, bands: int = BANDS, rows: int = ROWS):
        self.weights, self.bands, self.rows = weights, bands, rows
        self.gamma, self.log_gamma = _tables()

    def weigh(self, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights[(values & U64(len(self.weights) - 1)).astype(np.int64)] * counts.astype(np.float32)

    def band_keys(self, values: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        """One key per set and band; ``first`` are the sets' first elements, none of them empty."""
        log_weight = np.log(self.weigh(values, counts))
        size = np.diff(np.append(first, len(values)))
        keys = np.zeros((len(first), self.bands), U64)
        for k in range(self.bands * self.rows):
            h = (values ^ U64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U64(0xBF58476D1CE4E5B9)
            h ^= h >> U64(29)
            h *= U64(0x94D049BB133111EB)
            r = self.gamma[(h >> U64(52)).astype(np.int32)]
            log_c = self.log_gamma[((h >> U64(36)) & U64(_LOG_LEVELS - 1)).astype(np.int32)]
            beta = ((h >> U64(12)) & U64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
            level = np.floor(log_weight / r + beta)
            a = log_c - r * (level - beta + np.float32(1))
            least = np.minimum.reduceat(a, first)
            # the sample is the element with its level; equal values of a break by the smallest hash
            hit = a == np.repeat(least, size)
            at = np.flatnonzero(hit)
            sample = mix(values[at] + level[at].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15))
            owner = np.searchsorted(first, at, "right") - 1
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            band = k // self.rows
            keys[:, band] = mix(keys[:, band] * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(sample, start))
        return keys ^ mix(np.arange(1, self.bands + 1, dtype=U64))[None, :]


def sketches(df: DataFrame, id_col: str, text_col: str, sampler, size: int = WORDS) -> DataFrame:
    """id, node (16-byte content key) and bands (empty where a text has no word) of every text."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        icws = sampler.value
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                hi, lo = _nodes(words, data, offsets)
                values, docs, counts = counted(*words.shingles(size))
                has = np.flatnonzero(words.count)
                bands = icws.band_keys(values, counts, np.searchsorted(docs, has)) if len(has) else np.zeros((0, icws.bands), U64)
                ends = np.cumsum(np.where(words.count > 0, icws.bands, 0))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(0, ends).astype(np.int32)), pa.array(bands.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(first, end - first), to_binary16(hi, lo), lists], names=["id", "node", "bands"])

    given = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(sketch, f"id {kind}, node binary, bands array<long>")


def _filter_bit(node: str = "node"):
    """The last 22 bits of a node, as ``_bits`` takes them from its low half."""
    return (F.conv(F.hex(F.substring(node, 14, 3)), 16, 10).cast("int")).bitwiseAND(FILTER_BITS - 1)


def _bits(lo: np.ndarray) -> np.ndarray:
    return (lo & U64(FILTER_BITS - 1)).astype(np.int64)


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """Which hash classes hold a node of interest: a fixed number of bits, so a bounded broadcast.

    It only spares rows that cannot match a shuffle; the join that follows decides.
    """
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    words = nodes.select(_filter_bit().alias("bit")).groupBy(F.expr("bit div 32").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, bit % 32)")).alias("bits")).toPandas()
    bits.view(np.uint32)[words["word"].to_numpy(int)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(bits, bitorder="little").view(bool)


def profiles(df: DataFrame, text_col: str, nodes: DataFrame, sampler, size: int) -> DataFrame:
    """node, values and weights (its distinct shingles) of the given nodes; stored.

    Only texts of those nodes, and the few that share a bit with one, leave their scan.
    """
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(nodes))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        icws = sampler.value
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                hi, lo = _nodes(words, data, offsets)
                keep = np.flatnonzero(bits.value[_bits(lo)] & (words.count > 0))
                keep = keep[np.sort(np.unique(lo[keep], return_index=True)[1])]
                values, docs = words.shingles(size)
                wanted = np.zeros(end - first, bool)
                wanted[keep] = True
                values, docs, counts = counted(values[wanted[docs]], docs[wanted[docs]])
                bound = pa.array(np.append(np.searchsorted(docs, keep), len(docs)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    to_binary16(hi[keep], lo[keep]), pa.ListArray.from_arrays(bound, pa.array(values.view(np.int64))),
                    pa.ListArray.from_arrays(bound, pa.array(icws.weigh(values, counts)))], names=["node", "values", "weights"])

    found = df.select(col(text_col).cast("string").alias("text")).mapInArrow(
        profile, "node binary, values array<long>, weights array<float>")
    return materialize(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "profiles")


def verified(pairs: DataFrame, profiled: DataFrame, per_list: int = 500) -> DataFrame:
    """``pairs`` (leader, node) with ``sim``, their weighted Jaccard similarity; stored.

    A leader's members are split into lists of about ``per_list``, so a leader of any
    number of members is no task's burden alone.
    """
    many = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / per_list).cast("int").alias("lists"))
    member = pairs.join(many, "leader").select(
        "leader", "node", F.pmod(F.xxhash64("node", F.lit(7)), "lists").cast("int").alias("list"))
    heads = many.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0), F.col("lists") - 1)).alias("list"))
    rows = member.unionByName(heads).join(profiled, "node").withColumn("member", F.col("leader") != F.col("node"))
    lists = rows.repartition("leader", "list").sortWithinPartitions("leader", "list", "member")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, None
        for batch in batches:
            leaders, nodes = batch.column("leader").to_pylist(), batch.column("node").to_pylist()
            values, weights = batch.column("values"), batch.column("weights")
            bound = values.offsets.to_numpy() - values.offsets[0].as_py()
            flat, heavy = values.flatten().to_numpy().view(U64), weights.flatten().to_numpy().astype(np.float64)
            out = []
            for i, (a, b) in enumerate(zip(leaders, nodes)):
                v, w = flat[bound[i] : bound[i + 1]], heavy[bound[i] : bound[i + 1]]
                if a == b:
                    leader, own = a, (v, w, w.sum())
                    continue
                if leader != a:
                    raise ValueError("a list came without its leader")
                at = np.searchsorted(own[0], v)
                at[at == len(own[0])] = 0
                both = own[0][at] == v
                common = np.minimum(own[1][at[both]], w[both]).sum()
                out.append((a, b, float(common / (own[2] + w.sum() - common))))
            a, b, s = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(s, pa.float64())], names=["leader", "node", "sim"])

    given = lists.select("leader", "node", "values", "weights")
    return materialize(given.mapInArrow(verify, "leader binary, node binary, sim double"), "similarities")


def weight_bounds(busy: DataFrame, profiled: DataFrame) -> DataFrame:
    """node, whole and open: its weight, and that of the shingles some node of another class here has too.

    What a node shares with no other class cannot be common to a pair that would join two
    classes, so common <= least of the open weights and union >= each whole weight plus the
    other's closed one. Independent edits of one text close most such pairs at once.
    """
    comps = busy.select("node", "comp").distinct()
    exploded = profiled.join(comps, "node").select("node", "comp", F.explode(F.arrays_zip("values", "weights")).alias("e"))
    exploded = exploded.select("node", "comp", F.col("e.values").alias("value"), F.col("e.weights").cast("double").alias("weight"))
    shared = exploded.groupBy("value").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 != c2").select("value")
    opened = exploded.join(shared, "value").groupBy("node").agg(F.sum("weight").alias("open"))
    whole = exploded.groupBy("node").agg(F.sum("weight").alias("whole"))
    return materialize(whole.join(opened, "node").select("node", "whole", "open"), "bounds")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every linked node: the smallest node it is connected with.

    Each round every node takes the smallest label among its neighbours' and then its
    label's own label, so chains shorten by halves; labels are stored between rounds.
    """
    both = links.select(F.col("leader").alias("a"), F.col("node").alias("b"))
    both = materialize(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("m"))
        low = labels.join(near.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        jump = low.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = materialize(low.join(jump, "comp", "left").select(
            "node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp")), "labels")
        changed = new.filter("comp != old").limit(1).count()
        labels = new.select("node", "comp")
        if not changed:
            return labels


def _mixed(busy: DataFrame) -> DataFrame:
    """Entries of buckets that hold more than one class."""
    several = busy.groupBy("band").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 != c2")
    return busy.join(several.select("band"), "band")


def common_weights(values: list[np.ndarray], weights: list[np.ndarray], split: int, columns: int = 4096) -> np.ndarray:
    """Weights that each of the first ``split`` sets has in common with each of the others.

    The lesser of two weights is a sum over levels, the rising distinct weights of one element,
    of those steps both reach; so the matrix is a product of two matrices of zeros and ones
    with the steps between them, taken ``columns`` levels at a time.
    """
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    value, weight = np.concatenate(values), np.concatenate(weights).astype(float)
    order = np.lexsort((weight, value))
    row, value, weight = row[order], value[order], weight[order]
    fresh = np.append(True, value[1:] != value[:-1]) if len(value) else np.zeros(0, bool)
    rises = fresh | (np.diff(weight, prepend=0) != 0)
    level = np.cumsum(rises) - 1
    step = np.where(fresh, weight, np.diff(weight, prepend=0))[rises]
    lowest = level[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    times = level - lowest + 1
    row = np.repeat(row, times)
    level = np.repeat(lowest, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    here = np.bincount(level[row < split], minlength=len(step)) > 0
    there = np.bincount(level[row >= split], minlength=len(step)) > 0
    number = np.where(here & there, np.cumsum(here & there) - 1, -1)
    row, level, step = row[number[level] >= 0], number[level[number[level] >= 0]], step[here & there]
    order = np.argsort(level, kind="stable")
    row, level = row[order], level[order]
    common = np.zeros((split, len(values) - split))
    for first in range(0, len(step), columns):
        a, b = np.searchsorted(level, (first, first + columns))
        part = np.zeros((len(values), min(columns, len(step) - first)))
        part[row[a:b], level[a:b] - first] = 1
        common += (part[:split] * step[first : first + columns]) @ part[split:].T
    return common


def _forest(pairs: list[tuple[bytes, bytes, int]]) -> list[int]:
    """The last entries of those pairs of classes that a spanning forest needs."""
    parent: dict[bytes, bytes] = {}

    def top(c: bytes) -> bytes:
        while parent.get(c, c) != c:
            parent[c] = c = parent.get(parent[c], parent[c])
        return c

    kept = []
    for a, b, at in pairs:
        a, b = top(a), top(b)
        if a != b:
            parent[a] = b
            kept.append(at)
    return kept


def block_links(busy: DataFrame, profiled: DataFrame, threshold: float, nodes: int = 1024, weight: float = 2e6) -> DataFrame:
    """Links (leader, node) that join classes: a spanning forest of those in each pair of blocks; stored.

    ``busy`` has band, node, comp and whole. In each bucket the nodes outside its largest class
    meet all its nodes, block against block: a block has about ``nodes`` nodes or the given
    weight, and a task sees two. Every pair of different classes in a bucket is compared, but
    none of them is a row; a node is sent once per block it meets.
    """
    per_class = busy.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum("whole").alias("w"))
    per_band = per_class.groupBy("band").agg(
        F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("w").alias("w"),
        F.max(F.struct("n", "comp", "w")).alias("most"))

    def blocks(n, w):
        return F.greatest(F.ceil(n / nodes), F.ceil(w / weight), F.lit(1)).cast("int")

    per_band = per_band.select(
        "band", "main", blocks(F.col("n"), F.col("w")).alias("whole_blocks"),
        blocks(F.col("n") - F.col("most.n"), F.col("w") - F.col("most.w")).alias("few_blocks"))
    placed = busy.select("band", "node", "comp").join(per_band, "band")

    def dealt(salt: int, count: str):
        return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count)).cast("int")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    few = placed.filter("comp != main").select(
        "band", "node", "comp", F.lit(True).alias("few"), dealt(11, "few_blocks").alias("i"), every("whole_blocks").alias("j"))
    whole = placed.select(
        "band", "node", "comp", F.lit(False).alias("few"), dealt(12, "whole_blocks").alias("j"), every("few_blocks").alias("i"))
    met = few.unionByName(whole).join(profiled, "node")

    def compare(block: pa.Table) -> pa.Table:
        few = block["few"].to_numpy()
        order, split = np.argsort(~few, kind="stable"), int(few.sum())
        node, comp = (block[c].take(pa.array(order)).to_pylist() for c in ("node", "comp"))
        lists = [block[c].take(pa.array(order)).combine_chunks() for c in ("values", "weights")]
        values, weights = ([x.values.to_numpy() for x in column] for column in lists)
        out = []
        if 0 < split < len(order):
            common = common_weights(values, weights, split)
            total = np.array([w.sum(dtype=float) for w in weights])
            near = common >= (threshold - 1e-9) * (total[:split, None] + total[None, split:] - common)
            number = np.unique(np.array(comp, "S16"), return_inverse=True)[1]
            a, b = np.nonzero(near & (number[:split, None] != number[None, split:]))
            _, first = np.unique(number[a] * len(order) + number[split + b], return_index=True)
            a, b = a[first], b[first] + split
            out = [(node[a[at]], node[b[at]]) for at in _forest([(comp[x], comp[y], k) for k, (x, y) in enumerate(zip(a, b))])]
        leader, other = zip(*out) if out else ((), ())
        return pa.table({"leader": pa.array(leader, pa.binary()), "node": pa.array(other, pa.binary())})

    found = met.groupBy("band", "i", "j").applyInArrow(compare, "leader binary, node binary")
    return materialize(found.distinct(), "links")


def near_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): id and node of every row, and node, comp of every node with a near-duplicate.

    Copies with the same words are one node. Nodes that share a band of ICWS samples are
    candidates. First the node of a bucket that is met most often elsewhere is compared with
    the others, which settles copies around one centre at one comparison each. In buckets
    that still hold several classes, every pair of different classes is compared block by
    block, but for nodes that ``weight_bounds`` shows to be in no further link.

    NULL ids and repeated rows are kept in ``rows``; NULL, empty and wordless texts share a
    node with identical texts only; ties are broken by the node; an empty table gives two
    empty ones; other columns are not read.
    """
    spark = df.sparkSession
    weights = shingle_weights(counter_sums(df, text_col, size))
    sampler = spark.sparkContext.broadcast(Sampler(weights))
    rows = materialize(sketches(df, id_col, text_col, sampler, size), "sketches")
    bands = rows.select("node", F.explode("bands").alias("band")).distinct()
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = materialize(bands.join(shared, "band"), "members")
    central = members.groupBy("node").agg(F.sum("n").alias("met"))
    members = materialize(members.join(central, "node").select(
        "band", "node", F.struct(F.col("met"), F.col("node").alias("key")).alias("rank")), "members")
    profiled = profiles(df, text_col, central.select("node"), sampler, size)
    leads = members.groupBy("band").agg(F.max("rank").alias("lead"))
    pairs = members.join(leads, "band").filter("rank < lead").select(F.col("lead.key").alias("leader"), "node").distinct()
    links = verified(materialize(pairs, "pairs"), profiled).filter(F.col("sim") >= threshold - 1e-9).select("leader", "node")
    labels = components(links)
    busy = members.select("band", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    busy = materialize(_mixed(busy), "busy")
    bounds = weight_bounds(busy, profiled).filter(F.col("open") >= (threshold - 1e-6) * F.col("whole"))
    busy = materialize(_mixed(busy.join(bounds, "node")), "busy")
    further = block_links(busy, profiled, threshold)
    if further.limit(1).count():
        labels = components(links.unionByName(further))
    return rows.select("id", "node"), labels


def _decided(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per node: its class, the class's smallest id, the node that stays and how many rows the class has."""
    per_node = rows.groupBy("node").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"))
    per_node = per_node.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    best = F.min(F.struct(F.col("first").isNull().alias("none"), F.col("first").alias("first"), F.col("node").alias("node")))
    per_class = per_node.groupBy("comp").agg(
        best.alias("best"), F.sum("copies").alias("class_size"), F.count(F.lit(1)).alias("texts"))
    return per_node.join(per_class, "comp").select(
        "node", F.col("best.first").alias("class_id"), F.col("best.node").alias("stays"), "class_size", "texts")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``df``: id, ``class_id`` (smallest id of its class), ``class_size``, ``class_texts``.

    Two texts are near-duplicates when the weighted Jaccard similarity of their five-word
    shingles is ``threshold`` or more; classes are what such links connect. Shorter texts
    have one shingle of all their words; texts without a word (NULL, empty, only signs)
    are in a class with identical texts only. NULL ids are kept; a class of NULL ids only
    has the class id NULL. An empty table gives an empty result.
    """
    rows, labels = near_classes(df, id_col, text_col, threshold)
    decided = materialize(_decided(rows, labels), "classes")
    return rows.join(decided, "node").select(
        F.col("id").alias(id_col), "class_id", "class_size", F.col("texts").alias("class_texts"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that with the smallest id (any one of repeated rows), with the columns of ``df``.

    Rows alone in their class are passed on where they are read; only rows that may have
    a near-duplicate are shuffled.
    """
    rows, labels = near_classes(df, id_col, text_col, threshold)
    decided = materialize(_decided(rows, labels).filter("class_size > 1"), "classes")
    bits = df.sparkSession.sparkContext.broadcast(_bitmap(decided.select("node")))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                hi, lo = _nodes(Words(data, offsets), data, offsets)
                out = batch.slice(first, end - first).append_column("node", to_binary16(hi, lo))
                yield out.append_column("maybe", pa.array(bits.value[_bits(lo)]))

    packed = pack(df, id_col, text_col)
    schema = StructType([*packed.schema, StructField("node", BinaryType()), StructField("maybe", BooleanType())])
    flagged = packed.mapInArrow(key, schema)
    joined = flagged.filter("maybe").join(decided, "node", "left")
    staying = joined.filter("stays is null or (stays = node and id <=> class_id)").dropDuplicates(["node"])
    return unpack(flagged.filter("not maybe").select("text", "rest").unionByName(staying.select("text", "rest")), df, text_col)
