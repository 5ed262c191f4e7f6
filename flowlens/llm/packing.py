"""Best-fit packing of token sequences by linear grouping."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowlens.functions.ordering import sliced_row_number
from flowlens.llm.rows import col
from flowlens.llm.tokens import token_ids
from flowlens.session import materialize

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns over a few sizes and how often the linear relaxation uses each (Gilmore-Gomory columns).

    Returns (patterns, use): one column per pattern, ``patterns @ use == demand``.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    most = int(capacity // sizes.min())
    for _ in range(60 * n):
        price = np.linalg.solve(basis.T, np.ones(n))
        best, choice = np.zeros(capacity + 1), []
        for _ in range(most):
            reach = np.full((n + 1, capacity + 1), -1.0)
            reach[n] = best
            for g in np.flatnonzero(price > 1e-12):
                reach[g, sizes[g]:] = best[: capacity + 1 - sizes[g]] + price[g]
            pick = reach[::-1].argmax(axis=0)
            choice.append(n - pick)
            best = reach.max(axis=0)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(n), capacity
        for pick in reversed(choice):
            if pick[room] < n:
                column[pick[room]] += 1
                room -= sizes[pick[room]]
        use, step = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return basis, np.maximum(np.linalg.solve(basis, demand), 0)


class _Plan:
    """Where the r-th piece of each length goes, as runs: (length, first rank, count, first sequence, offset)."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.left, self.rank, self.capacity = counts.copy(), np.zeros(len(counts), np.int64), capacity
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: [(first sequence, count)]
        self.sequences = 0

    def put(self, length: int, first: int, count: int, used: int) -> None:
        self.runs.append((length, int(self.rank[length]), count, first, used))
        self.rank[length] += count
        self.left[length] -= count

    def best_fit(self, length: int) -> None:
        """All remaining pieces of a length into the fullest sequences that take them, in bulk; new ones at need."""
        while self.left[length]:
            room = next((r for r in range(length, self.capacity + 1) if self.open.get(r)), None)
            if room is None:
                first, count = self.sequences, int(-(-self.left[length] // (self.capacity // length)))
                self.sequences += count
                room = self.capacity
            else:
                first, count = self.open[room].pop()
            used = min(count, int(self.left[length]))
            self.put(length, first, used, self.capacity - room)
            if room > length:
                self.open[room - length].append((first, used))
            if used < count:
                self.open[room].append((first + used, count - used))


def plan_runs(counts: np.ndarray, capacity: int = CAPACITY, groups: int = 40) -> tuple[pd.DataFrame, int]:
    """The best of ``grouped_plan`` for three limits between small and large lengths: (runs, number of sequences).

    Rounding up costs most where configurations hold many large pieces, and best fit where
    small ones are scarce; which limit suits shows only in the number of sequences.
    """
    return min((grouped_plan(counts, capacity, groups, capacity // part) for part in (5, 3, 2)), key=lambda plan: plan[1])


def grouped_plan(counts: np.ndarray, capacity: int, groups: int, small: int) -> tuple[pd.DataFrame, int]:
    """A packing of pieces known only by how many there are of each length: (runs, number of sequences).

    Lengths above ``small`` are cut, longest first, into ``groups`` groups of equal
    cardinality and rounded up to their group's longest; the few sizes that gives are
    packed by optimised configurations, whole multiples of which take the actual
    lengths in their place. What is left, and the small lengths, go by best fit.
    The work depends on ``capacity`` and ``groups``, not on the number of pieces.
    """
    plan = _Plan(np.asarray(counts, np.int64), capacity)
    if plan.left[capacity]:
        count = int(plan.left[capacity])
        plan.put(capacity, 0, count, 0)
        plan.sequences = count
    large = [(n, int(plan.left[n])) for n in range(capacity - 1, small, -1) if plan.left[n]]
    total = sum(c for _, c in large)
    if total >= groups:
        members: list[list[list[int]]] = [[] for _ in range(groups)]
        group, room = 0, total // groups + (total % groups > 0)
        for length, count in large:
            while count:
                take = min(count, room)
                members[group].append([length, take])
                count, room = count - take, room - take
                if not room:
                    group += 1
                    done = sum(sum(c for _, c in m) for m in members)
                    room = -(-(total - done) // (groups - group)) if group < groups else 0
        members = [m for m in members if m]
        sizes, at = [], []
        for m in members:  # groups of one size are one
            if sizes and sizes[-1] == m[0][0]:
                at[-1] += m
            else:
                sizes.append(m[0][0])
                at.append(list(m))
        demand = np.array([sum(c for _, c in m) for m in at], float)
        patterns, use = configurations(np.array(sizes), demand, capacity)
        for j in range(len(sizes)):
            times = int(use[j] + 1e-6)
            slots = [g for g in range(len(sizes)) for _ in range(int(round(patterns[g, j])))]
            if not slots:
                continue
            times = min([times, *(sum(c for _, c in at[g]) // slots.count(g) for g in set(slots))])
            blocks = [(plan.sequences, times, 0)] if times else []
            plan.sequences += times
            for g in slots:
                after = []
                for first, count, used in blocks:
                    while count:
                        length, there = at[g][0]
                        take = min(count, there)
                        plan.put(length, first, take, used)
                        after.append((first, take, used + length))
                        at[g][0][1] -= take
                        if not at[g][0][1]:
                            at[g].pop(0)
                        first, count = first + take, count - take
                blocks = after
            for first, count, used in blocks:
                if used < capacity:
                    plan.open[capacity - used].append((first, count))
    for length in range(capacity - 1, 0, -1):
        plan.best_fit(length)
    runs = pd.DataFrame(plan.runs, columns=["length", "rank", "count", "sequence", "offset"])
    return runs.sort_values(["length", "rank"], ignore_index=True), plan.sequences


def _cut(capacity: int, vocabulary: str, ranks: str):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column("id").to_pylist(), []
            for doc, text in zip(ids, batch.column("text")):
                tokens = np.append(token_ids(text.as_py() or "", vocabulary, ranks), np.uint32(0)).astype("<u4")
                first = len(tokens) % capacity or capacity
                bounds = [0, *range(first, len(tokens) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    rows.append((doc, k, a, b - a, zlib.crc32(tokens[a:b].tobytes())))
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], batch.schema.field("id").type), *(
                    pa.array(c, t) for c, t in zip(columns[1:], (pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def pack(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    vocabulary: str | None = None, ranks: str | None = None, rows_per_slice: int = 200_000,
) -> DataFrame:
    """Pieces of every text and their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text's ids end with id 0; NULL counts as empty and gives that one id. Longer texts
    are cut into pieces of ``capacity``, the first of which takes the remainder. The
    driver sees the number of pieces of each length and nothing else, so its work is the
    same at any size; pieces are numbered within their length by sliced ranks (lengths
    that very many pieces share are spread) and looked up in the plan's runs, of which
    there are at most some ten thousand. Repeated rows and NULL ids are packed like others.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    given = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    pieces = materialize(given.mapInArrow(
        _cut(capacity, vocabulary, ranks), PIECES.replace("doc_id long", f"doc_id {kind}")), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length] = n
    runs, _ = plan_runs(counts, capacity)
    slices = max(1, int(counts.max()) // rows_per_slice)
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(slices)))
    ranked = sliced_row_number(sliced, "rank", ["length"], ["doc_id", "piece", "start", "ids_crc32"], ["slice"]).drop("slice")
    keys = (runs["length"].to_numpy(np.int64) << 44) + runs["rank"].to_numpy(np.int64)
    table = df.sparkSession.sparkContext.broadcast((keys, *(runs[c].to_numpy(np.int64) for c in ("rank", "sequence", "offset"))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = table.value
        for batch in batches:
            rank = batch.column("rank").to_numpy() - 1
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + rank, "right") - 1
            out = batch.drop_columns(["rank"])
            out = out.append_column("sequence_id", pa.array(sequence[at] + rank - first[at]))
            yield out.append_column("offset", pa.array(offset[at]))

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = PIECES.replace("doc_id long", f"doc_id {kind}") + ", sequence_id long, offset long"
    placed = ranked.select(*names, "rank").mapInArrow(place, schema)
    return placed.withColumnRenamed("doc_id", id_col)
