"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.rows import col
from flowlens.llm.text import U64, chunks, mix
from flowlens.session import materialize

ORDER = 4
#: Counted grams in one part of the model; there are as many parts as that takes.
MAX_GRAMS = 1_500_000
CALIBRATION_ROWS = 4000
CALIBRATION_SHARE = 50
ACCEPTED_SHARE = 0.999
EVIDENCE = 50
GROUP_BYTES = 64 << 20
START, BLANK = 2, 32
#: Second symbols of letters above U+FFFF are the 1,024 from here.
SECOND = 0xDC00


LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def _symbols(points: np.ndarray) -> np.ndarray:
    """Characters to model symbols: letters stay, the text mark stays, all else is a blank.

    A letter above U+FFFF is two symbols, as in UTF-16; no other letter has either.
    """
    symbols = np.where(LETTER[points] | (points == START), points, BLANK)
    high = symbols > 0xFFFF
    if not high.any():
        return symbols.astype(np.uint16)
    at = np.cumsum(1 + high) - 1
    out = np.empty(at[-1] + 1, np.uint16)
    rest = symbols[high] - 0x10000
    out[at[high] - 1] = 0xD800 + (rest >> 10)
    out[at] = symbols & 0xFFFF
    out[at[high]] = SECOND + (rest & 0x3FF)
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character 4-grams of texts: (codes, text numbers, letters per text).

    Texts are lower-cased, runs of other characters become one blank, and three marks
    stand before each text. A code packs four 16-bit symbols, the predicted one lowest.
    """
    raw = data.tobytes()
    mark = "\x02\x02\x02"
    texts = [raw[a:b].decode("utf-8", "replace").replace("\x02", " ").lower() for a, b in zip(offsets, offsets[1:])]
    points = np.frombuffer((mark + mark.join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _symbols(points)
    blank = symbols == BLANK
    keep = ~blank
    keep[1:] |= symbols[:-1] > BLANK  # the first blank after a letter
    symbols = symbols[keep]
    marks = symbols == START
    docs = np.cumsum(marks) // 3 - 1
    wide = symbols.astype(U64)
    codes = wide.copy()
    for k in range(1, ORDER):
        codes[k:] |= wide[:-k] << U64(16 * k)
    told = ~marks
    letters = np.bincount(docs[told & (symbols != BLANK) & ((symbols < SECOND) | (symbols >= SECOND + 0x400))], minlength=len(texts))
    return codes[told], docs[told], letters


def gram_counts(df: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """How often each 4-gram occurs in the texts of each language: lang, code, n. Every row counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            codes, n = (np.concatenate(x) for x in zip(*parts))
            codes, at = np.unique(codes, return_inverse=True)
            return codes, np.bincount(at, n).astype(np.int64)

        def rows(lang: str, parts: list) -> pa.RecordBatch:
            codes, n = merged(parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                part = batch.column("text").take(pa.array(np.flatnonzero(langs == lang)))
                for _, _, data, offsets in chunks(part):
                    parts = found.setdefault(lang, [])
                    parts.append(np.unique(grams(data, offsets)[0], return_counts=True))
                    if len(parts) > 16:
                        parts[:] = [merged(parts)]
                    if len(parts[0][0]) > 2_000_000:  # bounded memory: hand over and start anew
                        yield rows(lang, found.pop(lang))
        for lang, parts in found.items():
            yield rows(lang, parts)

    given = df.select(col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"))
    return given.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


class HashArray:
    """Sorted hashes with the rows that belong to them, found through an index on the top bits."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        hashes = mix(codes + U64(0x9E3779B97F4A7C15))
        order = np.argsort(hashes)
        self.hashes, self.values = hashes[order], values[order]
        self.shift = U64(64 - max(1, int(len(codes)).bit_length() + 1))
        top = (self.hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << (64 - int(self.shift))) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max(initial=0))

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, or -1."""
        hashes = mix(codes + U64(0x9E3779B97F4A7C15))
        found = np.full(len(codes), -1, np.int64)
        if not len(self.hashes):
            return found
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[bucket].astype(np.int64), self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        for _ in range(self.deepest):
            place = at[left]
            hit = self.hashes[place] == hashes[left]
            found[left[hit]] = place[hit]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return found


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


class Statistics:
    """What the parts of a model have in common: languages, grams, discounts by (order, language), counts of single symbols."""

    def __init__(self, counts: DataFrame):
        level, found = counts, []
        for k in range(ORDER, 0, -1):
            if k < ORDER:  # in how many longer grams each one ends
                level = level.groupBy("lang", F.col("code").bitwiseAND((1 << 16 * k) - 1).alias("code")).agg(F.count(F.lit(1)).alias("n"))
            found.append(level.groupBy("lang").agg(
                F.lit(k).alias("k"), F.count(F.lit(1)).alias("grams"), F.count_if(F.col("n") == 1).alias("once"),
                F.count_if(F.col("n") == 2).alias("twice")))
        rows = reduce(DataFrame.unionByName, found).collect()
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = sum(r["grams"] for r in rows if r["k"] == ORDER)
        self.discounts = {(r["k"], r["lang"]): _discount(r["once"], r["twice"]) for r in rows}
        singles = level.toPandas().sort_values("code")
        self.singles = [(part["code"].to_numpy(np.int64).view(U64), part["n"].to_numpy(float))
                        for part in (singles[singles["lang"] == lang] for lang in self.langs)]


class CharacterModels:
    """Kneser-Ney probabilities of all languages side by side, a hash array per order.

    Every gram, its contexts and its endings but the last symbol have the same symbol before
    the last, so the grams with some of those symbols make a part of the model that is
    complete for them, given ``statistics`` of all grams. Without, the table is all there is.
    """

    def __init__(self, table: pd.DataFrame, statistics: Statistics | None = None):
        self.langs = statistics.langs if statistics else sorted(table["lang"].unique())
        width = len(self.langs)
        per_order: list[list[tuple[np.ndarray, np.ndarray]]] = []
        top = []
        for lang in self.langs:
            part = table[table["lang"] == lang]
            codes = part["code"].to_numpy(np.int64).view(U64)
            order = np.argsort(codes)
            top.append((codes[order], part["n"].to_numpy(float)[order]))
        per_order.append(top)
        for k in range(ORDER - 1, 0, -1):  # below the highest order: in how many longer grams each one ends
            mask = U64((1 << 16 * k) - 1)
            per_order.append([tuple(x.astype(t) for x, t in zip(np.unique(c & mask, return_counts=True), (U64, float)))
                              for c, _ in per_order[-1]])
        if statistics:
            per_order[-1] = statistics.singles
        per_order.reverse()
        self.grams: list[HashArray] = []
        self.backoff: list[HashArray] = []
        alphabet = np.unique(np.concatenate([c for c, _ in per_order[0]])) if width else np.zeros(0)
        self.uniform = 1.0 / (len(alphabet) + 1)
        for k, langs in enumerate(per_order, 1):
            codes = np.unique(np.concatenate([c for c, _ in langs])) if width else np.zeros(0, U64)
            contexts = np.unique(codes >> U64(16)) if k > 1 else np.zeros(1, U64)
            lower = self.probabilities(codes & U64((1 << 16 * (k - 1)) - 1), k - 1)
            gamma = np.ones((len(contexts), width))
            share = np.zeros((len(codes), width))
            for j, (own, n) in enumerate(langs):
                if statistics:
                    discount = statistics.discounts[k, self.langs[j]]
                else:
                    discount = _discount((n == 1).sum(), (n == 2).sum())
                context = np.searchsorted(contexts, own >> U64(16) if k > 1 else np.zeros(len(own), U64))
                total = np.bincount(context, n, len(contexts))
                kinds = np.bincount(context, minlength=len(contexts))
                seen = total > 0
                gamma[seen, j] = discount * kinds[seen] / total[seen]
                share[np.searchsorted(codes, own), j] = np.maximum(n - discount, 0) / total[context]
            context = np.searchsorted(contexts, codes >> U64(16)) if k > 1 else np.zeros(len(codes), int)
            self.grams.append(HashArray(codes, share + gamma[context] * lower))
            self.backoff.append(HashArray(contexts, gamma))
        self.logs = np.log(self.grams[-1].values).astype(np.float32) if width else np.zeros((0, 0), np.float32)

    def probabilities(self, codes: np.ndarray, order: int) -> np.ndarray:
        """Of each code's last symbol after the ``order - 1`` before it, in every language."""
        if not order:
            return np.full((len(codes), len(self.langs)), self.uniform)
        out = np.empty((len(codes), len(self.langs)))
        at = self.grams[order - 1].find(codes)
        out[at >= 0] = self.grams[order - 1].values[at[at >= 0]]
        missing = np.flatnonzero(at < 0)
        if len(missing):
            rest = codes[missing]
            context = self.backoff[order - 1].find(rest >> U64(16) if order > 1 else np.zeros(len(rest), U64))
            gamma = np.ones((len(rest), len(self.langs)))
            gamma[context >= 0] = self.backoff[order - 1].values[context[context >= 0]]
            out[missing] = gamma * self.probabilities(rest & U64((1 << 16 * (order - 1)) - 1), order - 1)
        return out

    def log_sums(self, codes: np.ndarray, docs: np.ndarray, texts: int) -> np.ndarray:
        """Sum of the grams' log-probabilities of each text in each language."""
        total = np.zeros((texts, len(self.langs)))
        if not self.langs or not len(codes):
            return total
        at = self.grams[-1].find(codes)
        logs = self.logs[at] if len(self.logs) else np.empty((len(codes), len(self.langs)), np.float32)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            logs[missing] = np.log(self.probabilities(codes[missing], ORDER))
        size = np.bincount(docs, minlength=texts)
        has = np.flatnonzero(size)
        total[has] = np.add.reduceat(logs, np.cumsum(size)[has] - size[has], axis=0, dtype=np.float64)
        return total


def _part(code, parts: int):
    """Which part of the model a gram belongs to, by the symbol before its last."""
    if isinstance(code, Column):
        return F.pmod(F.shiftrightunsigned(code, 16).bitwiseAND(0xFFFF), F.lit(parts))
    return (code >> U64(16) & U64(0xFFFF)) % U64(parts)


def _broadcast_parts(counts: DataFrame, most: int) -> tuple[list[str], list[Broadcast]]:
    """The languages, and the model of all counted grams in parts of about ``most`` of them, built one after the other."""
    statistics = Statistics(counts)
    parts = max(1, -(-statistics.grams // most))
    return statistics.langs, [
        counts.sparkSession.sparkContext.broadcast(CharacterModels(counts.filter(_part(F.col("code"), parts) == k).toPandas(), statistics))
        for k in range(parts)]


def _entropies(
    batches: Iterator[pa.RecordBatch], model: list[Broadcast],
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of the batches with each text's cross-entropy per symbol in each language, symbols and letters.

    A model of several parts is gone through once for every ``GROUP_BYTES`` of text, with one
    part in memory at a time.
    """
    group, held = [], 0

    def scored():
        told: list = [None] * len(group)
        for k, part in enumerate(model):
            for i, (rows, data, offsets) in enumerate(group):
                codes, docs, letters = grams(data, offsets)
                size = np.bincount(docs, minlength=len(offsets) - 1)
                if len(model) > 1:
                    mine = _part(codes, len(model)) == k
                    codes, docs = codes[mine], docs[mine]
                sums = part.value.log_sums(codes, docs, len(size))
                told[i] = (rows, sums if told[i] is None else told[i][1] + sums, size, letters)
            if len(model) > 1 and getattr(part, "_path", None):
                vars(part).pop("_value", None)  # read from its file again when its turn comes
        for rows, sums, size, letters in told:
            yield rows, -sums / np.maximum(size, 1)[:, None], size, letters
        group.clear()

    for batch in batches:
        for first, end, data, offsets in chunks(batch.column("text")):
            group.append((batch.slice(first, end - first), data, offsets))
            held += len(data)
            if len(model) == 1 or held >= GROUP_BYTES:
                yield from scored()
                held = 0
    yield from scored()


def _scores(df: DataFrame, names: list[str], model: list[Broadcast], calibration) -> DataFrame:
    """id, text -> id, lang_pred, score, cross_entropy, rejected."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sharpness, limits = calibration
        langs = np.array(names, object)
        for rows, entropy, size, letters in _entropies(batches, model):
            known = (letters > 0) & (len(langs) > 0)
            best = entropy.argmin(axis=1) if len(langs) else np.zeros(len(known), int)
            low = entropy.min(axis=1, initial=np.inf) if len(langs) else np.zeros(len(known))
            gap = (entropy - low[:, None]) * (sharpness * np.minimum(size, EVIDENCE))[:, None]
            sure = np.where(known, 1 / np.maximum(np.exp(-gap).sum(axis=1), 1), 0.0)
            name = np.where(known, langs[best], "und") if len(langs) else np.full(len(known), "und", object)
            rejected = ~known | (low > np.array([*limits, np.inf])[np.where(known, best, len(limits))])
            yield pa.RecordBatch.from_arrays([
                rows.column("id"), pa.array(name, pa.string()), pa.array(sure),
                pa.array(np.where(known, low, np.nan)), pa.array(rejected)],
                names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInArrow(score, f"id {kind}, lang_pred string, score double, cross_entropy double, rejected boolean")


def _calibrate(sample: pd.DataFrame, langs: list[str]) -> tuple[float, list[float]]:
    """Sharpness of the score that makes held-back labels likeliest, and each language's entropy limit."""
    if not len(sample) or not langs:
        return 1.0, [np.inf] * len(langs)
    entropy = np.array(sample["entropy"].tolist())
    truth = sample["lang"].map({lang: j for j, lang in enumerate(langs)}).to_numpy()
    evidence = np.minimum(sample["size"].to_numpy(), EVIDENCE)
    best = (np.inf, 1.0)
    for sharpness in np.geomspace(0.02, 2, 25):
        logit = -(entropy - entropy.min(axis=1, keepdims=True)) * (sharpness * evidence)[:, None]
        loss = (np.log(np.exp(logit).sum(axis=1)) - logit[np.arange(len(truth)), truth]).mean()
        best = min(best, (loss, sharpness))
    limits = [float(np.quantile(entropy[truth == j, j], ACCEPTED_SHARE)) if (truth == j).sum() > 20 else np.inf
              for j in range(len(langs))]
    return float(best[1]), limits


def identify(
    df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_grams: int = MAX_GRAMS, calibration_rows: int = CALIBRATION_ROWS,
) -> DataFrame:
    """id, lang_pred, score, cross_entropy, rejected of every row.

    Models are trained on the texts of all rows where ``train`` holds and the language is
    known, but one in fifty: of those, at most ``calibration_rows`` set the score's sharpness
    and each language's rejection limit. ``lang_pred`` is the language with the lowest
    length-normalised cross-entropy, the first by name in a tie; ``rejected`` says that even
    that is beyond what 99.9 % of the language's texts have. Texts that are NULL or without
    a letter, and all texts where nothing could be learned, get ``und``, score 0 and rejected.
    The model holds all grams; where they are more than ``max_grams``, in several parts.
    """
    given = df.select(
        col(id_col).alias("id"), col(text_col).cast("string").alias("text"), col(lang_col).cast("string").alias("lang"),
        F.coalesce(train, F.lit(False)).alias("train"))
    known = given.filter("train and lang is not null and text is not null")
    fold = F.pmod(F.xxhash64("id", F.length("text")), F.lit(CALIBRATION_SHARE))
    counts = materialize(gram_counts(known.filter(fold != 0), "text", "lang"), "grams")
    langs, model = _broadcast_parts(counts, max_grams)
    held = known.filter(fold == 0).filter(F.col("lang").isin(langs)).orderBy(F.xxhash64("id", F.lit(1))).limit(calibration_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, entropy, size, letters in _entropies(batches, model):
            yield pa.RecordBatch.from_arrays(
                [rows.column("lang"), pa.array(list(entropy), pa.list_(pa.float64())), pa.array(size)],
                names=["lang", "entropy", "size"]).filter(pa.array(letters > 0))

    sample = held.select("text", "lang").mapInArrow(measure, "lang string, entropy array<double>, size long").toPandas()
    scored = _scores(given, langs, model, _calibrate(sample, langs))
    return scored.withColumnRenamed("id", id_col)
