"""Toxicity by multiple-instance learning: sentences score, noisy-or judges the document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.rows import col, pack, unpack
from flowlens.llm.text import U64, Words, chunks, counted
from flowlens.session import materialize

TRAIN_ROWS = 12_000
LEXICON = 4096
MIN_DOCUMENTS = 4
STEPS = 300
PREFIXES = (4, 6, 8)
SENTENCE_END = np.zeros(256, bool)
SENTENCE_END[[ord(c) for c in ".!?\n"]] = True


@dataclass
class SentenceModel:
    """A logistic score of each sentence from the lexicon's words in it."""

    words: np.ndarray  # sorted hashes
    weight: np.ndarray
    bias: float

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of lexicon words among ``hashes``, and their places in the lexicon."""
        if not len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bits = np.zeros(1 << 16, bool)
        bits[(self.words & U64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(bits[(hashes & U64(0xFFFF)).astype(np.int64)])
        place = np.searchsorted(self.words, hashes[at])
        place[place == len(self.words)] = 0
        hit = self.words[place] == hashes[at]
        return at[hit], place[hit]


def sentences(words: Words, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sentence of each word, numbered through the chunk, and how many sentences with words each text has."""
    if not len(words.start):
        return words.doc, np.zeros(len(words.count), np.int64)
    ends = np.cumsum(SENTENCE_END[data])[words.start]
    new = np.ones(len(ends), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (words.doc[1:] != words.doc[:-1])
    return np.cumsum(new) - 1, np.bincount(words.doc[new], minlength=len(words.count))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(word number, feature hash): each word itself, and its first 4, 6 and 8 bytes with its length."""
    at, value = zip((np.arange(len(words.hash)), words.hash), *(words.prefixes(k) for k in PREFIXES))
    return np.concatenate(at), np.concatenate(value)


def _log1m_sigmoid(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))"""
    return -np.logaddexp(0, z)


def fit(
    lexicon: np.ndarray, odds: np.ndarray, docs: np.ndarray, sents: np.ndarray, place: np.ndarray,
    plain: np.ndarray, labels: np.ndarray,
) -> SentenceModel:
    """Fit the weights of a lexicon from its occurrences (document, sentence, place in the lexicon).

    ``plain`` has the sentences of each document. Weights and bias start from the log-odds
    and follow the gradient of the documents' log-likelihood under noisy-or.
    """
    positive = labels.sum()
    if not positive or positive == len(labels):
        share = (positive + 0.5) / (len(labels) + 1)
        return SentenceModel(lexicon[:0], odds[:0], -20.0 if not positive else float(np.log(share / (1 - share))))
    used, row = np.unique(sents, return_inverse=True)
    owner = docs[np.unique(sents, return_index=True)[1]]
    rest = plain - np.bincount(owner, minlength=len(labels))
    weight, bias = np.clip(odds, -4, 4) / 4, -6.0
    first = np.zeros(len(weight) + 1)
    second = np.zeros(len(weight) + 1)
    for step in range(1, STEPS + 1):
        z = bias + np.bincount(row, weight[place], len(used))
        log_clean = np.bincount(owner, _log1m_sigmoid(z), len(labels)) + rest * _log1m_sigmoid(np.array(bias))
        clean = np.exp(log_clean)
        # slope of the log-likelihood along each sentence's z: sigmoid(z) times this pull of its document
        pull = np.where(labels > 0, clean / np.maximum(1 - clean, 1e-9), -1.0) / len(labels)
        slope = pull[owner] / (1 + np.exp(-z))
        grad = np.append(np.bincount(place, slope[row], len(weight)) - 1e-5 * weight,
                         slope.sum() + (pull * rest).sum() / (1 + np.exp(-bias)))
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        weight += move[:-1]
        bias += move[-1]
    return SentenceModel(lexicon, weight, float(bias))


def train(df: DataFrame, id_col: str, text_col: str, labels: DataFrame, label_col: str, use: Column, most: int = TRAIN_ROWS) -> SentenceModel:
    """Model from at most ``most`` labelled rows, the first by a hash of their id among those where ``use`` holds.

    That bound makes the sample small enough to broadcast to the scan of the texts and to
    fit on the driver; it is the same function of the labels at any size. Rows without an
    id or a label teach nothing; of an id labelled twice the higher label counts.
    """
    chosen = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).filter(
        "id is not null and label is not null").filter(use).groupBy("id").agg(F.max("label").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(most)
    texts = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("text", "label")

    sample = materialize(sample, "toxicity-sample")
    rows, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.expr("int(label > 0)")), F.lit(0))).first()

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("label").to_numpy() > 0
            for first, end, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                at, value = features(words)
                value, doc, _ = counted(value, words.doc[at])
                kinds, kind = np.unique(value, return_inverse=True)
                n = np.bincount(kind, minlength=len(kinds))
                p = np.bincount(kind, toxic[first:end][doc], len(kinds)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n), pa.array(p)], names=["f", "n", "p"])

    # log-odds of a feature's presence between the labels, for features that speak for the label
    counts = sample.mapInArrow(presence, "f long, n long, p long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    odds = F.expr(f"ln((p + 0.5) / ({positive} - p + 0.5)) - ln((n - p + 0.5) / ({rows - positive} - n + p + 0.5))")
    best = counts.filter(F.col("n") >= MIN_DOCUMENTS).withColumn("odds", odds).filter("odds > 0").orderBy(
        F.desc(F.expr("odds * sqrt(n)")), "f").limit(LEXICON).toPandas()
    hashes = best["f"].to_numpy(np.int64).view(U64)
    order = np.argsort(hashes)
    lexicon = SentenceModel(hashes[order], best["odds"].to_numpy(float)[order], 0.0)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                words = Words(data, offsets)
                sentence, plain = sentences(words, data)
                at, value = features(words)
                hit, place = lexicon.find(value)
                place, sent, _ = counted(place, sentence[at[hit]])
                doc = words.doc[np.searchsorted(sentence, sent)] if len(sent) else sent
                bound = np.searchsorted(doc, np.arange(end - first + 1)).astype(np.int32)
                local = sent - np.concatenate([[0], np.cumsum(plain)])[doc] if len(sent) else sent
                yield pa.RecordBatch.from_arrays([
                    batch.column("label").slice(first, end - first), pa.array(plain),
                    pa.ListArray.from_arrays(pa.array(bound), pa.array(local.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(bound), pa.array(place.astype(np.int32)))],
                    names=["label", "plain", "sents", "places"])

    found = sample.mapInArrow(occurrences, "label int, plain long, sents array<int>, places array<int>").toPandas()
    if not len(found):
        return SentenceModel(np.zeros(0, U64), np.zeros(0), -20.0)
    docs = np.repeat(np.arange(len(found)), found["places"].map(len).to_numpy())
    before = np.concatenate([[0], np.cumsum(found["plain"].to_numpy())])
    sents = np.concatenate(found["sents"].tolist()).astype(np.int64) + before[docs]
    places = np.concatenate(found["places"].tolist()).astype(np.int64)
    return fit(lexicon.words, lexicon.weight, docs, sents, places, found["plain"].to_numpy(),
               (found["label"].to_numpy() > 0).astype(float))


def _judge(model: SentenceModel, data: np.ndarray, offsets: np.ndarray):
    """Score of each text, and (text, start, length, score) of its sentences that reach one half."""
    words = Words(data, offsets)
    sentence, plain = sentences(words, data)
    word, value = features(words)
    at, place = model.find(value)
    place, sent, _ = counted(place, sentence[word[at]])
    used, row = np.unique(sent, return_inverse=True)
    z = model.bias + np.bincount(row, model.weight[place], len(used)) if len(used) else np.zeros(0)
    head = np.searchsorted(sentence, used)
    owner = words.doc[head] if len(used) else np.zeros(0, np.int64)
    log_clean = np.bincount(owner, _log1m_sigmoid(z), len(plain)) if len(used) else np.zeros(len(plain))
    log_clean = log_clean + (plain - np.bincount(owner, minlength=len(plain))) * _log1m_sigmoid(np.array(model.bias))
    bad = np.flatnonzero(z >= 0)
    tail = np.searchsorted(sentence, used[bad], "right") - 1 if len(bad) else np.zeros(0, np.int64)
    start = words.start[head[bad]] - offsets[owner[bad]] if len(bad) else np.zeros(0, np.int64)
    end = words.end[tail] - offsets[owner[bad]] if len(bad) else np.zeros(0, np.int64)
    return -np.expm1(log_clean), owner[bad], start, end - start, 1 / (1 + np.exp(-z[bad]))


SPANS = "array<struct<start:long,length:long,score:double>>"


def score(df: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score, predicted and ``offending``: bytes (start, length) and score of sentences at one half or more.

    The score is the noisy-or of the sentence scores, 0 for texts without a word (NULL,
    empty). Repeated rows and NULL ids are scored like others; an empty table gives none.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                scores, owner, start, length, each = _judge(shared.value, data, offsets)
                bound = np.searchsorted(owner, np.arange(end - first + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(each)], names=["start", "length", "score"])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(first, end - first), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(bound), spans)], names=["id", "score", "predicted", "offending"])

    given = df.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(judge, f"id {kind}, score double, predicted int, offending {SPANS}").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores below one half, as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column("text")):
                keep = _judge(shared.value, data, offsets)[0] < 0.5
                yield batch.slice(first, end - first).filter(pa.array(keep))

    packed = pack(df, id_col, text_col)
    return unpack(packed.mapInArrow(clean, packed.schema), df, text_col)
