"""Tokenizer alignment against a plain walk over both token lists."""

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowlens.llm import alignment, queries

A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _printable():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


PRINTABLE = _printable()


def a_bytes(i):
    return bytes(PRINTABLE[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def walk(text):
    """(A ids, B ids, groups, links) of a text, token by token; None where it has no tokens."""
    if not text:
        return None
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    if any(b"".join(map(spell, ids)) != (" " + text).encode() for spell, ids in ((a_bytes, a), (b_bytes, b))):
        return None
    groups, links, left, right = [], [], [a[0]], [b[0]]
    i = j = 0
    end_a, end_b = len(a_bytes(a[0])), len(b_bytes(b[0]))
    while True:
        links.append((a[i], b[j]))
        step_a, step_b = end_a <= end_b, end_b <= end_a
        if step_a and step_b:
            groups.append((left, right))
            left, right = [], []
        if step_a:
            i += 1
            if i == len(a):
                return a, b, groups, links
            left.append(a[i])
            end_a += len(a_bytes(a[i]))
        if step_b:
            j += 1
            right.append(b[j])
            end_b += len(b_bytes(b[j]))


def brute_force(texts):
    walked = [walk(t) for t in texts]
    counts = Counter(x for w in walked if w for x in w[3])
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    rows = []
    for w in walked:
        if w is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = w
        text = ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links),
                     sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return rows, counts, top


ODD_TEXTS = [
    "<|endoftext|> and <s> </s> <unk> are text", "a▁b", "▁", " ", "\n\n\t x", " c　d\x85e\x1cf﻿", "<0x41>", "𠮷野家 \U0001F914",
    "word" * 700, "é" * 900 + " " * 50 + "1234567890" * 30,
]


def test_every_document(spark, sf_dir, table):
    rows = table("documents").collect()
    expected, _, _ = brute_force([r["text"] for r in rows])
    found = queries.QUERIES["op13_alignment"](spark, sf_dir).collect()
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found) == Counter(
        (r["doc_id"], *e) for r, e in zip(rows, expected))


@pytest.mark.parametrize("bundle, chunk", [(1 << 20, 1 << 18), (200, 50)])
def test_odd_rows(spark, docs, odd, bundle, chunk):
    rows = [(i, t[:3000] if t else t) for i, t, *_ in odd] + [(100 + k, t) for k, t in enumerate(ODD_TEXTS)] * 2
    expected, counts, top = brute_force([t for _, t in rows])
    out = alignment.align(
        docs(rows, extra=("bundle", "kind", "pair", "id")).repartition(3), keep_groups=True, bundle_chars=bundle, chunk_chars=chunk)
    found = out.documents.collect()
    assert Counter((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found) == Counter(
        (i, *e) for (i, _), e in zip(rows, expected))
    assert all((hashlib.sha256(r["groups"].encode()).hexdigest() if r["groups"] else "") == r["groups_sha256"] for r in found)
    pairs = {(r["a_id"], r["b_id"]): (r["links"], r["best"]) for r in out.pairs.collect()}
    assert pairs == {k: (n, n == top[k[1]]) for k, n in counts.items()}


def test_long_text_and_empty_table(docs, odd):
    text = next(t for _, t, *_ in odd if t and len(t) > 100_000)
    row = alignment.align(docs([(1, text)]), bundle_chars=1000, chunk_chars=100).documents.first()
    assert row["n_links"] >= max(row["n_a"], row["n_b"]) >= row["n_groups"] > 0 and row["count_sum"] >= row["n_links"]
    out = alignment.align(docs([]))
    assert out.documents.count() == out.pairs.count() == 0


def test_no_cross_join_and_no_text_in_a_shuffle(docs, odd):
    plan = alignment.align(docs(odd)).documents._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "text" not in plan.split("== Physical Plan ==")[1]
    assert alignment.align(docs(odd)).documents.agg(F.sum("n_links")).first()[0] > 0
