"""Packing, mixing, archives, fingerprints, the pipeline, and every check SQL of the package."""

import gzip
import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
import __spark_entry__ as entry_module
from compare import connect, mismatch
from flowlens.llm import fingerprint, mixing, packing, queries, warc
from flowlens.llm.tokens import token_ids
from flowlens.llm.warc import bucket_of

VOCABULARY, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(name, spark, sf_dir):
    assert mismatch(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE[name]) is None


def test_all_operators_are_registered():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_module.queries()


def test_ids_are_those_of_the_vocabulary_file(table):
    exact = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(1)
    odd = ["", "<|endoftext|>a", "a\x85b \u2003c\u3000d\u200be\ufeff", "I'll don't 'S 12ab\t\n  x ", "\x1c\x1d \x1e", "é\u0301 ß \U0001F600"]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x1F300, 0x1F700)])) for _ in range(60)) for _ in range(300)]
    for text in [*odd, *[r["text"] for r in table("documents").limit(150).collect()]]:
        assert token_ids(text, VOCABULARY, RANKS).tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def check_packing(rows, found, capacity=2048):
    exact, pieces = Tokenizer.from_file(VOCABULARY), defaultdict(list)
    for r in found:
        pieces[r["doc_id"]].append(r)
    for i, text in rows:
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine))) and mine[-1]["start"] + mine[-1]["length"] == len(ids)
        assert all(r["length"] == capacity for r in mine[1:])
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences)


def test_packing_of_the_documents(spark, sf_dir, table):
    found = queries.QUERIES["op9_packing"](spark, sf_dir).collect()
    rows = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    used = check_packing(rows, found)
    assert used <= 1.05 * sum(r["length"] for r in found) / 2048 + 1


def test_packing_of_odd_rows(docs, odd):
    found = packing.pack(docs(odd, extra=("length", "rank", "slice")), rows_per_slice=3).collect()
    by_id = Counter(r["doc_id"] for r in found if r["piece"] == 0)
    assert by_id == Counter(r[0] for r in odd)
    assert all(r["length"] == 1 for r in found if r["doc_id"] in (1, 2))
    places = Counter((r["sequence_id"], r["offset"]) for r in found)
    assert max(places.values()) == 1
    assert packing.pack(docs([])).count() == 0


def test_plan_places_each_piece_once():
    rng = np.random.default_rng(4)
    counts = np.zeros(2049, np.int64)
    np.add.at(counts, np.minimum(2048, rng.lognormal(6, 1, 30_000).astype(int) + 1), 1)
    runs, sequences = packing.plan_runs(counts)
    assert runs.groupby("length")["count"].sum().to_dict() == {n: c for n, c in enumerate(counts) if c}
    for _, r in runs.groupby("length"):
        assert (r["rank"].to_numpy() == np.append(0, r["count"].cumsum().to_numpy()[:-1])).all()
    total = (np.arange(2049) * counts).sum()
    assert sequences <= 1.01 * total / 2048
    same, again = packing.plan_runs(counts * 1000)
    assert again <= 1.01 * total / 2.048 and len(same) < 60_000


def test_poisson_counts_and_shares(spark, docs):
    rows = [(i, "x" * (20 if i % 10 else 200), None, ["big", "mid", None][0 if i % 8 else 1 + i % 16 // 8]) for i in range(4000)]
    weights = spark.createDataFrame([("big", 1.0), ("mid", 2.0), (None, 1.0)], "source string, weight double")
    drawn = mixing.mix_report(docs(rows), weights=weights).toPandas()
    chars = drawn.assign(n=drawn["text"].str.len(), source=drawn["source"].fillna("none")).groupby("source")["n"].sum()
    total = sum(len(r[1]) for r in rows)
    for source, share in (("big", 0.25), ("mid", 0.5), ("none", 0.25)):
        assert chars[source] / total == pytest.approx(share, rel=0.15)
    assert (drawn.groupby("doc_id")["copy"].max() == drawn.groupby("doc_id").size()).all()
    assert drawn["key"].is_monotonic_increasing and not drawn["doc_id"].is_monotonic_increasing
    # a large mean is a sum: mean and variance agree
    many = mixing.replicated(
        spark.range(3000).selectExpr("id", "'t' as text", "struct(id) as rest", "'s' as source"),
        spark.createDataFrame([("s", 21.5)], "source string, rate double")).groupBy("id").count().toPandas()["count"]
    assert many.mean() == pytest.approx(21.5, abs=0.4) and many.var() == pytest.approx(21.5, rel=0.12)


def test_mixing_of_odd_rows(docs, odd):
    mixed = mixing.mix(docs(odd, extra=("rate", "key", "salt", "of")))
    assert mixed.columns == docs(odd, extra=("rate", "key", "salt", "of")).columns and mixed.filter("rate != 'x'").count() == 0
    assert mixing.mix(docs([])).count() == 0


def test_archives_round_trip(spark, tmp_path):
    page = "<p>" + "word " * 60
    rows = [(5, "http://a/\n b", page), (3, None, page), (9, "u", page + "!"), (7, "u", "short"), (8, "u", "short"),
            (1, "u", None), (None, "u", page), (3, "again", page), (10**12, "u", "é" * 80), (4, "x", "é" * 80)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = []
    for name, parts in (("a", 1), ("b", 5)):
        root = f"{tmp_path}/{name}"
        warc.write_archives(df.repartition(parts), root, shard_bytes=700, file_bytes=200)
        archives.append({f: open(f"{root}/archives/{f}", "rb").read() for f in sorted(os.listdir(f"{root}/archives"))})
        assert os.listdir(f"{root}/temporary") == []
    assert archives[0] == archives[1] and len(archives[0]) > 3  # the same bytes however the rows were dealt
    assert all(gzip.decompress(data).startswith(b"WARC/1.1\r\n") for data in archives[0].values())
    found = Counter(map(tuple, warc.read_archives(spark, f"{tmp_path}/a").drop("url", "file").collect()))
    digest = lambda t: (len((t or "").encode()), hashlib.sha256((t or "").encode()).hexdigest())
    first = {page: 3, "é" * 80: 4}
    truth = Counter()
    for i, _, html in rows:
        known = first.get(html)
        truth[(i, *digest(html), *(("revisit", known) if known is not None and i != known else ("response", None)))] += 1
    assert found == truth
    stray = f"{tmp_path}/a/archives/{sorted(archives[0])[0]}"
    open(stray, "r+b").write(b"\x00")
    with pytest.raises(Exception):
        warc.read_archives(spark, f"{tmp_path}/a").collect()
    empty = f"{tmp_path}/c"
    warc.write_archives(df.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_shards_of_uneven_ids(spark):
    """Most bytes in a few ids far apart: shards hold their share, but for single ids with more."""
    rows = [(i, 10) for i in range(300)] + [(10**12 + 3 * i, 40) for i in range(500)] + [(7, 5000), (-(10**15), 20)]
    bounds = warc.shard_bounds(spark.createDataFrame(rows, "id long, bytes long").repartition(5), 400)
    assert bounds == sorted(set(bounds))
    shards = Counter()
    for i, n in rows:
        shards[sum(b <= i for b in bounds)] += n
    per_id = Counter()
    for i, n in rows:
        per_id[i] += n
    for shard, n in shards.items():
        ids = [i for i in per_id if sum(b <= i for b in bounds) == shard]
        assert n <= 400 or len(ids) == 1
    assert warc.shard_bounds(spark.createDataFrame([], "id long, bytes long"), 400) == []


def test_bucket_of_counts_bounds(spark):
    bounds = [3, 3 + 1, 10, 11, 50, 51, 52, 1000]
    rows = spark.range(0, 1100).select("id", bucket_of(F.col("id"), bounds).alias("b")).collect()
    assert all(r["b"] == sum(x <= r["id"] for x in bounds) for r in rows)


@pytest.mark.parametrize("bucket_chars", [16_000_000, 30_000])
def test_fingerprints(spark, sf_dir, table, bucket_chars, monkeypatch):
    monkeypatch.setattr(fingerprint, "BUCKET_CHARS", bucket_chars)
    found = {r["doc_id"]: r for r in queries.QUERIES["op8_fingerprint"](spark, sf_dir).collect()}
    rows = sorted(((r["doc_id"], r["text"]) for r in table("documents").collect()), reverse=True)
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
    prints = defaultdict(set)
    for i, text in rows:
        prints[text].add(found[i]["fingerprint"])
    assert max(map(len, prints.values())) == 1
    assert np.mean([r["near_edited"] > r["near_next"] for r in found.values()]) > 0.9


def plain_fingerprints(rows):
    """(fingerprint, edited fingerprint, near_edited, near_next) of each id, without Spark."""
    import math

    import regex
    import xxhash

    def hashed(text):
        h = xxhash.xxh64_intdigest(text.encode(), seed=42)
        return h - (1 << 64) if h >> 63 else h

    def words(text):
        return {hashed(w) for w in regex.split(fingerprint.NOT_A_TERM, text.lower()) if w}

    counts = Counter(c for _, t in rows for c in {w % fingerprint.CLASSES for w in words(t)})
    low, high = (len(rows) * math.exp(-x) for x in (fingerprint.MOST_IDF, fingerprint.LEAST_IDF))
    lexicon = {c for c, n in counts.items() if low <= n <= max(high, 1)}

    def hashes(text):
        every = words(text)
        inside = [w for w in every if w % fingerprint.CLASSES in lexicon]
        out, base = [], 0
        for ways, used in fingerprint.LEVELS:
            for s in range(used):
                mine = sorted((s + base << 44) | (w & fingerprint.HASH_BITS) | 1 for w in inside if (w >> 20) % ways == s)
                out.append(hashed("".join(f"{e}," for e in mine)) if mine else None)
            base += used
        if out[0] is None:
            out[0] = hashed(",".join(map(str, sorted(every))) if every else text)
        return [out[0], *(None if h is None else h % 65536 for h in out[1:])]

    def shown(h):
        return f"{h[0] % (1 << 64):016X}" + "".join("----" if x is None else f"{x:04X}" for x in h[1:])

    def alike(a, b):
        if a[0] == b[0]:
            return 1.0
        start, value = 1, 0.0
        for k, (_, used) in enumerate(fingerprint.LEVELS[1:]):
            pairs = [(x, y) for x, y in zip(a[start : start + used], b[start : start + used]) if x is not None or y is not None]
            if k == 0 or len(pairs) >= fingerprint.LEAST_FILLED:
                value = sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0
            start += used
        return value

    rows = sorted(rows, reverse=True)
    own, out = [hashes(t) for _, t in rows], {}
    for k, (i, text) in enumerate(rows):
        after, half = (k + 1) % len(rows), len(text) // 2
        changed = hashes(text[: len(text) - half] + rows[after][1][:half])
        out[i] = (shown(own[k]), shown(changed), alike(own[k], changed), alike(own[k], own[after]))
    return out


def test_fingerprints_match_plain_arithmetic(docs, table):
    rows = [(r["doc_id"], r["text"]) for r in table("documents").collect()]
    found = {r["doc_id"]: (r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"])
             for r in fingerprint.fingerprints(docs(rows)).collect()}
    expected = plain_fingerprints(rows)
    assert {i: f[:2] for i, f in found.items()} == {i: e[:2] for i, e in expected.items()}
    assert all(found[i][2:] == pytest.approx(expected[i][2:]) for i in expected)


def test_lexicon_of_a_table_and_its_copies(docs, table):
    """Ten copies of every document change no fingerprint: the band is of shares."""
    rows = [(r["doc_id"], r["text"]) for r in table("documents").limit(60).collect()]
    once = {r["doc_id"]: r["fingerprint"] for r in fingerprint.fingerprints(docs(rows)).collect()}
    many = fingerprint.fingerprints(docs([(10 * i + k, t) for i, t in rows for k in range(10)])).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in many} == {10 * i + k: once[i] for i, _ in rows for k in range(10)}


def test_fingerprints_of_odd_rows(docs, odd):
    found = fingerprint.fingerprints(docs(odd, extra=("bucket", "hashes", "edited"))).collect()
    assert len(found) == len(odd)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in found)
    assert {r["n_chars"] for r in found if r["doc_id"] in (1, 2)} == {0}
    assert fingerprint.fingerprints(docs([])).count() == 0
    one = fingerprint.fingerprints(docs([(1, "a few words only")])).first()
    assert one["near_next"] == 1.0 and one["edited_sha256"] == hashlib.sha256(b"a few wo" + b"a few wo").hexdigest()


def test_stages_keep_columns_and_rows(spark, sf_dir, docs, odd, table):
    columns = ("score", "kept", "copy", "id", "node", "rest")
    for rows in (docs(odd, extra=columns), docs([], extra=columns)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf_dir)
            if name != "packing":
                assert out.columns == rows.columns, name
            out.count()


def test_pipeline_end_to_end(spark, sf_dir, table):
    rows, kept = table("documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        rows = queries_store(stage(spark, rows, sf_dir))
        kept[name] = rows
    ids = lambda df: {r[0] for r in df.select("doc_id").distinct().collect()}
    everything = ids(table("documents"))
    assert ids(kept["near_dedup"]) <= ids(kept["exact_dedup"]) <= ids(kept["toxicity"]) <= everything
    norm = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert kept["exact_dedup"].count() == kept["toxicity"].select(norm).distinct().count()
    assert ids(kept["packing"]) == ids(kept["mixing"]) <= ids(kept["near_dedup"])
    assert corpus_pipeline.run(spark, sf_dir).count() == kept["packing"].count()


def queries_store(df):
    from flowlens.session import materialize

    return materialize(df, "stage")
