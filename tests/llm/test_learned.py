"""Language models, toxicity and URL models: held-out accuracy and brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.llm import language_id, queries, toxicity, url_filter
from flowlens.llm.text import U64


def test_language_query_is_right_on_held_out_rows(spark, sf_dir, table):
    found = queries.QUERIES["op1_language_id"](spark, sf_dir).toPandas()
    truth = table("documents").toPandas().set_index("doc_id")["lang"]
    assert len(found) == len(truth)
    folds = found["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)
    assert (folds == found["held_out"]).all() and found["score"].between(0, 1).all()
    held = found[found["held_out"]]
    assert (held["lang_pred"] == held["doc_id"].map(truth)).mean() > 0.97


def brute_kneser_ney(counts):
    """Interpolated Kneser-Ney from 4-gram counts, straight from its definition."""
    levels = [counts]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))
    levels.reverse()
    vocabulary = len({g for g in levels[0]}) + 1

    def p(gram):
        if not gram:
            return 1 / vocabulary
        table = levels[len(gram) - 1]
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        followers = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        if not followers:
            return p(gram[1:])
        return max(table.get(gram, 0) - d, 0) / sum(followers) + d * len(followers) / sum(followers) * p(gram[1:])

    return p


def test_probabilities_match_the_definition():
    text = b"the cat and the hat sat on that mat"
    codes, _, _ = language_id.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    kinds, n = np.unique(codes, return_counts=True)
    models = language_id.CharacterModels(pd.DataFrame({"lang": "en", "code": kinds.view(np.int64), "n": n}))
    letters = lambda c: tuple(int(c) >> s & 0xFFFF for s in (48, 32, 16, 0))
    p = brute_kneser_ney(Counter({letters(c): int(k) for c, k in zip(kinds, n)}))
    other = b"a new hat is a zebra"
    asked = np.unique(np.concatenate([codes, language_id.grams(np.frombuffer(other, np.uint8), np.array([0, len(other)]))[0]]))
    np.testing.assert_allclose(models.probabilities(asked, 4)[:, 0], [p(letters(c)) for c in asked], rtol=1e-9)


def test_hash_array_finds_all_and_only_its_codes():
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(0, 1 << 60, 5000).astype(U64))
    array = language_id.HashArray(codes[::2], np.arange(len(codes[::2])))
    at = array.find(codes)
    assert (at[1::2] == -1).all() and (array.values[at[::2]] == np.arange(len(codes[::2]))).all()


def test_language_of_odd_rows(docs, odd):
    rows = docs([*odd, *[(100 + i, "the cat sat on the mat" if i % 2 else "der hund und das haus", "en" if i % 2 else "de") for i in range(40)]],
                extra=("score", "train", "bit"))
    found = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(rows, F.lit(True)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (9, "und"), (101, "en"), (100, "de")} <= found
    empty = language_id.identify(docs([]), F.lit(True))
    assert empty.count() == 0
    untaught = language_id.identify(docs([(1, "word", None)]), F.lit(True)).first()
    assert (untaught["lang_pred"], untaught["score"], untaught["rejected"]) == ("und", 0.0, True)


def test_characters_above_16_bits(docs):
    emoji, rare = "\U0001F914 \U0001F923\U0001F97A", "\U00020BB7\U00020BB8 \U00020BB7"
    raw = [t.encode() for t in (emoji, rare, "a" + emoji)]
    codes, of, letters = language_id.grams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert letters.tolist() == [0, 3, 1] and np.bincount(of, minlength=3).tolist() == [0, 7, 2]
    assert len({int(c) & 0xFFFFFFFF for c in codes[of == 1]}) > 2
    rows = docs([(1, emoji), (2, rare), *[(10 + i, "the cat sat" if i % 2 else rare * 3, "en" if i % 2 else "zh") for i in range(40)]])
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(rows, F.lit(True)).collect()}
    assert found[1] == ("und", 0.0) and found[2][0] == "zh" and found[2][1] > 0.5


def test_model_in_parts_is_the_whole_model(docs):
    """However few grams a part may have, none is lost, nor a small language beside a large one."""
    rng = np.random.default_rng(6)
    words = {lang: ["".join(rng.choice(list(letters), 5)) for _ in range(60)] for lang, letters in (("aa", "abcdefgh"), ("bb", "efghijkl"))}
    rows = [(i, " ".join(rng.choice(words[lang], 12)), lang) for i in range(300) for lang in ["bb" if i % 30 == 0 else "aa"]]
    whole, parts = ({r["doc_id"]: r for r in language_id.identify(docs(rows), F.lit(True), max_grams=most).collect()}
                    for most in (language_id.MAX_GRAMS, 40))
    assert all(whole[i]["lang_pred"] == parts[i]["lang_pred"] == lang for i, _, lang in rows)
    for i in whole:
        assert parts[i]["cross_entropy"] == pytest.approx(whole[i]["cross_entropy"], rel=1e-6)
        assert parts[i]["score"] == pytest.approx(whole[i]["score"], rel=1e-6)


def toxic_rows(n=600):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        text = [" ".join(rng.choice(words, 8)) for _ in range(rng.integers(1, 12))]
        toxic = i % 5 == 0
        if toxic:
            k = rng.integers(0, len(text))
            text[k] += " " + rng.choice(["blockhead", "Nitwit", "dunce"])
        rows.append((i, ". ".join(text) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def taught(spark, docs):
    rows, labels = toxic_rows()
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs(rows), "doc_id", "text", frame, "toxic", F.col("id") % 3 != 0)
    return rows, labels, model


def test_toxicity_and_its_sentences(docs, taught):
    rows, labels, model = taught
    truth = dict(labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs(rows), model).collect()}
    held = [i for i in truth if i % 3 == 0]
    assert sum(found[i]["predicted"] == truth[i] for i in held) / len(held) > 0.98
    text = dict(rows)
    for i in held:
        if truth[i] and found[i]["predicted"]:
            spans = [text[i].encode()[s["start"] : s["start"] + s["length"]].decode().lower() for s in found[i]["offending"]]
            assert any(w in s for s in spans for w in ("blockhead", "nitwit", "dunce")) and all("." not in s for s in spans)
    assert {r["doc_id"] for r in toxicity.keep_clean(docs(rows), model).collect()} == {i for i, r in found.items() if not r["predicted"]}


def test_score_is_the_noisy_or_of_the_sentences(docs, taught):
    _, _, model = taught
    parts = ["a plain one here", "you blockhead", "a dunce and a nitwit"]
    rows = [*enumerate(parts), (9, ". ".join(parts))]
    s = {r["doc_id"]: r["score"] for r in toxicity.score(docs(rows), model).collect()}
    assert s[9] == pytest.approx(1 - math.prod(1 - s[i] for i in range(3)))


def test_toxicity_of_odd_rows(spark, docs, odd, taught):
    found = toxicity.score(docs(odd, extra=("score", "label")), taught[2]).collect()
    assert len(found) == len(odd) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in found if r["doc_id"] in (1, 2, 3, 9)} == {0.0}
    assert toxicity.keep_clean(docs(odd, extra=("score", "rest")), taught[2]).count() == len(odd)
    assert toxicity.score(docs([]), taught[2]).count() == 0
    none = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs(odd), "doc_id", "text", none, "toxic", F.lit(True))
    assert {r["predicted"] for r in toxicity.score(docs(odd), model).collect()} == {0}


def test_toxicity_query_on_held_out_rows(spark, sf_dir, table):
    found = queries.QUERIES["op3_toxicity"](spark, sf_dir).toPandas().set_index("doc_id")
    assert len(found) == table("documents").count()
    assert (found["held_out"] == found.index.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((found["score"] >= 0.5) == (found["predicted"] == 1)).all()


URLS = [
    ("HTTP://News.Example.ORG/es/1?q#f", "news.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/17", "example.org", "/en/17", "example.org/en/1", "block"),
    ("https://example.org/en/27", "example.org", "/en/27", "org/", "allow"),
    ("http://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"), ("http://a.com/de/x", "a.com", "/de/x", "com/de/", "block"),
    ("http://forg/x", "forg", "/x", None, None), ("http://x.org", "x.org", "", None, None), ("x.org/a", "", "", None, None),
    (None, "", "", None, None), ("", "", "", None, None), ("http://h?x://y.org/", "h", "", None, None),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    found = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[i]
        assert r["verdict"] == verdict if verdict else r["verdict"] in ("allow", "block")
    assert url_filter.judge(df.limit(0)).count() == 0


def test_urls_of_every_kind(spark, table):
    """A very long URL, repeated rows, NULL ids and urls, and columns with the names used inside."""
    import time

    rows = [(r["page_id"], r["url"]) for r in table("pages").limit(120).collect()]
    odd = [(None, rows[0][1]), (None, None), (5000, rows[1][1]), (5000, rows[1][1]), (5001, ""), (5002, "data:" + "x%20" * 25_000),
           (5003, "http://a.example/" + "é" * 30_000)]
    names = ["score", "grams", "ruled", "key", "host", "id", "verdict"]
    schema = "page_id long, url string, " + ", ".join(f"{n} string" for n in names)
    df = spark.createDataFrame([(*r, *names) for r in rows + odd], schema)
    start = time.perf_counter()
    found = url_filter.judge(df).collect()
    assert time.perf_counter() - start < 60
    assert Counter(r["page_id"] for r in found) == Counter(i for i, _ in rows + odd)
    assert {r["verdict"] for r in found} <= {"allow", "block"} and all(r["score"] is not None for r in found)
    scores = {}
    for r in found:
        scores.setdefault((r["host"], r["path"], r["page_id"]), set()).add(r["score"])
    assert len({r["score"] for r in found if r["page_id"] == 5000}) == 1
    assert next(r for r in found if r["page_id"] == 5003)["path"] == "/" + "é" * 30_000


def test_url_scores_match_brute_force(spark, table):
    pages = table("pages").select("page_id", "url")
    found = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    rows = {r["page_id"]: r["url"] for r in pages.collect()}
    held = {r["url"]: r["h"] for r in pages.select("url", (F.pmod(F.xxhash64("url", F.lit(5)), F.lit(4)) == 0).alias("h")).collect()}
    ruled = {i: (found[i]["verdict"] if found[i]["rule"] else None) for i in rows}
    counts = {v: [defaultdict(float) for _ in range(7)] for v in ("allow", "block")}

    def grams(url):
        text = "\x02" * 4 + url + "\x03"
        return [text[k : k + 5] for k in range(len(url) + 1)]

    for i, url in rows.items():
        if ruled[i] and not held[url]:
            for g in grams(url):
                for k in range(6):
                    counts[ruled[i]][k][g[5 - k :]] += 1
                    counts[ruled[i]][6][(k, g[5 - k : 4])] += 1

    def p(verdict, gram, k):
        if not k:
            return 1 / url_filter.ALPHABET
        tail = gram[5 - k :]
        whole = counts[verdict][6][(k, tail[:-1])]
        return (counts[verdict][k][tail] + url_filter.STRENGTH * p(verdict, gram, k - 1)) / (whole + url_filter.STRENGTH)

    for i in list(rows)[:60]:
        g = grams(rows[i])
        score = sum(math.log(p("allow", x, 5) / p("block", x, 5)) for x in g) / len(g)
        assert found[i]["score"] == pytest.approx(score, abs=1e-9)
    taught = [(found[i]["score"] > 0) == (ruled[i] == "allow") for i in rows if ruled[i]]
    assert np.mean(taught) > 0.8
