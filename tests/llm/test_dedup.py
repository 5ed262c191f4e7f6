"""Exact and near duplicates, repeated passages: brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from flowlens.llm import exact_dedup, near_dedup, substring

UPPER = str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER)


def exact_truth(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(UPPER)].append(r[0])
    return groups


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_duplicates_of_odd_rows(spark, docs, odd, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = exact_dedup.exact_duplicates(docs(odd)).collect()
        staying = exact_dedup.keep_one(docs(odd, extra=("kept", "part", "id", "sha"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    truth = exact_truth(odd)
    assert len(found) == len(odd)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in truth.items()}
    for r in found:
        ids = by_sha[r["text_sha256"]]
        top = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (top, len(ids)) and (not r["kept"] or r["doc_id"] == top)
    assert Counter(r["text_sha256"] for r in found if r["kept"]) == Counter(dict.fromkeys(by_sha, 1))
    assert len(staying) == len(truth) and staying[0]["kept"] == "x"


def test_exact_group_over_many_partitions(spark, docs):
    rows = [(i, "Copy " * 3 if i % 3 == 0 else f"text {i % 50}") for i in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = exact_dedup.content_sort(docs(rows).selectExpr("doc_id as id", "text"))
        copies = stored.filter(f"sha = '{hashlib.sha256(b'copy copy copy ').hexdigest()}'")
        assert copies.select("part").distinct().count() > 2
        found = {r["doc_id"]: r for r in exact_dedup.exact_duplicates(docs(rows)).collect()}
        staying = {r["doc_id"] for r in exact_dedup.keep_one(docs(rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    truth = exact_truth(rows)
    for ids in truth.values():
        assert all(found[i]["keep_id"] == max(ids) and found[i]["group_size"] == len(ids) for i in ids)
    assert staying == {max(ids) for ids in truth.values()}


def test_empty_tables(docs):
    assert exact_dedup.exact_duplicates(docs([])).count() == 0
    assert exact_dedup.keep_one(docs([])).count() == 0
    assert near_dedup.near_duplicates(docs([])).count() == 0
    assert near_dedup.keep_one(docs([])).count() == 0
    assert substring.repeated_passages(docs([])).count() == 0


def shingles(text):
    words = re.findall(r"[a-z0-9]+", (text or "").lower())
    if len(words) < 5:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*[words[k:] for k in range(5)]))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def variants(seed=3):
    """Groups of edited copies from none to many edits, a large hot group, and unrelated texts."""
    rng, rows = random.Random(seed), []
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(800)]
    for g in range(25):
        base = rng.choices(words, k=200)
        for _ in range(40 if g == 0 else 4):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 4, 6, 9])):
                copy[rng.randrange(200)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(1000 + i, " ".join(rng.choices(words, k=150))) for i in range(60)]


def test_near_duplicate_links(docs):
    rows = variants()
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(rows)).collect()}
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b, jaccard(sets[a], sets[b])) for a in sets for b in sets if a < b]
    # idf tells shingles apart by 10 % at most, so these bounds hold for the weighted similarity too
    surely = [(a, b) for a, b, s in links if s >= 0.83]
    assert len(surely) > 100 and all(found[a] == found[b] for a, b in surely)
    maybe = {i: {i} for i in sets}
    for a, b, s in links:
        if s >= 0.77:
            joined = maybe[a] | maybe[b]
            for x in joined:
                maybe[x] = joined
    assert all(found[i] in maybe[i] for i in sets)
    assert {i for i, c in found.items() if i >= 1000 and c != i} == set()
    staying = {r["doc_id"] for r in near_dedup.keep_one(docs(rows)).collect()}
    assert staying == set(found.values())


def near_the_limit(seed=5):
    """Copies of one text whose pairs lie round 0.8, so that classes hang on single links; two lengths."""
    rng, rows = random.Random(seed), []
    words = ["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(3000)]
    for length, copies in ((200, 90), (320, 60)):
        base = rng.choices(words, k=length)
        for _ in range(copies):
            copy = list(base)
            for place in rng.sample(range(length), rng.choice([2, 3, 4, 5, 6])):
                copy[place] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_every_candidate_pair_is_decided_exactly(spark, docs, monkeypatch):
    """Classes are what all pairs with a common band and a weighted Jaccard similarity of 0.8 connect."""
    import numpy as np

    from flowlens.llm.text import Words, counted

    blocks = near_dedup.block_links
    monkeypatch.setattr(near_dedup, "block_links", lambda busy, profiled, threshold: blocks(busy, profiled, threshold, nodes=16))
    rows = near_the_limit()
    df = docs(rows)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(df).collect()}
    sampler = near_dedup.Sampler(near_dedup.shingle_weights(near_dedup.counter_sums(df, "text")))
    bands = {r["id"]: set(r["bands"]) for r in near_dedup.sketches(df, "doc_id", "text", spark.sparkContext.broadcast(sampler)).collect()}
    sets = {}
    for i, text in rows:
        data = np.frombuffer(text.encode(), np.uint8)
        values, _, counts = counted(*Words(data, np.array([0, len(data)])).shingles(5))
        sets[i] = dict(zip(values.tolist(), sampler.weigh(values, counts).astype(float).tolist()))
    top, decided = {i: i for i in sets}, Counter()

    def head(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in range(a):
            if bands[a] & bands[b]:
                common = sum(min(w, sets[b].get(v, 0)) for v, w in sets[a].items())
                sim = common / (sum(sets[a].values()) + sum(sets[b].values()) - common)
                decided["near" if abs(sim - 0.8) < 0.03 else "far"] += 1
                if sim >= 0.8:
                    x, y = head(a), head(b)
                    top[max(x, y)] = min(x, y)
    assert decided["near"] > 300 and len({head(i) for i in sets}) > 5
    assert found == {i: head(i) for i in sets}


def test_common_weights():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(40):
        n = int(rng.integers(2, 12))
        split = int(rng.integers(1, n))
        values = [np.sort(rng.choice(30, rng.integers(0, 20), replace=False)) for _ in range(n)]
        weights = [(1 + 0.01 * v) * rng.integers(1, 4, len(v)) for v in values]
        sets = [dict(zip(v.tolist(), w.tolist())) for v, w in zip(values, weights)]
        expected = [[sum(min(w, sets[b].get(v, 0)) for v, w in sets[a].items()) for b in range(split, n)] for a in range(split)]
        assert np.allclose(near_dedup.common_weights(values, weights, split, columns=7), expected)


def test_weight_bounds_lose_no_link(docs):
    """Classes with the bound are those without it."""
    rows = variants(8)
    with_bound = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(rows)).collect()}
    whole = near_dedup.weight_bounds
    near_dedup.weight_bounds = lambda busy, profiled: profiled.selectExpr(
        "node", "aggregate(weights, 0d, (a, w) -> a + w) as whole", "aggregate(weights, 0d, (a, w) -> a + w) as open")
    try:
        without = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs(rows)).collect()}
    finally:
        near_dedup.weight_bounds = whole
    assert with_bound == without


def test_near_duplicates_of_odd_rows(docs, odd):
    found = near_dedup.near_duplicates(docs(odd)).collect()
    assert len(found) == len(odd)
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add(r["class_id"])
    assert by_id[5] == by_id[4] == {4} and by_id[6] == by_id[7] == {6}
    assert by_id[1] == by_id[2] == {1} and by_id[3] == {3} and by_id[9] == {9} and by_id[8] == {8}
    staying = near_dedup.keep_one(docs(odd, extra=("node", "class_id", "maybe"))).collect()
    assert Counter(r["doc_id"] for r in staying) == Counter([1, 3, 4, 6, 8, 9, 10, None])
    assert staying[0]["node"] == "x"


def brute_passages(rows, words):
    held = defaultdict(set)
    for i, text in rows:
        parts = (text or "").split(" ")
        for k in range(len(parts) - words + 1):
            held[tuple(parts[k : k + words])].add(i)
    return set().union(*(ids for ids in held.values() if len(ids) > 1))


def test_passages_resist_insertions(docs):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    passage = rng.choices(words, k=70)
    rows = []
    for i in range(120):
        text = rng.choices(words, k=rng.randint(60, 300))
        if i % 4 == 0:
            at = rng.randrange(len(text))
            text[at:at] = passage
        rows.append((i, " ".join(text)))
    spans = substring.repeated_passages(docs(rows)).collect()
    found = {r["doc_id"] for r in spans}
    assert found == {i for i in range(120) if i % 4 == 0} == brute_passages(rows, 50)
    text = dict(rows)
    for r in spans:
        part = text[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]].decode()
        assert part in text[r["first_id"]] and r["removed"] == (r["doc_id"] != r["first_id"])
    clean = dict(map(tuple, substring.without_repeats(docs(rows)).collect()))
    assert clean[0] == text[0] and len(clean[4]) < len(text[4]) and clean[1] == text[1]


def shared_words(rows, size):
    """Of each text, the numbers of the words that are in a run of ``size`` words another text has."""
    held = defaultdict(set)
    split = {i: text.split(" ") for i, text in rows}
    for i, parts in split.items():
        for k in range(len(parts) - size + 1):
            held[tuple(parts[k : k + size])].add(i)
    return {i: {k + j for k in range(len(parts) - size + 1) if len(held[tuple(parts[k : k + size])]) > 1 for j in range(size)}
            for i, parts in split.items()}


@pytest.mark.parametrize("size", [30, 51, 55, 60])
def test_passages_just_long_enough_are_all_found(docs, size):
    rng = random.Random(size)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(3000)]
    rows = []
    for _ in range(200):  # each passage in two texts, and its middle in a third that comes first
        passage = rng.choices(words, k=size)
        for part in (passage[10:size - 10], passage, passage):
            text = rng.choices(words, k=rng.randint(20, 120))
            at = rng.randrange(len(text))
            rows.append((len(rows), " ".join(text[:at] + part + text[at:])))
    found = defaultdict(set)
    text = dict(rows)
    for r in substring.repeated_passages(docs(rows)).collect():
        raw = text[r["doc_id"]].encode()
        first = raw[: r["start"]].count(b" ")
        assert raw[r["start"] : r["start"] + r["length"]].count(b" ") + 1 == r["words"] >= 30
        found[r["doc_id"]] |= set(range(first, first + r["words"]))
    truth = shared_words(rows, 30)
    assert {i: found[i] for i in text} == truth and all(len(truth[i]) >= size for i in text if i % 3)


def test_no_passage_is_removed_everywhere(docs):
    """Text 2 has words of text 1, and then words that only text 3 has too."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(120)]
    rows = [(1, " ".join(words[:40])), (2, " ".join(words)), (3, " ".join(words[40:]))]
    kept = dict(map(tuple, substring.without_repeats(docs(rows)).collect()))
    assert kept[1] == rows[0][1] and kept[2].split() == words[40:] and kept[3] == ""


def test_passages_of_odd_rows(docs, odd):
    spans = substring.repeated_passages(docs(odd, extra=("hi", "start"))).collect()
    assert {r["doc_id"] for r in spans} == {4, 5}
    assert substring.without_repeats(docs(odd)).count() == len({tuple(r) for r in odd}) + 1


def text_chunks(text, size=30):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return substring.Windows(data, np.array([0, len(data)]), size)


def test_cuts_are_the_smallest_gear_hash_of_each_run():
    import numpy as np

    rng = random.Random(2)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(400)]
    for size in (3, 12, 30):
        text = "  ".join(words)
        data = np.frombuffer(text.encode(), np.uint8)
        gear = [sum(int(substring.GEAR[b]) << k for k, b in enumerate(data[max(0, i - 31) : i + 1][::-1])) % 2**32 for i in range(len(data))]
        runs, spans = text_chunks(text, size), [m.span() for m in re.finditer(rb"\S+", text.encode())]
        for i, place in enumerate(runs.place):
            ends = [j for j in range(i, i + size) if spans[j][1] - spans[i][0] >= 32] or [i + size - 1]
            assert place == min(ends, key=lambda j: (gear[spans[j][1] - 1], j))


def test_chunks_resist_shifts():
    """An insertion changes the chunks that it touches; the others keep their digests."""
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8))) for _ in range(900)]
    before = text_chunks(" ".join(words))
    after = text_chunks(" ".join(words[:300] + ["inserted words"] + words[300:]))
    a, b = set(before.anchor.tolist()), set(after.anchor.tolist())
    assert 60 < len(a) < 250 and len(a - b) <= 6 and len(b - a) <= 6
    lengths = Counter(before.place.tolist()).values()
    assert len(set(lengths)) > 5 and max(lengths) <= 30  # variable, and never further apart than a run


def test_gear_hash_places_the_cuts(docs, monkeypatch):
    """Other gear values give other chunks and the same passages."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=40) + words[:45] + rng.choices(words, k=40))) for i in range(6)]
    found = sorted(map(tuple, substring.repeated_passages(docs(rows)).collect()))
    places = text_chunks(rows[0][1]).place.tolist()
    monkeypatch.setattr(substring, "GEAR", substring.GEAR[::-1].copy())
    assert text_chunks(rows[0][1]).place.tolist() != places
    assert sorted(map(tuple, substring.repeated_passages(docs(rows)).collect())) == found and len(found) >= 6
