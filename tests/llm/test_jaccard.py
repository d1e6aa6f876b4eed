import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import components as components_module
from pairloom.llm import jaccard
from pairloom.llm.components import components
from pairloom.llm.jaccard import jaccard_groups
from pairloom.llm.shingles import shingle_set, word_hashes

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset([tuple(words)]) if len(words) < width else frozenset(zip(*(words[i:] for i in range(width))))


def brute(rows, width, percent):
    """Components by comparing every two different sets."""
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, s in enumerate(sets):
        if s:
            parent[root(i)] = root(first.setdefault(s, i))
    distinct = list(first.items())
    for i, (a, x) in enumerate(distinct):
        for b, y in distinct[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = root(i)
        if doc is not None:
            least[r] = min(doc, least.get(r, doc))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def corpus(seed, groups=12, copies=7):
    rng = random.Random(seed)
    passage = [f"shared{i}" for i in range(60)]
    rows, doc = [], 0
    for g in range(groups):
        base = [f"w{g}x{rng.randrange(400)}" for _ in range(rng.choice([12, 60, 140]))]
        if g % 3 == 0:
            base += passage
        for c in range(copies):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = f"edit{doc}x{rng.randrange(50)}"
            if rng.random() < 0.2:
                words = words[: -rng.randrange(1, 5)]
            rows.append((doc, " ".join(words)))
            doc += 1
    return rows


@pytest.mark.parametrize(("width", "percent", "long_list", "block"), [(3, 90, 128, 1024), (5, 80, 128, 1024), (3, 80, 3, 1024), (3, 90, 3, 4), (3, 70, 2, 3)])
def test_against_all_pairs(spark, monkeypatch, width, percent, long_list, block):
    monkeypatch.setattr(jaccard, "COMMON", 2)
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
    rows = corpus(width * percent + long_list)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard_groups(df, "doc_id", "text", width, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, width, percent)


def test_edge_cases(spark, docs, empty):
    df = docs.withColumns({"node": F.lit(1), "token": F.lit("x")})
    got = jaccard_groups(df, "doc_id", "text", 3, 90).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 90)
    assert jaccard_groups(empty, "doc_id", "text", 3, 90).count() == 0


def test_common_shingles_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 2)
    monkeypatch.setattr(jaccard, "COMMON_KEPT", 300)
    rows = corpus(5)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keys, counts, _ = jaccard.common_shingles(df.select("text"), 3)
    assert 0 < len(keys) <= 300 and counts.min() > 2
    got = jaccard_groups(df, "doc_id", "text", 3, 90).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 90)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(f"Word{i}" for i in range(500)) + " " + "y" * 300 + " end"
    whole = word_hashes(text)
    assert len(whole) == 502 and len(set(whole.tolist())) == 502
    from pairloom.llm import shingles

    monkeypatch.setattr(shingles, "_SLICE", 100)
    shingles._powers.cache_clear()
    parts = word_hashes(text)
    shingles._powers.cache_clear()
    assert len(parts) == 502
    assert sum(a != b for a, b in zip(whole.tolist(), parts.tolist())) <= 1


def test_shingles_tell_order_and_case():
    assert len(shingle_set("a b c A B C", 3)) == 3
    assert shingle_set("a b c", 3).tolist() != shingle_set("c b a", 3).tolist()
    assert shingle_set("a b", 3).tolist() != shingle_set("b a", 3).tolist()
    assert len(shingle_set(None, 3)) == len(shingle_set(" \t", 3)) == 0


def test_components_of_chains_stars_and_rings(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(200, 201), (201, 202), (202, 200), (300, 300)]
    random.Random(2).shuffle(links)
    df = spark.createDataFrame([(b, a) if i % 2 else (a, b) for i, (a, b) in enumerate(links)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200, 202: 200}
    assert got == want


@pytest.mark.parametrize("at_once", [3, 1000])
def test_components_of_stretches_of_links(spark, monkeypatch, at_once):
    """However many links a task joins at once, names as well as numbers, and repeated links."""
    monkeypatch.setattr(components_module, "LINKS_AT_ONCE", at_once)
    rng = random.Random(at_once)
    links = [(f"n{a:02}", f"n{a + rng.choice([1, 2, 30]):02}") for a in range(0, 60, 2)] * 2 + [("x", "x"), ("y", None)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u string, v string").repartition(5)).collect()}
    want = {n: n for pair in links[:] if None not in pair and pair[0] != pair[1] for n in pair}
    for _ in want:
        for a, b in links:
            if a in want and b in want:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_links_that_are_few_take_few_jobs(spark):
    """Links of one stretch, a long chain here, take no rounds; before, each round was four jobs or more."""
    links = spark.createDataFrame([(i, i + 1) for i in range(64)], "u bigint, v bigint")
    spark.sparkContext.setJobGroup("few links", "")
    try:
        found = components(links)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few links")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r["root"] for r in found.collect()} == {0} and found.count() == 65
    assert len(jobs) <= 6


def test_long_words_do_not_collide(spark):
    """Words that equal each other modulo 2 ** 64 for every base of a polynomial."""
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert len({int(word_hashes(w)[0]) for w in (word, other, word[:1024], other[:1024], word[:65], other[:65])}) == 6
    texts = [(1, f"one {word} two three"), (2, f"one {other} two three"), (3, f"one {word} two three")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_groups(docs, "doc_id", "text", 3, 90).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_pairs_are_put_together_in_parts(monkeypatch):
    rng = random.Random(4)
    lists = []
    for size in (0, 1, 2, 40, 3, 25):
        nodes = [(rng.choice([-7, 5]) * rng.randrange(1, 1 << 60), rng.randrange(20, 40)) for _ in range(size)]
        lists.append([{"k": k, "p": n << 32 | rng.randrange(5), "q": rng.randrange(1, 5) << 32 | rng.randrange(3)} for k, n in nodes])
    want = []
    for own in lists:
        rows = [(m["k"], m["p"] >> 32, m["p"] & 0xFFFFFFFF, m["q"] >> 32, m["q"] & 0xFFFFFFFF) for m in own]
        for i, a in enumerate(rows):
            for b in rows[:i]:
                x, y = (a, b) if a[0] < b[0] else (b, a)
                if min(x[1], y[1]) * 100 >= 80 * max(x[1], y[1]):
                    want.append((x[0], y[0], min(x[3], y[3]) - min(x[4], y[4]), x[1] - x[2], y[1] - y[2], x[1] + y[1]))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in "kpq"]))
    batch = pa.RecordBatch.from_arrays([pa.array([[], *lists], kind)], names=["members"]).slice(1)
    monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 50)
    parts = list(jaccard._pairs(80)([batch]))
    assert max(p.num_rows for p in parts) <= 50 and len(parts) > 5
    assert sorted(tuple(r.values()) for p in parts for r in p.to_pylist()) == sorted(want)


@pytest.mark.parametrize("size", [1, 40, 1000, 1030, 5000])
def test_parities_never_differ_in_more_bits_than_sets_in_shingles(size):
    words = [f"w{i}" for i in range(size + 2)]
    left = shingle_set(" ".join(words), 3)
    for cut in (0, 1, 25, 60, size):
        right = shingle_set(" ".join(words[cut:] + [f"x{i}" for i in range(cut // 2)]), 3)
        apart = len(np.setxor1d(left, right))
        bound = jaccard._apart(jaccard._parity(left), jaccard._parity(right))
        assert bound == jaccard._apart(jaccard._parity(right), jaccard._parity(left)) <= apart
        assert bound >= min(apart, 100) // 2


def test_texts_of_pairs_far_apart_are_not_sent(spark, monkeypatch):
    """Documents that share half of their words, which the prefixes alone do not tell from near ones."""
    rng = random.Random(6)
    rows = []
    for g in range(20):
        base = [f"g{g}w{i}" for i in range(200)]
        rows += [(10 * g + c, " ".join(base[:130] + [f"g{g}c{c}x{rng.randrange(10**6)}" for _ in range(70)])) for c in range(3)]
    rows += [(1001, "one two three four five"), (1000, "one two three four five six seven eight nine ten eleven twelve"),
             (1002, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    asked, texts_of = [], jaccard._texts_of
    monkeypatch.setattr(jaccard, "_texts_of", lambda keys, *rest: asked.append(keys.count()) or texts_of(keys, *rest))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard_groups(df, "doc_id", "text", 3, 90).collect()
    assert asked == [2]
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 3, 90)
