"""Phrases, language-model scores and ranked search against plain loops."""

import re
import zlib
from collections import Counter, defaultdict
from math import floor, log, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import collocations as phrases
from pairloom.llm import lexical, logbloom
from conftest import make_docs

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWERED = str.maketrans(UPPER, LOWER)

EXTRA = [
    "new york city is big. New York City is old; new york city\tis far",
    "in new york city, is new york\x0bnew york city is new york city is",
    "a b a b   ÄB äb\x00c\x00c",
    "tie one tie one tie one! tie two tie two tie two",
    ".,;:!?\n\n .. ,",
]


def some_docs(spark):
    # Columns with clashing names must not matter.
    docs = make_docs(spark, [*EXTRA * 3], "1 AS phrase").withColumns({"row": F.lit(1), "a": F.lit("x"), "rank": F.lit(0)})
    return docs.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, None).otherwise(F.col("lang")))


def plain_collocations(rows, least, longest, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWERED)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, seen in counts.items():
        known = {p: a for p, a in seen.items() if a >= least}
        found = []
        for p, a in known.items():
            if len(p) < 2:
                continue
            around = [b for q, b in known.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 100 * a for b in around):
                continue
            cuts = [(1000 * a * totals[lang] // (known[p[:k]] * known[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found.append((lang, " ".join(p), a, known[p[:k]], known[p[k:]], totals[lang], score))
        found.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(found[:top])]
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 300])
def test_collocations(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(phrases, "SHARD_BYTES", shard_bytes)
    docs = some_docs(spark)
    rows = [(r["text"], r["lang"]) for r in docs.select("text", "lang").collect()]
    for least, top in ((3, 2000), (6, 3)):
        got = phrases.collocations(docs, "text", "lang", least, 5, top, shards=3).collect()
        assert sorted(tuple(r) for r in got) == plain_collocations(rows, least, 5, top)
        assert got


def test_shards_of_small_share_name_no_phrase_in_vain(spark):
    docs = spark.createDataFrame([("x y z " * 50, "en")] * 4 + [("p q", "en")] * 99, "text string, lang string").repartition(6)
    mined = phrases.phrase_counts(docs, "text", "lang", least=100)
    kept = {r["phrase"]: r["a"] for r in mined.collect()}
    assert kept["x y"] == 200 and kept["z x"] == 196 and "p q" not in kept
    assert kept[None] == 4 * 150 + 99 * 2


def test_collocations_of_nothing(spark, empty):
    result = phrases.collocations(empty, "text", "lang")
    assert result.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and result.count() == 0


def test_scores_beyond_64_bits(spark):
    expression = "cast((cast(1000 as decimal(38,0)) * a * n) div (cast(l as decimal(38,0)) * r) as bigint)"
    a, n, l, r = 2**40, 2**40, 2**40 + 1, 2**40 + 3
    row = spark.createDataFrame([(a, n, l, r)], "a bigint, n bigint, l bigint, r bigint").selectExpr(f"{expression} AS s").first()
    assert row["s"] == 1000 * a * n // (l * r)


def words_of(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWERED)), None]


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def plain_scores(rows):
    """Exact base; and the model with exact levels, as if the filter never erred."""
    single, double, texts = Counter(), Counter(), 0
    out_of = {i: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    for i, (_, text) in enumerate(rows):
        if not out_of[i]:
            tokens = words_of(text)
            single.update(tokens)
            double.update(zip([0, *tokens[:-1]], tokens))
            texts += 1
    total, per = sum(single.values()), sum(single.values()) + len(single) + 1

    def about(count, least):
        table = logbloom.count_of_level(least)
        return table[int(logbloom.levels_of(np.array([count]), least)[0])]

    result = []
    for i, (doc_id, text) in enumerate(rows):
        tokens = words_of(text)
        score = 0.0
        for before, token in zip([0, *tokens[:-1]], tokens):
            history = texts if before == 0 else about(single[before], 1)
            both = min(about(double[before, token], 2), history)
            score += log10((both + logbloom.PRIOR * (about(single[token], 1) + 1) / per) / (history + logbloom.PRIOR))
        base = sum(log10((single[t] + 1) / per) for t in tokens)
        result.append((doc_id, out_of[i], len(tokens), sum(single[t] > 0 for t in tokens), total, base, score))
    return result


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[5]))


@pytest.mark.parametrize(
    "heads, slice_bytes, bucket_text", [(1 << 20, 1 << 30, 1 << 21), (4, 1 << 30, 4096), (4, 3000, 2048), (0, 1, 1024)]
)
def test_language_scores(spark, monkeypatch, heads, slice_bytes, bucket_text):
    monkeypatch.setattr(logbloom, "BUCKET_TEXT", bucket_text)
    docs = some_docs(spark)
    got = logbloom.language_scores(docs, "doc_id", "text", held_out(), heads=heads, slice_bytes=slice_bytes)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = by_id([tuple(r) for r in got.collect()])
    want = by_id(plain_scores([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        # One probe in a hundred may err, upwards and by a level.
        assert g[6] == pytest.approx(w[6], abs=0.6 + 0.02 * g[2])


def test_filter_never_forgets_and_seldom_errs():
    rng = np.random.default_rng(5)
    grams = np.unique(rng.integers(0, 2**63, 40_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.zipf(1.3, len(grams)).clip(max=10**9)
    bloom = logbloom.LogBloom(1, {0: logbloom.filled_bits(grams, logbloom.levels_of(counts, 1))}, 1)
    exact = logbloom.count_of_level(1)[logbloom.levels_of(counts, 1)]
    found = bloom.counts(grams)
    assert (found >= exact).all() and (found > exact).mean() < 0.02
    assert (bloom.counts(grams + np.uint64(1)) > 0).mean() < 0.02
    folded = np.frombuffer(logbloom.filled_bits(grams, logbloom.levels_of(counts, 1)), np.uint8)
    folded = folded[: len(folded) // 2] | folded[len(folded) // 2 :]
    assert (logbloom.LogBloom(1, {0: folded.tobytes()}, 1).counts(grams) >= exact).all()


def test_slices_hold_every_bucket():
    assert logbloom._slices([(0, 5), (1, 5), (3, 6), (4, 20), (5, 1)], 10) == [(0, 1), (3, 3), (4, 4), (5, 5)]
    assert logbloom._slices([], 10) == [(0, 0)]


def test_scores_without_training_texts(spark, empty):
    assert logbloom.language_scores(empty, "doc_id", "text", held_out()).count() == 0
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    rows = logbloom.language_scores(docs, "doc_id", "text", F.lit(True)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows] == [
        (3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)
    ]


def plain_search(docs, items, k):
    terms = [re.findall(lexical.TERM, (text or "").translate(LOWERED)) for _, text in docs]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    counted = [Counter(t) for t in terms]
    df = Counter(t for c in counted for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, _), found, all_ in zip(docs, counted, terms):
            if not all_:
                continue
            m = 25 + (75 * len(all_) * n_docs) // total
            score = 0
            for term in re.findall(lexical.TERM, (text or "").translate(LOWERED)):
                if found[term]:
                    weight = floor(1000 * log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += weight * ((1_000_000_000 * found[term]) // (1000 * found[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank + 1, s[3], -s[0]) for rank, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k])]
    return sorted(out, key=str)


ITEMS = [(1, "new york city"), (2, "A b, C"), (2, "tie tie one"), (3, None), (4, "..."), (5, "äb word日本語"), (None, "quick quick fox zebra"), (6, "zebra")]


@pytest.mark.parametrize("owners, block, bundle, pairs", [(4, 2048, 256, 1 << 20), (1, 3, 2, 1 << 20), (3, 5, 3, 4)])
def test_ranked_search(spark, monkeypatch, owners, block, bundle, pairs):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    monkeypatch.setattr(lexical, "RUN_PAIRS", pairs)
    docs = some_docs(spark)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("row", F.lit("x"))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for k in (3, 10):
        got = lexical.ranked_search(docs, "doc_id", "text", items, "item_id", "text", k, owners)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(rows, ITEMS, k)


def test_ranked_search_of_nothing(spark, empty):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.ranked_search(empty, "doc_id", "text", items, "item_id", "text").count() == 0
    assert lexical.ranked_search(make_docs(spark), "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_scores_do_not_depend_on_the_size_of_the_word_filter(spark, monkeypatch):
    monkeypatch.setattr(logbloom, "BUCKET_TEXT", 512)
    texts = [(i, " ".join(f"w{(i * j) % 97} v{i}" for j in range(i % 40)) if i % 9 else None) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5, "doc_id")

    def scores(**limits):
        return sorted(map(tuple, logbloom.language_scores(docs, "doc_id", "text", F.col("doc_id") % 7 == 2, **limits).collect()))

    whole = scores()
    for got in (scores(words_bytes=200), scores(words_bytes=200, slice_bytes=3000)):
        assert [row[:5] for row in got] == [row[:5] for row in whole]
        assert [row[5:] for row in got] == [pytest.approx(row[5:], abs=1e-9) for row in whole]
