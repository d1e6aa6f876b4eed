import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import TEXTS
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import counting, dac
from pairloom.llm.counting import digest_cached_counts
from pairloom.llm.packing import pack_mixture
from pairloom.llm.tokenfiles import read_documents, tokens_at, write_token_files
from pairloom.llm.tokens import word_encoder
from pairloom.session import scratch_path

BPE = "byte_bpe_50k.json"


def ids_of(text, end):
    return [*word_encoder(BPE).library.encode(text or "", add_special_tokens=False).ids, end]


def key(doc_id, text):
    return (-1 if doc_id is None else doc_id, text or "")


@settings(deadline=None, max_examples=300)
@given(st.lists(st.sampled_from(["a", "Wörd", "é", " ", "  ", "\n", "\t", "'s", "!", "12", "<|endoftext|>", "日本", " ", "　", "\x85", "don't", "…"]), max_size=12))
def test_word_encoder_matches_the_library(parts):
    text = "".join(parts)
    encoder = word_encoder(BPE)
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == ids_of(text, 0)[:-1]


@settings(deadline=None, max_examples=100)
@given(st.lists(st.sampled_from([0, 1, 255, 256, 300, 50_000, 65_535, 65_536, 1 << 24, (1 << 32) - 1]), max_size=3000))
def test_codes_decode_and_give_access(values):
    array = np.array(values, np.uint32)
    levels = dac.encode(array)
    assert dac.decode(levels).tolist() == values
    places = np.arange(len(values))[::-3]
    assert dac.access(levels, places).tolist() == array[places].tolist()


def test_access_across_rank_blocks():
    values = np.random.default_rng(1).integers(0, 1 << 20, 5000).astype(np.uint32)
    levels = dac.encode(values)
    assert dac.access(levels, np.arange(5000)).tolist() == values.tolist()


def test_token_files_round_trip(spark, docs):
    path = scratch_path(spark, "test-tokens")
    write_token_files(docs.withColumn("part", F.lit("x")), "doc_id", "text", BPE, 2, path, segment_tokens=100)
    rows = read_documents(spark, path).orderBy("start").collect()
    wanted = [(r["doc_id"], ids_of(r["text"], 2)) for r in docs.collect()]
    got = [(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in rows]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert [r["doc_id"] or -1 for r in rows] == sorted(r["doc_id"] or -1 for r in rows)
    stream = [i for _, ids in got for i in ids]
    assert [r["start"] for r in rows] == [sum(len(x) for _, x in got[:i]) for i in range(len(got))]
    asked = [0, 1, len(stream) - 1, len(stream) // 2, len(stream), len(stream) // 2]
    found = tokens_at(spark.createDataFrame([(p,) for p in asked], "p bigint"), "p", path).collect()
    assert sorted((r["position"], r["token"]) for r in found) == sorted({(p, stream[p]) for p in asked if p < len(stream)})


def test_token_files_of_nothing(spark, empty):
    path = scratch_path(spark, "test-tokens")
    write_token_files(empty, "doc_id", "text", BPE, 2, path)
    assert read_documents(spark, path).count() == 0


def check_packed(docs, rows, window):
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r["doc_id"]].append(ids_of(r["text"], 1))
    sequences, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        covered[r["doc_id"]].append((r["start"], ids, r["doc_tokens"]))
    for doc, pieces in covered.items():
        assert sum(len(ids) for _, ids, _ in pieces) == sum(map(len, texts[doc]))
        if len(texts[doc]) == 1:
            assert [i for _, ids, _ in sorted(pieces, key=lambda p: p[0]) for i in ids] == texts[doc][0]
    assert set(covered) == set(texts)
    assert set(sequences) == set(range(len(sequences)))
    for number, pieces in sequences.items():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == window or number == len(sequences) - 1


def test_packing_keeps_every_token_once(spark, docs):
    packed = pack_mixture(docs.withColumn("grant", F.lit(1)), "doc_id", "text", "source", BPE, 1, window=64, packet=16)
    check_packed(docs, packed.collect(), 64)


def test_packing_fills_windows_to_proportions(spark):
    rows = [(i, f"word{i} " * 40, "abc"[i % 3 if i % 2 else 0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    packed = pack_mixture(docs, "doc_id", "text", "source", BPE, 1, window=512, packet=64).collect()
    tokens, total = defaultdict(int), 0
    for r in packed:
        tokens[r["source"]] += r["length"]
        total += r["length"]
    seen = defaultdict(int)
    windows = max(r["sequence_id"] for r in packed)
    for number in range(windows):
        for r in packed:
            if r["sequence_id"] == number:
                seen[r["source"]] += r["length"]
        # Nowhere does a source run ahead or behind by more than one packet a source.
        for source, n in seen.items():
            assert abs(n - tokens[source] / total * 512 * (number + 1)) <= 64 * 4


def test_packing_by_given_weights(spark):
    rows = [(i, f"word{i} " * 40, "ab"[i % 2]) for i in range(200)] + [(999, "other words", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    packed = pack_mixture(docs, "doc_id", "text", "source", BPE, 1, window=512, packet=64, weights={"a": 3, "b": 1}).collect()
    check_packed(docs, packed, 512)
    early = [r for r in packed if r["sequence_id"] < 10]
    share = sum(r["length"] for r in early if r["source"] == "a") / sum(r["length"] for r in early)
    assert share == pytest.approx(0.75, abs=0.05)
    assert max(r["sequence_id"] for r in packed) == next(r["sequence_id"] for r in packed if r["doc_id"] == 999)


def test_packing_of_nothing(empty):
    assert pack_mixture(empty, "doc_id", "text", "source", BPE, 1).count() == 0


@pytest.mark.parametrize("tokenizer", ["piece_bpe_32k.model", BPE, "word_bpe_49k.json"])
def test_counts_match_the_library(spark, docs, tokenizer):
    if tokenizer.endswith(".model"):
        import public_tokenizers
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=public_tokenizers.path(tokenizer)).encode
    else:
        encode = word_encoder(tokenizer).library.encode
        library = lambda text: encode(text, add_special_tokens=False).ids
    counted = digest_cached_counts(docs.withColumn("digest", F.lit(7)), "text", tokenizer, over=20)
    rows = counted.collect()
    assert len(rows) == docs.count()
    for r in rows:
        n = len(library(r["text"] or ""))
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((r["text"] or "").encode()), n > 20)
        assert r["digest"] == 7


def test_counts_come_from_the_cache(spark, docs, empty, monkeypatch):
    cache = scratch_path(spark, "test-cache")
    digest_cached_counts(docs, "text", "piece_bpe_32k.model", cache)
    stored = spark.read.schema(counting.CACHE_DDL).parquet(cache)
    distinct = len({t or "" for t in (r["text"] for r in docs.collect())})
    assert stored.count() == stored.select("digest").distinct().count() == distinct
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("something new")))
    assert digest_cached_counts(more, "text", "piece_bpe_32k.model", cache).count() == docs.count() + 1
    assert spark.read.schema(counting.CACHE_DDL).parquet(cache).count() == distinct + 1
    # Another tokenizer has counts of its own in the same folder; a lost append that was done again changes nothing.
    digest_cached_counts(docs, "text", BPE, cache)
    spark.read.schema(counting.CACHE_DDL).parquet(cache).coalesce(1).write.mode("append").parquet(cache)
    assert digest_cached_counts(docs, "text", BPE, cache).count() == docs.count()
    assert digest_cached_counts(empty, "text", BPE, cache).count() == 0


def test_crc_of_pieces(spark):
    assert spark.range(1).select(F.crc32(F.lit(b"abc"))).first()[0] == zlib.crc32(b"abc")
    assert len(TEXTS) == 12
