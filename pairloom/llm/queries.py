"""The queries of the operators, and the SQL text of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.collocations import collocations
from pairloom.llm.columns import byte_count, text_crc32, word_count
from pairloom.llm.content import extract_main_text
from pairloom.llm.counting import digest_cached_counts
from pairloom.llm.jaccard import jaccard_groups
from pairloom.llm.lexical import ranked_search
from pairloom.llm.logbloom import language_scores
from pairloom.llm.maxproduct import largest_products
from pairloom.llm.mixing import mix_to_targets
from pairloom.llm.nearest import nearest
from pairloom.llm.packing import pack_mixture
from pairloom.llm.sharding import feistel_shards
from pairloom.llm.tokenfiles import read_documents, write_token_files
from pairloom.llm.toxicity import toxicity_scores
from pairloom.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into windows of 2048 tokens, mixed by source."""
    pieces = pack_mixture(table(spark, sf_dir, "documents"), "doc_id", "text", "source", "byte_bpe_50k.json", end_id=1)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source"
    )


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids as directly addressable codes, and read the files back."""
    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), "doc_id", "text", "byte_bpe_50k.json", 2, path)
    return read_documents(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_block_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty nearest vectors of every twentieth, by inner product."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


@query
def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffle all documents into 40 shards of equal row counts."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (byte_count(F.col("text")) + 16).alias("size"),
        text_crc32(F.col("text")).alias("text_crc32"),
        F.xxhash64("text").alias("tie"),
    )
    placed = feistel_shards(docs, ["doc_id", "size", "text_crc32", "tie"], shards=40, seed=20)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity_scores(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 90 % of their three-word shingles."""
    return jaccard_groups(table(spark, sf_dir, "documents"), "doc_id", "text", width=3, percent=90)


@query
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to the sources' targets, in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_to_targets(docs, "source", "size", "doc_id", seed=7)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document, each distinct text encoded once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = digest_cached_counts(docs, "text", "piece_bpe_32k.model", over=4096)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op9_largest_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five largest products of every fiftieth vector, over integer components."""
    return largest_products(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every whole page."""
    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 phrases that occur most above chance."""
    return collocations(table(spark, sf_dir, "documents"), "text", "lang", least=100, longest=5, top=2000)


@query
def op12_language_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole document, learned from six sevenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return language_scores(docs, "doc_id", "text", held_out)


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return ranked_search(docs, "doc_id", "text", items, "item_id", "text", k=10)


ORACLES["op11_collocations"] = r"""
WITH words AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
    SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
    FROM words, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
known AS (SELECT lang, phrase, k AS size, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM known WHERE size >= 2),
cuts AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n,
        CAST((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
        JOIN known l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:c.k], ' ')
        JOIN known r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')
        JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
covered AS (
    SELECT lang, inner_phrase, max(a) AS around FROM (
        SELECT lang, a, unnest([array_to_string(w[i:i + m - 1], ' ') FOR i IN range(1, size - m + 2)]) AS inner_phrase
        FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates))
    GROUP BY ALL),
kept AS (
    SELECT best.* FROM best LEFT JOIN covered c ON c.lang = best.lang AND c.inner_phrase = best.phrase
    WHERE around IS NULL OR 100 * around < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

ORACLES["op13_ranked_search"] = r"""
WITH terms AS (
    SELECT row_id, doc_id, unnest(t) AS term, len(t) AS n FROM (
        SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
        FROM documents WHERE text IS NOT NULL)),
tf AS (SELECT row_id, doc_id, term, n, count(*) AS tf FROM terms GROUP BY ALL),
totals AS (SELECT count(DISTINCT row_id) AS nd, count(*) AS l FROM terms),
weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM tf, totals GROUP BY term, nd),
items AS (
    SELECT item_row, item_id, term, count(*) AS times FROM (
        SELECT row_number() OVER () AS item_row, item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark)
    GROUP BY ALL),
scores AS (
    SELECT item_row, item_id, row_id, doc_id,
        CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l)))) AS BIGINT) AS score
    FROM items JOIN weights USING (term) JOIN tf USING (term), totals GROUP BY item_row, item_id, row_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_row ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""

ORACLES["op9_largest_products"] = """
WITH v AS (
    SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS f FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
ranked AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.f, c.f) DESC, c.vec_id) AS rank
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.f) = len(c.f) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

ORACLES["op7_mix_sources"] = r"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
    FROM documents),
ranked AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
        [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
    FROM docs GROUP BY source),
levels AS (
    SELECT source_size * 3 AS cap, w, row_number() OVER o AS nr,
        (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0))::DOUBLE
            / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
    FROM ranked
    WINDOW o AS (ORDER BY source_size * 3.0 / w, source IS NULL, source),
        before AS (ORDER BY source_size * 3.0 / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
    SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), level * w) AS target
    FROM ranked, (SELECT min_by(level, nr) AS level FROM levels WHERE cap >= level * w)),
budgets AS (
    SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 3) AS INTEGER) ELSE 0 END AS repeats
    FROM targets),
hashes AS (
    SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto
    FROM docs GROUP BY source, h),
cuts AS (
    SELECT b.source, min_by(CASE WHEN (target - repeats * source_size - (upto - words)) * 2 >= words THEN h ELSE h - 1 END, h) AS cut
    FROM hashes JOIN budgets b ON hashes.source IS NOT DISTINCT FROM b.source
    WHERE target - repeats * source_size > 0 AND repeats < 3 AND upto > target - repeats * source_size
    GROUP BY b.source),
mixed AS (
    SELECT doc_id, d.source, size, source_size, target, repeats + CASE WHEN h <= cut THEN 1 ELSE 0 END AS copies
    FROM docs d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
        LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, size, source_size, target, CAST(copies AS INTEGER) AS copies, copies * size AS taken FROM mixed
"""
