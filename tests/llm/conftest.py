import pytest

from pairloom.llm import toxicity

DOC_DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint"

TEXTS = [
    "The quick brown fox jumps over the lazy dog near the old river bank",
    "The quick brown fox jumps over the lazy dog near the old river bank",
    "the QUICK brown fox jumps over the lazy dog near the old river bank",
    "One",
    "one two",
    "",
    "   \t\n ",
    None,
    "Ünïcode wörds, 日本語 text and  double  spaces\n \n then <|endoftext|> inside",
    "don't stop, it's 12,345.67 at 10:30!!! ###   end",
    " leading and trailing ",
    "a b c d e f g h i j k l m n o p q r s t u v w x y z",
]


def make_docs(spark, texts=TEXTS, extra=""):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(3, "One", "en", "s0", 3), (None, "no id at all", None, None, None), (None, None, None, None, None)]
    rows += [(100, "word " * 5000 + "end", "en", "s1", 25003), (101, "x" * 200_000, "en", "s2", 200_000)]
    df = spark.createDataFrame(rows, DOC_DDL)
    return df.selectExpr("*", extra) if extra else df


@pytest.fixture
def docs(spark):
    return make_docs(spark)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC_DDL)


@pytest.fixture
def small_training(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 200)
