"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the words that document sizes and shingles are counted in.
WORD = r"[^\x20\x09-\x0D]+"


def carried(df: DataFrame, **inner: Column) -> DataFrame:
    """``inner`` columns beside one struct ``_row`` with every column of ``df``.

    Work on the result can use any column name without meeting one of the caller's.
    """
    return df.select(F.struct("*").alias("_row"), *[c.alias(name) for name, c in inner.items()])


def restored(df: DataFrame, columns: list[str], **added: Column) -> DataFrame:
    """The caller's ``columns`` out of ``_row``, then ``added``; an added name replaces an equal one."""
    taken = {name.lower() for name in added}
    kept = [F.col("_row").getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(name) for name, c in added.items()])


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def byte_count(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))


def text_crc32(text: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
