"""Text expressions shared by preparation, screening and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character the Python string type treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_NOT_BLANK = WHITESPACE.replace(" ", "")
# A word of a text of single-byte characters: one bit set decides about a character.
_ASCII_WORD = f"[^{''.join(c for c in WHITESPACE if c < chr(128))}]+"


def strip(text: Column) -> Column:
    """Drop whitespace at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse(text: Column) -> Column:
    """Strip, and turn each run of whitespace into one blank."""
    blanks = F.translate(strip(text), _NOT_BLANK, " " * len(_NOT_BLANK))
    return F.regexp_replace(blanks, " {2,}", " ")


def words(text: Column) -> Column:
    """Array of whitespace-separated words; empty for blank text."""
    split = F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.split(collapse(text), " "))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.regexp_extract_all(text, F.lit(_ASCII_WORD), F.lit(0))).otherwise(split)


def strip_fences(text: Column) -> Column:
    """Drop a leading code fence (with or without a language tag) and a trailing one."""
    stripped = strip(text)
    opened = F.regexp_replace(F.regexp_replace(stripped, r"\A```sql", ""), r"\A```", "")
    return F.when(F.instr(text, "```") > 0, strip(F.regexp_replace(opened, r"```\z", ""))).otherwise(stripped)


def clean_sql(text: Column) -> Column:
    """Answer text as stored in a prepared pair: no fences, no final semicolons."""
    return F.rtrim(strip_fences(text), F.lit(";"))


def estimated_tokens(text: Column) -> Column:
    """About four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def word_tokens(text: Column) -> Column:
    """Two tokens per whitespace-separated word."""
    return (F.size(words(text)) * 2).cast("long")


def _literals(text: Column, replace) -> Column:
    """Apply ``replace`` to the inside of every single-quoted literal."""
    pieces = F.transform(
        F.split(text, "'"), lambda piece, i: F.when(i % 2 == 1, replace(piece)).otherwise(piece)
    )
    return F.when(F.instr(text, "'") > 0, F.array_join(pieces, "'")).otherwise(text)


def mask_literals(text: Column) -> Column:
    """Replace each literal by a digest, so that keywords inside it cannot be seen."""
    return _literals(text, lambda piece: F.md5(F.lower(piece)))


def drop_all(text: Column, characters: str) -> Column:
    """Take every one of ``characters`` out of the text."""
    for character in characters:
        text = F.replace(text, F.lit(character), F.lit(""))
    return text


# What is read as one piece, whichever starts first: literals, quoted names, comments.
_LITERAL, _QUOTED, _COMMENT = r"'[^']*(?:'|\z)", r'"[^"]*"', r"--[^\n]*|/\*(?s:.*?)(?:\*/|\z)"


def _commented(text: Column) -> Column:
    return (F.instr(text, "--") > 0) | (F.instr(text, "/*") > 0)


def drop_comments(text: Column) -> Column:
    """Put a blank for each comment outside literals and quoted names."""
    return F.when(_commented(text), F.regexp_replace(text, f"({_LITERAL}|{_QUOTED})|{_COMMENT}", "$1 ")).otherwise(text)


def blank_literals(text: Column) -> Column:
    """Empty each literal, drop comments, and unquote names.

    Of a quoted name with other characters than those of words, its first word character stays.
    """
    quoted = r'"(\w+)"|"[^"\w]*(\w?)[^"]*"'
    emptied = F.when(
        _commented(text) | (F.instr(text, '"') > 0),
        F.regexp_replace(text, rf"(')[^']*(?:'|\z)|{quoted}|{_COMMENT}", "$1$1$2$3 "),
    ).otherwise(F.regexp_replace(text, _LITERAL, "''"))
    return drop_all(emptied, '"`[]')


def first_statement(text: Column) -> Column:
    """First non-blank text between semicolons that are outside literals."""
    hidden = F.when(
        (F.instr(text, ";") > 0) & (F.instr(text, "'") > 0),
        _literals(text, lambda piece: F.translate(piece, ";", "\x01")),
    ).otherwise(text)
    return strip(F.translate(F.regexp_extract(hidden, r"\A[\s;]*([^;]*)", 1), "\x01", ";"))
