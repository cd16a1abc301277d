"""Text functions over columns: cleaning, folding, header normalisation, identifiers."""

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spaces that stand for a plain one, and marks that take no room.
WIDE_SPACES, NO_WIDTH = "    ", "​﻿"
#: Currency words that numbers come with.
CURRENCIES = ("da", "dzd", "dt", "tnd", "eur", "usd", "dh", "mad")


@lru_cache(maxsize=1)
def folding() -> tuple[str, str]:
    """Latin letters with accents, and the letters without, by Unicode's decompositions."""
    pairs = []
    for code in range(0xC0, 0x250):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def clean_spaces(c: Column) -> Column:
    """One plain space for each run of blanks, none at the ends; marks without width go."""
    plain = F.translate(c, WIDE_SPACES + NO_WIDTH, " " * len(WIDE_SPACES))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def strip_accents(c: Column) -> Column:
    """Latin letters without their accents; stays in the JVM."""
    return F.translate(c, *folding())


@F.pandas_udf(T.StringType())
def strip_accents_exact(s: pd.Series) -> pd.Series:
    """Full compatibility decomposition without combining marks: also ligatures and signs."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def normalize_header(c: Column) -> Column:
    """Folded, lower case, words only, one space between them; null and blank give an empty string."""
    bare = F.lower(strip_accents(F.translate(c, WIDE_SPACES + NO_WIDTH, " " * len(WIDE_SPACES))))
    return F.coalesce(F.trim(F.regexp_replace(bare, r"(?U)[\W_]+", " ")), F.lit(""))


def normalize_loose(c: Column) -> Column:
    return F.replace(normalize_header(c), F.lit(" "), F.lit(""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (clean_spaces(c) == "")


def to_text(c: Column) -> Column:
    return F.nullif(clean_spaces(c), F.lit(""))


def without_currency(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?i)[€$£%]|\b({'|'.join(CURRENCIES)})\b", "")


def whole_word(text: Column, token: str) -> Column:
    """Whether a normalised token stands in a normalised text as whole words."""
    return F.concat(F.lit(" "), text, F.lit(" ")).contains(f" {token} ")


def identifier_of_number(n: Column) -> Column:
    """Digits of an integral number, however large; others as they print; leading signs stay."""
    return F.when((F.abs(n) < 1e15) & (n == F.floor(n)), n.cast("long").cast("string")).when(n == F.floor(n), n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))


def identifier_of_text(c: Column) -> Column:
    """Text without a spreadsheet's .0 ending; leading zeros stay."""
    text = to_text(c)
    return F.when(text.rlike(r"^[0-9]+\.0$"), F.regexp_replace(text, r"\.0$", "")).otherwise(text)


def column_letter(k: Column) -> Column:
    """The spreadsheet letters of a column number from 1 to 18278."""
    one = lambda x: F.char(F.lit(65) + x)
    last = one((k - 1) % 26)
    second = F.when(k > 26, one(F.floor((k - 27) / 26) % 26)).otherwise("")
    third = F.when(k > 702, one(F.floor((k - 703) / 676) % 26)).otherwise("")
    return F.concat(third, second, last)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def row_hash(source: Column, *business: Column) -> Column:
    """16 hex digits over the source and the business columns, nulls as empty strings."""
    parts = F.array(*(F.coalesce(c.cast("string"), F.lit("")) for c in business))
    return F.substring(F.sha2(F.concat(source, F.lit("::"), F.array_join(parts, "|")), 256), 1, 16)
