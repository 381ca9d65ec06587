"""Scalar text functions of the evaluation model, as Columns; Python only where Spark has no built-in."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC; Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(s: pd.Series) -> pd.Series:
    """Unicode NFKC of each text of an array: one Arrow pass for all texts of a row."""
    return s.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def _folded(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def _spaced(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", " ")


def normalize_text(c: Column, unicode_form: bool = True) -> Column:
    """Trimmed, lower case, NFKC, white space collapsed; null is the text none."""
    c = _folded(F.coalesce(c.cast("string"), F.lit("none")))
    return _spaced(nfkc(c) if unicode_form else c)


def normalize_all(texts: Column) -> Column:
    """``normalize_text`` of each text of an array."""
    return F.transform(nfkc_all(F.transform(texts, lambda x: _folded(F.coalesce(x, F.lit("none"))))), _spaced)


def tokens(c: Column) -> Column:
    """Words if there are two or more, else characters; none for an empty text."""
    words = F.split(F.trim(c), " ")
    return F.when(F.trim(c) == "", F.array().cast("array<string>")).when(F.size(words) > 1, words).otherwise(F.split(c, ""))


def multiset_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as multisets; 1 if both are empty, 0 if one is."""

    def count(xs: Column, t: Column) -> Column:
        return F.size(F.filter(xs, lambda x: x == t))

    common = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, t: acc + F.least(count(a, t), count(b, t)))
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * common / both)


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays as sets; 1 if both are empty, 0 if one is."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    common, both = F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)
    return F.when(both == 0, 1.0).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(2 * common / both)


def number_of(t: Column) -> Column:
    """The first number of a normalised text, ten thousands and thousands of yen scaled; null without one."""
    t = F.regexp_replace(t, "[,¥]", "")
    scale = F.when(F.contains(t, F.lit("千円")), 1000.0).when(F.contains(t, F.lit("万円")), 10000.0).otherwise(1.0)
    return F.regexp_extract(F.regexp_replace(t, "[万千]?円", ""), r"(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") * scale


def normalize_number(c: Column) -> Column:
    """``number_of`` a text of any form, full-width digits included; null for null."""
    return F.when(c.isNotNull(), number_of(normalize_text(c)))


def date_of(t: Column) -> Column:
    """ISO date of a normalised text: an era date or one with kanji anywhere in it, or a whole ISO or slash date; else the text.

    Dates with kanji are not checked against the calendar, the others are.
    """
    era, kanji, plain = r"令和([0-9]+)年([0-9]+)月([0-9]+)日", r"([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日", r"^([0-9]{4})([-/])([0-9]{1,2})\2([0-9]{1,2})$"

    def padded(year: Column, month: Column, day: Column) -> Column:
        return F.format_string("%04d-%02d-%02d", year, month, day)

    def piece(pattern: str, k: int) -> Column:
        return F.regexp_extract(t, pattern, k).try_cast("int")

    whole = padded(piece(plain, 1), piece(plain, 3), piece(plain, 4))
    valid = F.when(F.try_to_date(whole).isNotNull(), whole)
    in_kanji = F.when(t.rlike(kanji), padded(*[piece(kanji, k) for k in (1, 2, 3)]))
    return F.when(t.rlike(era), padded(piece(era, 1) + 2018, piece(era, 2), piece(era, 3))).otherwise(F.coalesce(F.when(t.rlike(plain), valid), in_kanji, t))


def normalize_date(c: Column) -> Column:
    """``date_of`` a text of any form; null is the text none."""
    return date_of(normalize_text(c))


def json_length(c: Column) -> Column:
    """Code points of a text's JSON form: quotes, and escapes of quotes, backslashes and control characters."""
    short, long = F.regexp_count(c, F.lit(r"[\"\\\x08\x09\x0a\x0c\x0d]")), F.regexp_count(c, F.lit(r"[\x00-\x07\x0b\x0e-\x1f]"))
    return F.length(c) + 2 + short + 5 * long


def estimate_tokens(c: Column) -> Column:
    """A quarter of the text's JSON form, at least 1."""
    return F.greatest(F.lit(1), F.floor((json_length(c) + 3) / 4)).cast("long")
