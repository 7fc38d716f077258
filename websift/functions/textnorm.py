"""Normal forms of business names, addresses and phone numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Corporate suffixes dropped from names, and the order in which address words are shortened.
CORPORATE = ("inc", "incorporated", "llc", r"l\.l\.c\.", "ltd", "limited", "corp", "corporation", "co", "company", "gmbh", "sa", "plc")
ADDRESS_WORDS = (
    ("street", "st"), ("road", "rd"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("lane", "ln"), ("court", "ct"),
    ("suite", "ste"), ("apartment", "apt"), ("building", "bldg"), ("floor", "fl"), ("highway", "hwy"), ("parkway", "pkwy"),
    ("circle", "cir"), ("place", "pl"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
)


@F.pandas_udf(StringType())
def _fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold())


@F.pandas_udf(StringType())
def _compose(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(value, ascii_only: bool = False) -> Column:
    """NFKC and case folding; Spark has no such function, so what isn't ASCII goes through Arrow. ascii_only promises that nothing does."""
    value = _col(value)
    return F.lower(value) if ascii_only else F.when(value.rlike(r"^\p{ASCII}*$"), F.lower(value)).otherwise(_fold(value))


def collapse(value) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def norm_name(value, ascii_only: bool = False) -> Column:
    """Folded, corporate suffix words and punctuation to spaces, collapsed; null gives ''."""
    out = F.regexp_replace(fold(value, ascii_only), r"(?U)\b(" + "|".join(CORPORATE) + r")\b", " ")
    return F.coalesce(collapse(F.regexp_replace(out, r"(?U)[^\w\s]", " ")), F.lit(""))


def norm_address(value, ascii_only: bool = False) -> Column:
    """Folded, street words shortened one after the other, everything but a-z, 0-9 and space dropped, collapsed; null gives ''."""
    out = fold(value, ascii_only)
    for word, short in ADDRESS_WORDS:
        out = F.regexp_replace(out, rf"(?U)\b{word}\b", short)
    return F.coalesce(collapse(F.regexp_replace(out, r"[^a-z0-9\s]", " ")), F.lit(""))


def norm_phone(value, ascii_only: bool = False) -> Column:
    """Digits only, a leading 1 of eleven dropped, the last ten kept; null gives ''."""
    value = _col(value)
    plain = value if ascii_only else F.when(value.rlike(r"^\p{ASCII}*$"), value).otherwise(_compose(value))
    digits = F.regexp_replace(plain, r"(?U)\D", "")
    digits = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return F.coalesce(F.when(F.length(digits) >= 10, F.right(digits, F.lit(10))).otherwise(digits), F.lit(""))


def norm_field(field, value, ascii_only: bool = False) -> Column:
    """The normal form that a field ('name', 'address', 'phone') calls for."""
    return F.when(_col(field) == "name", norm_name(value, ascii_only)).when(_col(field) == "address", norm_address(value, ascii_only)).when(_col(field) == "phone", norm_phone(value, ascii_only))
