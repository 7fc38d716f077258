"""Small text expressions: list literals as shown in evidence, and sentence-like pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A string literal: in single quotes, or in double ones if it holds single quotes only; backslashes, line ends and tabs escaped."""
    body = F.replace(F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    single, double = text.contains("'"), text.contains('"')
    return F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def listed(items: Column) -> Column:
    """A list of string literals in brackets."""
    return F.concat(F.lit("["), F.array_join(F.transform(items, quoted), ", "), F.lit("]"))


def title_case(metric: Column) -> Column:
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))
