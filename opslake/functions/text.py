"""String helpers shared by every text operator.

Java's regex classes differ from the ASCII dialect the rules are written in, so
word boundaries, line anchors and whitespace are spelled out here once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace removed by a full Unicode trim.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ASCII word boundaries before / after a word character.
WB = r"(?<![0-9A-Za-z_])"
WE = r"(?![0-9A-Za-z_])"

FIELD_GAP = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and let ``fn`` use it any number of times.

    ``element_at`` keeps its type; an index in brackets derives it from all expressions below again for every row.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add ``name`` computed one time per row.

    A plain column would be evaluated again by every filter and column built on it, because
    filters move below projections; they do not move below a generator.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def fields(c: Column) -> Column:
    """Whitespace-separated fields of a line; a blank line has none."""
    return F.array_remove(F.split(trim(c), FIELD_GAP), "")


def field(arr: Column, i: int) -> Column:
    """Zero-based field, '' when the line is shorter."""
    return F.coalesce(F.get(arr, F.lit(i)), F.lit(""))


def tail(arr: Column, start: int) -> Column:
    """Fields from zero-based ``start`` joined by one space."""
    return F.array_join(
        F.slice(arr, start + 1, F.greatest(F.size(arr) - start, F.lit(0))), " ")


def blank(c: Column) -> Column:
    return trim(c) == ""
