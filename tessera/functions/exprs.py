"""Column expressions shared by the operators; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def clip(x: Column, low: float, high: float) -> Column:
    """x within [low, high]; null stays null although least and greatest skip nulls."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


#: First year and years after it that labels may have (fixed values).
FIRST_YEAR, YEAR_SPAN = 1922, 89


def normalized_year(year: Column, first: int = FIRST_YEAR, span: int = YEAR_SPAN) -> Column:
    return (year - first) / span


def circular(step: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a step of a cycle; 0 where the step is unknown."""
    turn = F.when(step.between(0, period - 1), step * (2 * 3.141592653589793 / period))
    return F.coalesce(F.sin(turn), F.lit(0.0)), F.coalesce(F.cos(turn), F.lit(0.0))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(x: Column, y: Column) -> Column:
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def unit(x: Column) -> Column:
    """x at length 1; null for a zero vector."""
    n = norm(x)
    # Beside each element stands the norm, which is so evaluated once and not for every element.
    return F.when(n > 0, F.zip_with(x, F.array_repeat(n, F.size(x)), lambda v, m: v.cast("double") / m))


def digest(seed: int | str, *parts: Column) -> Column:
    """Hex SHA-256 of the seed and the parts, joined by a zero character."""
    return F.sha2(F.concat_ws("\0", F.lit(str(seed)), *(p.cast("string") for p in parts)).cast("binary"), 256)


def unit_hash(seed: int | str, *parts: Column) -> Column:
    """The digest's first 64 bits as a fraction of one."""
    return F.conv(F.substring(digest(seed, *parts), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def era(text: Column) -> Column:
    """The decade that a text names, null where none: its first number of four digits that is a decade's first year, or else its first pair of digits before an s."""
    numbers = F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1))
    years = F.filter(numbers, lambda w: (F.length(w) == 4) & (F.substring(w, 4, 1) == "0") & w.try_cast("int").between(1920, 2010))
    pairs = F.regexp_extract_all(text, F.lit("([0-9]+)s"), F.lit(1))
    decades = F.filter(pairs, lambda w: (F.length(w) == 2) & (F.substring(w, 2, 1) == "0") & (w != "10"))
    short = F.try_element_at(decades, F.lit(1))
    return F.coalesce(F.try_element_at(years, F.lit(1)).cast("int"), F.when(short == "00", 2000).otherwise(short.cast("int") + 1900))
