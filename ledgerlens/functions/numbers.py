"""Number coercion and exact money arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Money is summed as DECIMAL so totals are exact and independent of the order
# partitions are combined in; results are cast to double at the edge.  Ten
# decimal places hold prices times quantities unrounded, and 28 digits before
# the point any total; NaN counts as missing, and a value with more digits is
# an error, never left out of a sum.
MONEY = "decimal(38,10)"

# The whole text is a number; Java's own suffixes (1d, 2.5f) are not.
NUMBER_SHAPE = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def lenient_number(col) -> Column:
    """Drop ',', then every char not in [0-9.-]; '' and '-' -> null; parse or null.

    One regex does both removals (',' is outside [0-9.-]), and `try_cast`
    already maps '' and '-' to null.
    """
    return F.regexp_replace(_c(col).cast("string"), r"[^0-9.\-]", "").try_cast("double")


def strict_number(col) -> Column:
    """Null unless the whole (trimmed) text is a number."""
    text = _c(col).cast("string")
    return F.when(text.rlike(NUMBER_SHAPE), text.try_cast("double"))


def money(col) -> Column:
    """The value in exact decimals; null where it is null, NaN or no number, an error where it has more than 28 digits before the point."""
    value = _c(col)
    exact, wide = value.try_cast(MONEY), value.try_cast("double")
    return F.coalesce(exact, F.when(wide.isNotNull() & ~F.isnan(wide), F.raise_error(F.concat(
        F.lit("an amount has more than 28 digits: "), wide.cast("string"))).cast(MONEY)))


def money_sum(col) -> Column:
    """Exact sum of a money column, returned as double (null on no rows)."""
    return F.sum(money(col)).cast("double")


def round6(col) -> Column:
    return F.round(_c(col), 6)


def pct(part, total) -> Column:
    """part / total * 100 rounded to 6 places; 0 when the total is 0 or null."""
    p = _c(part).cast("double")
    t = _c(total).cast("double")
    return F.when(F.coalesce(t, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.round(p / t * 100.0, 6))
