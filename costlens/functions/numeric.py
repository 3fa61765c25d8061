"""Money, percentage and rounding columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costlens import schema as S


def total_cost() -> Column:
    """Exact decimal sum of cost over raw lines or a rollup of them."""
    return F.sum(S.COST)


def line_count(bills: DataFrame) -> Column:
    """Number of bill lines, whether ``bills`` holds raw lines or a rollup of them."""
    count = F.sum(S.LINES) if S.LINES in bills.columns else F.count(F.lit(1))
    return count.cast("bigint")


def pct_change(new: Column, old: Column) -> Column:
    """Change from ``old`` to ``new`` in percent; NULL when ``old`` is zero."""
    return F.try_divide(new - old, old) * 100


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Half away from zero, the rule of SQL ``ROUND``."""
    return F.round(x, digits)


def round_half_even(x: Column, digits: int = 2) -> Column:
    """Scale, round to the nearest integer (ties to even), scale back: numpy's rule."""
    scale = float(10**digits)
    return F.rint(x.cast("double") * scale) / scale


def as_double(x: Column) -> Column:
    return x.cast("double")
