"""Calendar columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from costlens import schema as S


def month_of(date: Column | str) -> Column:
    """``yyyy-MM`` text of a date."""
    return F.date_format(date, "yyyy-MM")


def weekday_label(day: Column, labels: Sequence[str] = S.WEEKDAYS_EN) -> Column:
    """Label of a ``dayofweek`` number; both start with Sunday."""
    if len(labels) != 7:
        raise ValueError("labels must name seven weekdays, Sunday first")
    return F.element_at(F.array(*[F.lit(x) for x in labels]), day)


def iso_date(date: Column | str) -> Column:
    return F.date_format(date, "yyyy-MM-dd")
