"""Number formatting for indicator and alert texts (ties to even)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dollars(x: Column, digits: int = 0) -> Column:
    """``$1,234`` or, with two digits, ``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(x.cast("double"), digits))


def one_decimal(x: Column) -> Column:
    """``1234.5``, without digit grouping."""
    return F.call_function("format_number", x.cast("double"), F.lit("0.0"))


def signed_pct(x: Column) -> Column:
    """``+12.2%`` or ``-3.0%``."""
    pattern = F.lit("+0.0;-0.0")
    return F.concat(F.call_function("format_number", x.cast("double"), pattern), F.lit("%"))
