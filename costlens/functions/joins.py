"""A join that holds when one key owns a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT_BITS = 6


def join_per_key(
    rows: DataFrame, per_key: DataFrame, key: str, spread_by: str, salt_bits: int = SALT_BITS
) -> DataFrame:
    """Inner join of many ``rows`` with one ``per_key`` row for each key.

    ``per_key`` is repeated once per salt and every row takes the salt that
    ``spread_by`` hashes to, so the rows of one key meet in ``2 ** salt_bits``
    tasks rather than in one. Nothing is hinted: the adaptive planner measures
    the shuffled ``per_key`` side and makes the join a broadcast if it is small.
    """
    last = 2**salt_bits - 1
    # A mask of a hash is never null, so the join adds no null test that would
    # keep the two sides from sharing the shuffle they are computed from.
    salted_rows = rows.withColumn("_salt", F.xxhash64(spread_by).bitwiseAND(F.lit(last)))
    every_salt = F.sequence(F.lit(0).cast("bigint"), F.lit(last).cast("bigint"))
    salted_keys = per_key.withColumn("_salt", F.explode(every_salt))
    return salted_rows.join(salted_keys, [key, "_salt"]).drop("_salt")
