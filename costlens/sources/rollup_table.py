"""The daily rollup of the stored table, kept month by month.

    table/daily/month=<month>/print=<fingerprint of the month's lines>/

A month's rollup belongs to what its lines are, not to a version: versions that hold the
same lines of a month share it, and a load rolls up changed months only. A version reads
the months that its own fingerprints name, so it sees no other version's numbers while
that one is written or after. A rollup counts as there once its version says so, which is
written last; what a lost job left is written over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import schema as S
from costlens.operators import rollups
from costlens.sources import bill_table, files, versions

PRINT = "print"
_DAILY = "daily"
_READY = "daily-ready"
_ROLLUP = T.StructType(
    [
        *[f for f in S.BILL_LINE.fields if f.name not in (S.RESOURCE, S.COST)],
        T.StructField(S.COST, T.DecimalType(38, S.MONEY.scale)),
        T.StructField(S.LINES, T.LongType()),
        T.StructField(S.MONTH, T.StringType()),
        T.StructField(PRINT, T.StringType()),
    ]
)


def _prints(spark: SparkSession, folder: str) -> set[tuple[str, str]]:
    """Month and fingerprint of each of a version's months."""
    found = bill_table.fingerprints(spark, folder)
    return {(r[S.MONTH], f"{r['line_count']}_{r['checksum']}") for r in found.toLocalIterator()}


def _folders(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/{n}" for n in files.names(spark, path) if n.startswith(versions.DATA)]


def _ready(spark: SparkSession, path: str) -> set[tuple[str, str]]:
    """The months that are rolled up completely."""
    done = [f for f in _folders(spark, path) if files.exists(spark, f"{f}/{_READY}")]
    return set().union(*[_prints(spark, f) for f in done])


def keep_rollup(spark: SparkSession, path: str, folder: str) -> list[str]:
    """Roll up those months of a version that no version has yet; returns them."""
    path = path.rstrip("/")
    if files.exists(spark, f"{folder}/{_READY}"):
        return []
    missing = sorted(_prints(spark, folder) - _ready(spark, path))
    if missing:
        lines = bill_table.read_version(spark, folder).filter(F.col(S.MONTH).isin([m for m, _ in missing]))
        prints = spark.createDataFrame(missing, f"{S.MONTH} string, {PRINT} string")  # one row for each month
        rolled = rollups.daily_rollup(lines, S.MONTH).join(F.broadcast(prints), S.MONTH)
        rolled = rolled.select(*[F.col(f.name).cast(f.dataType) for f in _ROLLUP.fields])
        # Only the partitions that are written are replaced.
        by_month = rolled.hint("rebalance", F.col(S.MONTH)).write.partitionBy(S.MONTH, PRINT)
        by_month.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{path}/{_DAILY}")
    files.write_new(spark, f"{folder}/{_READY}", "")
    return [m for m, _ in missing]


def read_daily(spark: SparkSession, path: str) -> DataFrame:
    """The current version's daily rollup with its ``month``; rolls up what is not there yet."""
    path = path.rstrip("/")
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"{path}: no bill table")
    keep_rollup(spark, path, folder)
    parts = [f"{path}/{_DAILY}/{S.MONTH}={m}/{PRINT}={p}" for m, p in sorted(_prints(spark, folder))]
    if not parts:
        return spark.createDataFrame([], _ROLLUP).drop(PRINT)
    return spark.read.schema(_ROLLUP).option("basePath", f"{path}/{_DAILY}").parquet(*parts).drop(PRINT)


def clean_rollups(spark: SparkSession, path: str) -> None:
    """Delete rollups of months that no version names any more."""
    path = path.rstrip("/")
    named = set().union(*[_prints(spark, f) for f in _folders(spark, path)])
    for month in files.names(spark, f"{path}/{_DAILY}"):
        if month.startswith(f"{S.MONTH}="):
            for kept in files.names(spark, f"{path}/{_DAILY}/{month}"):
                if (month.partition("=")[2], kept.partition("=")[2]) not in named:
                    files.delete(spark, f"{path}/{_DAILY}/{month}/{kept}")
