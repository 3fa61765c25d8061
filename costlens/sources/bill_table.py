"""The stored bill table: Parquet partitioned by month, replaced as a whole.

A version of the table (see ``versions``) holds the lines, the lines that a load rejected,
and one row for each block of the input, from which line ids follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import schema as S
from costlens.functions.dates import month_of
from costlens.sources import files, versions
from costlens.sources.bill_csv import BLOCK, FIELDS, FILE, ORIGIN, PLACE, REJECT_REASON

OUTCOME = "outcome"
VALID = "valid"
REJECTED = "rejected"
_BLOCKS = "blocks"
_PRINTS = "fingerprints"

_ORIGIN = [T.StructField(FILE, T.StringType()), T.StructField(BLOCK, T.LongType()), T.StructField(PLACE, T.LongType())]
_STORED = T.StructType([*S.BILL_LINE.fields, T.StructField(S.MONTH, T.StringType())])
_PLACED = T.StructType([*S.BILL_LINE.fields, *_ORIGIN, T.StructField(S.MONTH, T.StringType())])
_REJECTS = T.StructType([T.StructField(REJECT_REASON, T.StringType()), T.StructField(FIELDS, T.StringType())])
_PRINT_ROW = f"{S.MONTH} string, line_count long, checksum string"
_BLOCK_ROW = f"{FILE} string, {BLOCK} long, first long, before long, whole boolean"


def read_bills(spark: SparkSession, path: str, line_ids: bool = False) -> DataFrame:
    """Stored bill lines with their ``month``, and on request a ``line_id``.

    Ids run from 1 without gaps in the order of the input: file, place in the file, or
    for a frame its partitions and rows. They follow from where a line was read, whatever
    tasks read it, so a reload of the same files gives the same ids, and they cost nothing
    unless asked for.
    """
    version = versions.current(spark, path)
    if version is None:
        raise FileNotFoundError(f"{path}: no bill table")
    return read_version(spark, version, line_ids)


def read_version(spark: SparkSession, version: str, line_ids: bool = False) -> DataFrame:
    """The lines in the folder of a version, current or not."""
    if line_ids:
        return _with_ids(_read(spark, f"{version}/{OUTCOME}={VALID}", _PLACED), _read(spark, f"{version}/{_BLOCKS}", _BLOCK_ROW))
    return _read(spark, f"{version}/{OUTCOME}={VALID}", _STORED)


def _read(spark: SparkSession, folder: str, kind: T.StructType | str) -> DataFrame:
    """A part of a version; no rows where nothing was written."""
    if not files.exists(spark, folder):
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(folder)


def _with_ids(stored: DataFrame, blocks: DataFrame) -> DataFrame:
    """Lines counted up to the block, plus the line's rank in its block.

    The valid lines of a block without rejects between them have consecutive places.
    Only where there are some the lines of the block are ranked by a window.
    """
    placed = stored.join(blocks, [FILE, BLOCK])
    in_block = Window.partitionBy(FILE, BLOCK).orderBy(PLACE)
    ranks = {True: F.col(PLACE) - F.col("first"), False: F.row_number().over(in_block) - 1}
    parts = [
        placed.filter(F.col("whole") if whole else ~F.col("whole")).select(
            (F.col("before") + rank + 1).alias(S.LINE_ID), *_STORED.fieldNames()
        )
        for whole, rank in ranks.items()
    ]
    return parts[0].unionByName(parts[1])


def _number_blocks(spark: SparkSession, folder: str) -> None:
    """One row for each input block: how many valid lines lie before it."""
    lines = _read(spark, f"{folder}/{OUTCOME}={VALID}", _PLACED)
    blocks = lines.groupBy(FILE, BLOCK).agg(
        F.min(PLACE).alias("first"), F.max(PLACE).alias("last"), F.count(F.lit(1)).alias("n")
    )
    # The window sees one row for each block of the input, not lines.
    earlier = Window.orderBy(FILE, BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    blocks.select(
        FILE,
        BLOCK,
        "first",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        (F.col("last") - F.col("first") + 1 == F.col("n")).alias("whole"),
    ).write.parquet(f"{folder}/{_BLOCKS}")


def line_checksum(of: Column | None = None) -> Column:
    """A sum of the lines' hashes: the same in any order, another if a line is lost, repeated or altered."""
    line = F.xxhash64(*S.BILL_COLUMNS)
    line = line if of is None else F.when(of, line)
    # Three sums of up to 22 bits stay within a long for 2^41 lines; sums of decimals take objects for each line.
    low = F.lit(2**21 - 1).cast("long")
    parts = (F.shiftright(line, 42), F.shiftright(line, 21).bitwiseAND(low), line.bitwiseAND(low))
    high, middle, last = (F.sum(x).cast("decimal(20,0)") for x in parts)
    scale = F.lit(2**21).cast("decimal(7,0)")
    return ((high * scale + middle) * scale + last).cast("decimal(38,0)").cast("string")


def _fingerprint_months(spark: SparkSession, folder: str) -> None:
    """What the lines of each month are, read back from the written files."""
    stored = _read(spark, f"{folder}/{OUTCOME}={VALID}", _STORED)
    prints = stored.groupBy(S.MONTH).agg(F.count(F.lit(1)).alias("line_count"), line_checksum().alias("checksum"))
    prints.write.parquet(f"{folder}/{_PRINTS}")


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and checksum of each month of a version."""
    return _read(spark, f"{folder}/{_PRINTS}", _PRINT_ROW)


def _origin(bills: DataFrame) -> dict[str, Column]:
    """Where a line comes from: its file block, or its partition of a frame."""
    if all(c in bills.columns for c in ORIGIN):
        return {}
    return {
        FILE: F.lit(""),
        BLOCK: F.spark_partition_id().cast("long"),
        PLACE: F.monotonically_increasing_id(),
    }


def stage_bills(bills: DataFrame, path: str) -> str:
    """Write a version that nobody reads yet and return its folder.

    ``bills`` are lines, or parsed lines with their reject reason: then one write sets
    valid and rejected ones apart. Rebalancing gathers each month into files of the
    advisory size and splits a month that holds more than that, so neither tiny files nor
    one huge task arise.
    """
    spark = bills.sparkSession
    folder = versions.new_folder(path)
    placed = bills.withColumns(_origin(bills))
    if REJECT_REASON in bills.columns:
        valid = F.col(REJECT_REASON).isNull()
        columns = [*S.BILL_COLUMNS, REJECT_REASON, FIELDS, *ORIGIN]
    else:
        valid = F.lit(True)
        columns = [*S.BILL_COLUMNS, *ORIGIN]
    parts = {OUTCOME: F.when(valid, VALID).otherwise(REJECTED), S.MONTH: F.when(valid, month_of(S.USAGE_DATE))}
    placed = placed.select(*columns, *[x.alias(c) for c, x in parts.items()])
    try:
        placed.hint("rebalance", *[F.col(c) for c in parts]).write.partitionBy(*parts).parquet(folder)
        _number_blocks(spark, folder)
        _fingerprint_months(spark, folder)
    except Exception:
        files.delete(spark, folder)
        raise
    return folder


def staged_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Reason and fields of the lines that were rejected while the version was written."""
    return _read(spark, f"{folder}/{OUTCOME}={REJECTED}", _REJECTS)


def publish(spark: SparkSession, folder: str, path: str) -> None:
    """Make a staged version the table."""
    versions.publish(spark, path, folder)


def replace_bills(bills: DataFrame, path: str) -> None:
    """Full refresh of the table with ``bills``."""
    publish(bills.sparkSession, stage_bills(bills, path), path)
