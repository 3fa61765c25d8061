"""Bill CSV files: read with rejects set aside, and write."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens import schema as S
from costlens.functions.dates import iso_date
from costlens.sources.records import BLOCK, FILE, HEADER, PLACE, RECORD, read_records

REJECT_REASON = "reject_reason"
FIELDS = "fields"
ORIGIN = (FILE, BLOCK, PLACE)
_MALFORMED = "_malformed"
_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
# As many whole digits as ``MONEY`` and twice the digits behind the point.
_FINER = T.DecimalType(38, 20)
_FINEST = rf"[.][0-9]{{{S.MONEY.scale}}}[0-9]*[1-9]"


def parse_bill_csv(
    spark: SparkSession,
    path: str,
    header: Mapping[str, str] = S.CSV_HEADER,
    multi_line: bool = False,
    origin: bool = False,
) -> DataFrame:
    """All lines of the CSV files, typed, with a reason and the fields on bad ones.

    ``fields`` is the text as read for rows that are no proper CSV of the header;
    for others it is their fields in file order, written as CSV with all blanks
    kept and quotes only where they are needed.

    Columns are found by header name, in any order; further columns are ignored.
    A missing column raises, and files whose headers differ make the read fail.
    ``multi_line`` allows line breaks inside quotes; a file is still read by many
    tasks (see ``records``). Without it such records are rejected. ``origin`` adds
    where each line was read: file, file block and order in the block.
    """
    options = {"header": True, "escape": '"', "multiLine": multi_line, "encoding": "UTF-8"}
    names = spark.read.options(**options).csv(path).columns
    missing = [h for h in header.values() if h not in names]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)} in the header")

    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*names, _MALFORMED]])
    text = _from_records(spark, path, fields) if multi_line else _from_lines(spark, path, fields, options)
    source = {ours: F.col(f"`{theirs}`") for ours, theirs in header.items()}
    typed = text.select(
        F.try_to_date(source[S.USAGE_DATE], "yyyy-MM-dd").alias(S.USAGE_DATE),
        *[
            F.coalesce(source[c], F.lit("")).alias(c)
            for c in (S.SERVICE, S.REGION, S.RESOURCE)
        ],
        source[S.COST].try_cast(S.MONEY).alias(S.COST),
        source[S.COST].try_cast(_FINER).alias("_cost"),
        source[S.COST].rlike(_FINEST).alias("_finer"),
        source[S.COST].try_cast("double").alias("_number"),
        F.col(_MALFORMED),
        *(ORIGIN if origin else ()),
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"),
    )
    # Written as CSV for rejected rows only.
    fields_read = F.to_csv("_row", _KEEP_BLANKS)
    reason = (
        F.when(F.col(_MALFORMED).isNotNull(), "malformed row")
        .when(F.col(S.USAGE_DATE).isNull(), "invalid date")
        .when(F.col("_number").isNull() | F.isnan("_number"), "invalid cost")
        # A cost is never rounded or capped: all its digits must have been kept.
        .when(
            F.col(S.COST).isNull()
            | ~F.col(S.COST).eqNullSafe(F.col("_cost"))
            | F.col("_finer")
            | ((F.col(S.COST) == 0) & (F.col("_number") != 0)),
            "cost out of range",
        )
    )
    return typed.select(
        *S.BILL_COLUMNS,
        reason.alias(REJECT_REASON),
        F.when(reason.isNotNull(), F.coalesce(F.col(_MALFORMED), fields_read)).alias(FIELDS),
        *(ORIGIN if origin else ()),
    )


def _from_lines(spark: SparkSession, path: str, fields: T.StructType, options: dict) -> DataFrame:
    """Fields of files in which each line is a record."""
    found = (
        spark.read.schema(fields)
        .options(**options)
        # A header that differs between files must fail rather than swap columns.
        .option("enforceSchema", False)
        # Reading all columns is what lets the parser notice short and long rows.
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", _MALFORMED)
        .csv(path)
    )
    return found.select(
        "*",
        F.col("_metadata.file_path").alias(FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(PLACE),
    )


def _from_records(spark: SparkSession, path: str, fields: T.StructType) -> DataFrame:
    """Fields of files in which a record may go over several lines."""
    options = {"escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED}
    kinds = ", ".join("`{}` string".format(n.replace("`", "``")) for n in fields.names)
    found = read_records(spark, path).withColumn("_row", F.from_csv(RECORD, kinds, options))
    names = [n for n in fields.names if n != _MALFORMED]
    same = [F.lower(F.col(f"_row.`{n}`")).eqNullSafe(F.lit(n.lower())) for n in names]
    expected = reduce(and_, same, F.col(f"_row.{_MALFORMED}").isNull())
    wrong = F.raise_error(F.concat(F.lit("CSV header does not match that of the first file: "), F.col(FILE)))
    data = F.when(~F.col(HEADER), True).when(expected, False).otherwise(wrong.cast("boolean"))
    return found.filter(data).select("_row.*", FILE, BLOCK, PLACE)


def valid_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(REJECT_REASON).isNull()).select(*S.BILL_COLUMNS)


def rejected_lines(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col(REJECT_REASON).isNotNull()).select(REJECT_REASON, FIELDS)


def write_bill_csv(
    bills: DataFrame, path: str, header: Mapping[str, str] = S.CSV_HEADER
) -> None:
    """Bill lines as header CSV part files, written in parallel."""
    text = {c: F.col(c).cast("string") for c in S.BILL_COLUMNS}
    text[S.USAGE_DATE] = iso_date(S.USAGE_DATE)
    (
        bills.select(*[text[c].alias(name) for c, name in header.items()])
        .write.mode("overwrite")
        .options(
            header=True,
            escape='"',
            encoding="UTF-8",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
        .csv(path)
    )
