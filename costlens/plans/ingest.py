"""Load of bill CSV files into the bill table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.sources import bill_csv, bill_table, files, rollup_table


class RejectedLines(ValueError):
    """A strict load met lines it cannot store."""


class LoadMismatch(RuntimeError):
    """What is stored is not what was read."""


@dataclass(frozen=True)
class LoadAudit:
    lines: int
    rejects: int
    sample: DataFrame


def load_bills(
    spark: SparkSession,
    csv_path: str,
    table_path: str,
    reject_path: str | None = None,
    strict: bool = False,
    header: Mapping[str, str] = S.CSV_HEADER,
    multi_line: bool = False,
) -> LoadAudit:
    """Replace the table by the valid lines of the CSV files and report counts.

    The files are parsed once: one write sets valid lines and rejects apart, and what was
    read is compared with what the files then hold, by count and checksum. The rejects are
    copied to ``reject_path``, if given, changed months are rolled up, and the lines become
    the table's current version. A ``strict`` load with rejects raises and leaves all as
    it was, as does one that stored anything else than it read.
    """
    parsed = bill_csv.parse_bill_csv(spark, csv_path, header, multi_line, origin=True)
    seen = Observation()
    staged = bill_table.stage_bills(parsed.observe(seen, *_valid_sums()), table_path)
    try:
        _compare(spark, staged, seen, parsed)
        rejected = bill_table.staged_rejects(spark, staged)
        rejects = rejected.count()
        if strict and rejects > 0:
            raise RejectedLines(f"{csv_path}: {rejects} lines rejected, table left as it was")
        if reject_path is not None:
            rejected.write.mode("overwrite").parquet(reject_path)
        rollup_table.keep_rollup(spark, table_path, staged)
    except Exception:
        files.delete(spark, staged)
        raise
    bill_table.publish(spark, staged, table_path)
    rollup_table.clean_rollups(spark, table_path)
    return audit(spark, table_path, rejects)


def _valid_sums() -> list:
    """Count and checksum of the lines without a reject reason."""
    valid = F.col(bill_csv.REJECT_REASON).isNull()
    return [
        F.count(F.when(valid, 1)).alias("line_count"),
        bill_table.line_checksum(valid).alias("checksum"),
    ]


def _compare(spark: SparkSession, staged: str, seen: Observation, parsed: DataFrame) -> None:
    """Raise if the stored lines are not those that were read.

    A task that had to run again is observed again, so a difference counts only if a
    second reading of the files shows it too. So does storing nothing: Spark observes no
    plan that it has found to be empty.
    """
    months = bill_table.fingerprints(spark, staged)
    checksum = F.sum(F.col("checksum").cast("decimal(38,0)")).cast("string")
    stored = _pair(months.agg(F.sum("line_count").alias("line_count"), checksum.alias("checksum")).first().asDict())
    if stored[0] > 0 and stored == _pair(seen.get):
        return
    if stored != _pair(parsed.agg(*_valid_sums()).first().asDict()):
        raise LoadMismatch(f"{staged}: stored lines differ from those read, table left as it was")


def _pair(sums: dict) -> tuple[int, str]:
    return sums["line_count"] or 0, sums["checksum"] or "0"


def audit(spark: SparkSession, table_path: str, rejects: int = 0, sample: int = 3) -> LoadAudit:
    """Stored line count, from the Parquet footers, and a few lines."""
    stored = bill_table.read_bills(spark, table_path)
    return LoadAudit(lines=stored.count(), rejects=rejects, sample=stored.limit(sample))
