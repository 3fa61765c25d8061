"""Jobs: ``spark-submit`` this file, or ``python -m costlens``.

    costlens ingest BILLS.csv TABLE [--rejects PATH] [--strict] [--multi-line]
    costlens report TABLE
    costlens dashboard TABLE [--service S] [--region R] [--start D --end D]
    costlens export TABLE DIRECTORY
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from costlens import schema as S
from costlens.operators import alerts
from costlens.plans.dashboard import Dashboard
from costlens.plans.ingest import load_bills
from costlens.plans.reports import Reports
from costlens.session import builder
from costlens.sources.bill_csv import write_bill_csv
from costlens.sources.bill_table import read_bills

_LANGUAGES = {
    "en": (S.WEEKDAYS_EN, alerts.ENGLISH),
    "pt": (S.WEEKDAYS_PT, alerts.PORTUGUESE),
}


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="costlens")
    jobs = parser.add_subparsers(dest="job", required=True)
    ingest = jobs.add_parser("ingest", help="replace a bill table by CSV files")
    ingest.add_argument("csv")
    ingest.add_argument("table")
    ingest.add_argument("--rejects")
    ingest.add_argument("--strict", action="store_true")
    ingest.add_argument("--multi-line", action="store_true")
    report = jobs.add_parser("report", help="print the five reports")
    report.add_argument("table")
    page = jobs.add_parser("dashboard", help="print all frames under the filters")
    page.add_argument("table")
    for name in ("service", "region", "start", "end"):
        page.add_argument(f"--{name}")
    for job in (report, page):
        job.add_argument("--language", choices=_LANGUAGES, default="en")
    export = jobs.add_parser("export", help="write a bill table as CSV files")
    export.add_argument("table")
    export.add_argument("directory")
    args = parser.parse_args(argv)
    if args.job == "dashboard" and (args.start is None) != (args.end is None):
        parser.error("--start and --end go together")
    return args


def _show(frames: dict[str, DataFrame]) -> None:
    for name, frame in frames.items():
        print(f"\n{name}")
        print("\t".join(frame.columns))
        for row in frame.toLocalIterator():  # all rows, a partition at a time
            print("\t".join("" if x is None else str(x) for x in row))


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = _arguments(argv)
    if args.job == "ingest":
        result = load_bills(
            spark, args.csv, args.table, args.rejects, args.strict, multi_line=args.multi_line
        )
        print(f"{result.lines} lines stored, {result.rejects} rejected")
        _show({"sample": result.sample})
    elif args.job == "export":
        write_bill_csv(read_bills(spark, args.table), args.directory)
    elif args.job == "report":
        printed = Reports(read_bills(spark, args.table), _LANGUAGES[args.language][0])
        _show(printed.frames())
        printed.close()
    else:
        page = Dashboard.of_table(spark, args.table)
        scope = (args.service, args.region, args.start, args.end)
        _show(page.choices())
        _show(page.view(*scope, wording=_LANGUAGES[args.language][1]))
        page.close()


if __name__ == "__main__":
    session = builder().getOrCreate()
    try:
        run(session)
    finally:
        session.stop()
