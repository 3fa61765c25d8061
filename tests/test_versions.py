"""Replacement of the table: kept readers, jobs lost at every step, ids in input order, one parse."""

import re

import pytest
from plans import executions
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.plans.ingest import load_bills
from costlens.sources import bill_csv, bill_table, files, versions

HEADER = "data,servico,regiao,recurso_id,custo_usd"


class Lost(BaseException):
    """Stands for a killed job: nothing catches it to clean up."""


@pytest.fixture
def table(spark, bills, tmp_path):
    path = str(tmp_path / "bills")
    bill_table.replace_bills(bills(("2024-01-01", "old", "r", "x", 1)), path)
    return path


@pytest.fixture
def new(bills):
    return bills(("2024-01-01", "new", "r", "x", 1), ("2024-02-01", "new", "r", "y", 2))


def services(spark, path):
    return sorted(r[0] for r in bill_table.read_bills(spark, path).select(S.SERVICE).collect())


def folders(tmp_path):
    return len(list((tmp_path / "bills").glob("data-*")))


def test_a_reader_that_planned_before_the_swap_finishes(spark, table, new, tmp_path):
    planned = bill_table.read_bills(spark, table)
    with_ids = bill_table.read_bills(spark, table, line_ids=True)
    bill_table.replace_bills(new, table)
    assert [r[S.SERVICE] for r in planned.collect()] == ["old"]
    assert [r[S.LINE_ID] for r in with_ids.collect()] == [1]
    assert services(spark, table) == ["new", "new"]
    bill_table.replace_bills(new, table)
    bill_table.replace_bills(new, table)
    assert folders(tmp_path) == versions.KEEP
    assert len(list((tmp_path / "bills" / "manifests").glob("[0-9]*"))) == versions.KEEP


def lost(*_, **__):
    raise Lost


def test_lost_while_lines_are_written(spark, table, new):
    broken = new.select(*[F.col(c) if c != S.SERVICE else F.raise_error(F.lit("no")).alias(c) for c in S.BILL_COLUMNS])
    with pytest.raises(Exception, match="no"):
        bill_table.stage_bills(broken, table)
    assert services(spark, table) == ["old"]


def test_lost_before_the_blocks_are_numbered(spark, table, new, monkeypatch, tmp_path):
    monkeypatch.setattr(bill_table, "_number_blocks", lost)
    with pytest.raises(Lost):
        bill_table.replace_bills(new, table)
    assert services(spark, table) == ["old"] and folders(tmp_path) == 2


def test_lost_before_the_manifest(spark, table, new, monkeypatch):
    monkeypatch.setattr(files, "write_new", lost)
    with pytest.raises(Lost):
        bill_table.replace_bills(new, table)
    assert services(spark, table) == ["old"]


def test_lost_in_the_middle_of_the_manifest(spark, table, new, monkeypatch):
    write = files.write_new

    def half(spark, path, text):
        write(spark, path, text[: len(text) // 2])
        raise Lost

    monkeypatch.setattr(files, "write_new", half)
    with pytest.raises(Lost):
        bill_table.replace_bills(new, table)
    monkeypatch.undo()
    assert services(spark, table) == ["old"]
    bill_table.replace_bills(new, table)
    assert services(spark, table) == ["new", "new"]


def test_lost_before_old_versions_are_dropped(spark, table, new, monkeypatch, tmp_path):
    monkeypatch.setattr(versions, "clean", lost)
    with pytest.raises(Lost):
        bill_table.replace_bills(new, table)
    assert services(spark, table) == ["new", "new"]
    monkeypatch.undo()
    # what lost loads left goes once it is old enough not to be a load at work
    orphan = versions.new_folder(table)
    new.write.parquet(orphan)
    versions.clean(spark, table)
    assert files.exists(spark, orphan)
    versions.clean(spark, table, orphan_hours=-1)
    assert not files.exists(spark, orphan) and services(spark, table) == ["new", "new"]


def test_two_loads_at_a_time_leave_one_of_them(spark, table, new, bills):
    first = bill_table.stage_bills(new, table)
    second = bill_table.stage_bills(bills(("2024-03-01", "other", "r", "x", 1)), table)
    bill_table.publish(spark, second, table)
    bill_table.publish(spark, first, table)
    assert services(spark, table) == ["new", "new"]


def test_no_data_is_renamed(spark, table, new, tmp_path):
    """The files that a version is written as are those it is read from."""
    staged = bill_table.stage_bills(new, table)
    before = sorted((p, p.stat().st_ino) for p in (tmp_path / "bills").rglob("*.parquet"))
    bill_table.publish(spark, staged, table)
    assert sorted((p, p.stat().st_ino) for p in (tmp_path / "bills").rglob("*.parquet")) == before


def test_there_is_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        bill_table.read_bills(spark, str(tmp_path / "none"))


# --- ids in input order ---------------------------------------------------------------


def csv_files(tmp_path, with_rejects):
    """Three files, named against the order they are written in; the resource tells the place."""
    expected = []
    (tmp_path / "in").mkdir()
    for name, count in (("c", 40), ("a", 300), ("b", 1)):
        lines = [HEADER]
        for i in range(count):
            bad = with_rejects and i % 7 == 3 and i < 150
            lines.append(f"{'bad' if bad else f'2024-0{i % 4 + 1}-10'},s{i % 3},r,{name}{i:04d},{i}")
            expected += [] if bad else [f"{name}{i:04d}"]
        (tmp_path / "in" / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path / "in"), sorted(expected)


@pytest.mark.parametrize("with_rejects", [False, True])
@pytest.mark.parametrize("multi_line", [False, True])
def test_ids_follow_the_files_whatever_the_blocks(spark, tmp_path, with_rejects, multi_line):
    path, expected = csv_files(tmp_path, with_rejects)
    table = str(tmp_path / "bills")
    for size in ("128m", "700"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            load_bills(spark, path, table, multi_line=multi_line)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        stored = bill_table.read_bills(spark, table, line_ids=True).repartition(5)
        ids = sorted((r[S.LINE_ID], r[S.RESOURCE]) for r in stored.collect())
        assert ids == list(enumerate(expected, 1))


def test_blocks_with_rejects_at_their_ends_only_need_no_window(spark, bills, tmp_path):
    table = str(tmp_path / "bills")
    bill_table.replace_bills(bills(*[("2024-01-01", "s", "r", f"x{i}", i) for i in range(50)]).repartition(3), table)
    blocks = spark.read.schema(bill_table._BLOCK_ROW).parquet(f"{versions.current(spark, table)}/blocks")
    assert blocks.filter("whole").count() == blocks.count() == 3


# --- one parse ------------------------------------------------------------------------


def csv_scans(spark, job):
    """How many reads of CSV lines Spark has planned in the queries of a job."""
    plans = [plan for _, plan in executions(spark, job)]
    assert plans
    return sum(len(re.findall(r"Scan csv .*\n.*Output \[[1-9]\d*\]:.*_malformed", p)) for p in plans)


def test_a_load_parses_its_input_once(spark, tmp_path):
    path, expected = csv_files(tmp_path, True)
    table, rejects = str(tmp_path / "bills"), str(tmp_path / "rejects")
    result = []
    scans = csv_scans(spark, lambda: result.append(load_bills(spark, path, table, rejects)))
    assert (result[0].lines, result[0].rejects) == (len(expected), 341 - len(expected))
    assert spark.read.parquet(rejects).count() == 341 - len(expected)
    assert scans == 1
    twice = bill_csv.parse_bill_csv(spark, path)
    assert csv_scans(spark, lambda: (twice.collect(), twice.collect())) == 2
