"""The stored daily rollup and the comparison of what a load read with what it stored."""

import pytest
from plans import executions
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.operators import rollups
from costlens.plans import ingest
from costlens.plans.dashboard import Dashboard
from costlens.plans.ingest import LoadMismatch, load_bills
from costlens.sources import bill_csv, bill_table, files, rollup_table, versions

HEADER = "data,servico,regiao,recurso_id,custo_usd"


@pytest.fixture
def load(spark, tmp_path):
    """Loads lines of (month, cost) pairs into one table."""

    def run(*lines, **kwargs):
        path = tmp_path / "bills.csv"
        rows = [f"2024-{m:02d}-{i % 20 + 1:02d},s{i % 3},r{i % 2},x{i},{cost}" for i, (m, cost) in enumerate(lines)]
        path.write_text("\n".join([HEADER, *rows]) + "\n")
        load_bills(spark, str(path), str(tmp_path / "bills"), **kwargs)
        return str(tmp_path / "bills")

    return run


def rows(df):
    return sorted(tuple(r) for r in df.select(S.USAGE_DATE, S.SERVICE, S.REGION, S.COST, S.LINES).collect())


def line_scans(spark, job):
    """How many queries of a job read the table's lines."""
    plans = [plan for _, plan in executions(spark, job)]
    assert plans
    return sum("outcome=valid" in p for p in plans)


BASE = [(1, 5)] * 30 + [(2, 7)] * 30 + [(3, 1)] * 5


def test_rollup_equals_that_of_the_lines(spark, load):
    table = load(*BASE)
    assert rows(rollup_table.read_daily(spark, table)) == rows(rollups.daily_rollup(bill_table.read_bills(spark, table)))


def test_a_start_reads_no_lines(spark, load):
    table = load(*BASE)

    def start():
        page = Dashboard.of_table(spark, table)
        assert len(page.choices()["facets"].collect()) == 5
        assert page.daily.count() > 0
        page.close()

    assert line_scans(spark, start) == 0
    assert line_scans(spark, bill_table.read_bills(spark, table).collect) == 1
    page = Dashboard.of_table(spark, table)
    plain = Dashboard(bill_table.read_bills(spark, table))
    for name, frame in plain.view(region="r1").items():
        mine = page.view(region="r1")[name].collect()
        for a, b in zip(mine, frame.collect(), strict=True):
            assert [pytest.approx(x) if isinstance(x, float) else x for x in a] == list(b), name
    page.close()
    plain.close()


def test_only_changed_months_are_rolled_up(spark, load, tmp_path):
    table = load(*BASE)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "bills" / "daily").rglob("*.parquet")}
    changed = [(m, 9 if i == 40 else c) for i, (m, c) in enumerate(BASE)]
    load(*changed)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "bills" / "daily").rglob("*.parquet")}
    assert {p for p in after if p not in before and "month=2024-02" in str(p)} == set(after) - set(before) != set()
    assert all(after[p] == t for p, t in before.items() if p in after)
    assert rows(rollup_table.read_daily(spark, table)) == rows(rollups.daily_rollup(bill_table.read_bills(spark, table)))
    # the version before is still there with its months, two loads later it is not
    assert set(before) <= set(after)
    load(*changed)
    load(*changed)
    left = set((tmp_path / "bills" / "daily").rglob("*.parquet"))
    assert left == {p for p in after if "month=2024-02" not in str(p) or p not in before}


def test_a_changed_month_is_noticed_without_a_load(spark, load):
    table = load(*BASE)
    lines = bill_table.read_bills(spark, table)
    bill_table.replace_bills(lines.filter("month <> '2024-03'"), table)
    folder = versions.current(spark, table)
    assert rollup_table.keep_rollup(spark, table, folder) == []  # the two others are known
    bill_table.replace_bills(lines.withColumn(S.REGION, F.lit("z")), table)
    daily = rollup_table.read_daily(spark, table)
    assert {r[S.REGION] for r in daily.collect()} == {"z"}


def test_a_lost_rollup_is_made_again(spark, load, monkeypatch, tmp_path):
    table = load(*BASE)
    bill_table.replace_bills(bill_table.read_bills(spark, table).withColumn(S.SERVICE, F.lit("t")), table)
    write = files.write_new
    monkeypatch.setattr(files, "write_new", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        rollup_table.read_daily(spark, table)
    monkeypatch.setattr(files, "write_new", write)
    for half in (tmp_path / "bills" / "daily" / "month=2024-01").rglob("*.parquet"):
        if "print=30_" in str(half):
            half.write_bytes(half.read_bytes()[:50])  # as cut off while it was moved in place
            (half.parent / f".{half.name}.crc").unlink(missing_ok=True)
    assert rollup_table.keep_rollup(spark, table, versions.current(spark, table)) == ["2024-01", "2024-02", "2024-03"]
    assert {r[S.SERVICE] for r in rollup_table.read_daily(spark, table).collect()} == {"t"}


def test_empty_table_has_an_empty_rollup(spark, load):
    assert rollup_table.read_daily(spark, load()).collect() == []
    with pytest.raises(FileNotFoundError):
        rollup_table.read_daily(spark, "/tmp/there-is-none")


@pytest.mark.parametrize("damage", ["dropped", "repeated", "altered"])
def test_stored_lines_that_differ_are_caught(spark, load, monkeypatch, damage):
    table = load(*BASE)
    stage = bill_table.stage_bills

    def damaged(parsed, path):
        last = F.col(S.RESOURCE) == "x3"
        if damage == "dropped":
            parsed = parsed.filter(~last)
        elif damage == "repeated":
            parsed = parsed.withColumn("n", F.explode(F.sequence(F.lit(1), F.when(last, 2).otherwise(1))))
        else:
            parsed = parsed.withColumn(S.COST, F.when(last, F.col(S.COST) + 1).otherwise(F.col(S.COST)).cast(S.MONEY))
        return stage(parsed, path)

    monkeypatch.setattr(ingest.bill_table, "stage_bills", damaged)
    with pytest.raises(LoadMismatch):
        load(*BASE)
    assert bill_table.read_bills(spark, table).count() == len(BASE)


def test_lines_that_were_observed_twice_are_no_difference(spark, load, monkeypatch):
    class Twice:
        get = {"line_count": 2 * len(BASE), "checksum": "1"}

    monkeypatch.setattr(ingest, "Observation", lambda: Twice())
    monkeypatch.setattr("pyspark.sql.DataFrame.observe", lambda df, *a: df, raising=False)
    import pyspark.sql.classic.dataframe as classic

    monkeypatch.setattr(classic.DataFrame, "observe", lambda df, *a: df)
    assert bill_table.read_bills(spark, load(*BASE)).count() == len(BASE)


def test_checksum_is_the_sum_of_all_hashes(spark, bills):
    """The long sums give what a sum of decimals gave; no lines give null."""
    df = bills(*[(f"2024-01-{i % 28 + 1:02d}", f"s{i}", "r", f"x{i % 7}", f"{i}.25") for i in range(500)])
    plain = F.sum(F.xxhash64(*S.BILL_COLUMNS).cast("decimal(20,0)")).cast("string")
    few = F.col(S.SERVICE).startswith("s4")
    some = F.sum(F.when(few, F.xxhash64(*S.BILL_COLUMNS).cast("decimal(20,0)"))).cast("string")
    row = df.agg(plain, bill_table.line_checksum(), some, bill_table.line_checksum(few)).first()
    assert row[0] == row[1] and row[2] == row[3]
    assert df.limit(0).agg(bill_table.line_checksum()).first()[0] is None


def test_fields_are_written_for_rejects_only(spark, bills, tmp_path):
    """A valid line is not written as CSV once more: only the last projection does so, under its condition."""
    bill_csv.write_bill_csv(bills(("2024-01-01", "a", "r", "x", "1")), str(tmp_path))
    plan = bill_csv.parse_bill_csv(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    lines = [line for line in plan.split("\n") if "to_csv" in line or "StructsToCsv" in line]
    assert len(lines) == 1 and "CASE WHEN" in lines[0].split("to_csv")[0]
