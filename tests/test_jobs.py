import datetime as dt

import pytest

from costlens.__main__ import run
from costlens.sources.bill_csv import parse_bill_csv

HEADER = "data,servico,regiao,recurso_id,custo_usd"


def test_jobs_from_csv_to_csv(spark, tmp_path, capsys):
    csv, table, out = (str(tmp_path / n) for n in ("b.csv", "bills", "out"))
    lines = [f"2024-01-{d:02d},EC2,us-east-1,i-{d},{d}" for d in range(1, 29)]
    (tmp_path / "b.csv").write_text(
        "\n".join([HEADER, *lines, "bad"]), encoding="utf-8"
    )
    run(spark, ["ingest", csv, table])
    assert "28 lines stored, 1 rejected" in capsys.readouterr().out
    run(spark, ["report", table, "--language", "pt"])
    text = capsys.readouterr().out
    assert "2024-01" in text and "0-Domingo" in text
    run(spark, ["dashboard", table, "--service", "EC2", "--start", "2024-01-02", "--end", "2024-01-09"])
    text = capsys.readouterr().out
    assert "trend_series" in text and "2024-01-10" in text  # forecast
    run(spark, ["export", table, out])
    assert parse_bill_csv(spark, out).count() == 28


def test_everything_is_printed(spark, tmp_path, capsys):
    first = dt.date(2024, 1, 1)
    lines = [
        f"{first + dt.timedelta(d)},S{s:03d},us,i-{s},{d + s}.5"
        for d in range(110)
        for s in (range(150) if d == 0 else range(2))
    ]
    csv, table = tmp_path / "b.csv", str(tmp_path / "bills")
    csv.write_text("\n".join([HEADER, *lines]), encoding="utf-8")
    run(spark, ["ingest", str(csv), table])
    capsys.readouterr()
    run(spark, ["dashboard", table])
    text = capsys.readouterr().out
    assert sum(x.endswith("\tforecast") for x in text.split("\n")) == 30
    assert sum(x.endswith("\tactual") for x in text.split("\n")) == 110
    assert sum(x.startswith("service\tS") for x in text.split("\n")) == 150


def test_half_a_range_is_refused(spark):
    with pytest.raises(SystemExit):
        run(spark, ["dashboard", "/nowhere", "--start", "2024-01-01"])
