"""Files with line breaks in quoted fields, cut in parallel, against Spark's reader of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from costlens import schema as S
from costlens.sources import bill_csv, records

HEADER = "data,servico,regiao,recurso_id,custo_usd"
BLOCK_SIZE = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def blocks_of(spark):
    """Sets the size of file blocks."""

    def to(size):
        spark.conf.set(BLOCK_SIZE, str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        # small splits are not made larger again for the sake of few tasks
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield to
    for name in (BLOCK_SIZE, "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(name)


@pytest.fixture
def file(tmp_path):
    def write(text, name="bills.csv"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(text.encode())
        return str(path)

    return write


def whole(spark, path):
    """What Spark reads with one task for each file; line breaks in rejected rows are line feeds in ours."""
    schema = ", ".join(f"{c} string" for c in [*HEADER.split(","), "_malformed"])
    found = (
        spark.read.schema(schema)
        .options(header=True, escape='"', multiLine=True, columnNameOfCorruptRecord="_malformed")
        .option("columnPruning", False)
        .csv(path)
        .withColumn("_malformed", F.replace("_malformed", F.lit("\r\n"), F.lit("\n")))
    )
    return sorted((tuple(r) for r in found.collect()), key=repr)


def ours(spark, path):
    from pyspark.sql import types as T

    fields = T.StructType([T.StructField(n, T.StringType()) for n in [*HEADER.split(","), "_malformed"]])
    found = bill_csv._from_records(spark, path, fields).select(*fields.names)
    return sorted((tuple(r) for r in found.collect()), key=repr)


def random_file(seed, count, end="\n"):
    rng = random.Random(seed)
    lines = [HEADER]
    for i in range(count):
        service = rng.choice([
            "plain", '"quoted"', '""', '"two\nlines"', '"a ""b"" c"', '"""x"""', '"\n\n"', '"ends ""\n"" so"',
            'in"side', '"a,b"', '"a,\nb"', "", " spaced ", '"' + "long\n" * rng.randint(1, 40) + '"',
        ])
        lines.append(f"2024-01-{i % 28 + 1:02d},{service},r{i},x{rng.randint(0, 9)},{i}.5")
        if rng.random() < 0.05:
            lines.append("")
        if rng.random() < 0.05:
            lines.append('short,"row\nof"')
    return end.join(x.replace("\n", end) for x in lines) + rng.choice(["", end])


@pytest.mark.parametrize("size", [7, 61, 1000, 10**8])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_the_whole_file_read_by_one_task(spark, file, blocks_of, size, end):
    path = file(random_file(size, 40 if size < 60 else 200, end))
    expected = whole(spark, path)
    blocks_of(size)
    assert ours(spark, path) == expected


def test_one_file_is_read_by_many_tasks(spark, file, blocks_of):
    path = file(random_file(1, 400))
    blocks_of(2000)
    parsed = bill_csv.parse_bill_csv(spark, path, multi_line=True, origin=True)
    assert parsed.select(records.BLOCK).distinct().count() > 4
    assert spark.read.text(path).rdd.getNumPartitions() > 4
    # the reader of whole files has one task
    assert spark.read.options(multiLine=True, header=True).csv(path).rdd.getNumPartitions() == 1


def test_quotes_on_every_place_of_a_block_border(spark, file, blocks_of):
    text = HEADER + '\n2024-01-01,"a""\n""b",r,x,1\n2024-01-02,"\n",r,"",2\n2024-01-03,c,r,x,3\n'
    path = file(text)
    expected = whole(spark, path)
    assert len(expected) == 3
    for size in range(1, 45, 6):
        blocks_of(size)
        assert ours(spark, path) == expected, size


def test_a_record_over_many_blocks_and_one_that_never_ends(spark, file, blocks_of):
    path = file(HEADER + '\n2024-01-01,"' + "line\n" * 300 + '",r,x,1\n2024-01-02,s,r,x,2\n2024-01-03,"open\nto the end')
    expected = whole(spark, path)
    blocks_of(100)
    assert ours(spark, path) == expected


def test_order_of_records_does_not_depend_on_blocks(spark, file, blocks_of):
    path = file(random_file(5, 150))

    def in_order():
        order = [records.FILE, records.BLOCK, records.PLACE]
        return [r[records.RECORD] for r in records.read_records(spark, path).orderBy(*order).collect()]

    expected = in_order()
    assert expected[0] == HEADER
    for size in (50, 333):
        blocks_of(size)
        assert in_order() == expected


def test_headers_are_checked_in_all_files(spark, file, tmp_path):
    file(HEADER + "\n2024-01-01,a,r,x,1\n", "in/a.csv")
    file("\n" + HEADER.upper() + "\n2024-01-02,b,r,x,1\n", "in/b.csv")
    file(HEADER, "in/c.csv")
    assert bill_csv.parse_bill_csv(spark, str(tmp_path / "in"), multi_line=True).count() == 2
    file("servico,data,regiao,recurso_id,custo_usd\nb,2024-01-02,r,x,1\n", "in/d.csv")
    with pytest.raises(Exception, match="(?i)header"):
        bill_csv.parse_bill_csv(spark, str(tmp_path / "in"), multi_line=True).collect()


def test_names_with_dots_and_rejects(spark, file):
    path = file('x.y,custo_usd,data,recurso_id,servico,regiao\n"1\n2",5,2024-01-01,i,"s\nt",r\n1,bad,2024-01-01,i,"a\nb",r\n')
    parsed = bill_csv.parse_bill_csv(spark, path, multi_line=True)
    assert [r[S.SERVICE] for r in bill_csv.valid_lines(parsed).collect()] == ["s\nt"]
    assert [tuple(r) for r in bill_csv.rejected_lines(parsed).collect()] == [("invalid cost", '1,bad,2024-01-01,i,"a\nb",r')]


def test_steps_can_be_put_together_in_any_grouping(spark):
    steps = [0, 1, 2, 3, 1, 1, 0, 3, 1, 2, 1, 0]
    df = spark.createDataFrame(list(enumerate(steps)), "at int, step int")
    from pyspark.sql import Window

    got = records._together(df, "step", "upto", Window.orderBy("at")).orderBy("at")
    for start in (0, 1):
        state, expected = start, []
        for s in steps:
            state = s - 2 if s >= 2 else (state + s) % 2
            expected.append(state)
        assert [r.s for r in got.select(records._state(F.lit(start), F.col("upto")).alias("s")).collect()] == expected


def test_runs_inside_a_block_meet(spark, file, monkeypatch):
    """Lines of one block are cut in runs of a few lines; records over several runs come out whole."""
    rows = [f'2024-01-{i % 28 + 1:02d},"a\n""{i}"",{chr(10) * (i % 11)}",r-{i},{i}.50' if i % 3 else f"2024-01-02,s{i},r,{i}" for i in range(300)]
    path = file("\n".join([HEADER.replace("regiao,", ""), *rows]) + "\n")
    sizes = []
    together = records._together

    def spied(df, step, into, order):
        if records.RUN in df.columns and "line" in df.columns:
            sizes.append(max(r[0] for r in df.groupBy(*records._OF_RUN).count().select("count").collect()))
        return together(df, step, into, order)

    monkeypatch.setattr(records, "_together", spied)
    cut = {}
    for size in (4096, 4):
        monkeypatch.setattr(records, "RUN_LINES", size)
        cut[size] = [r[records.RECORD] for r in records.read_records(spark, path).orderBy(records.PLACE).collect()]
    assert cut[4096] == cut[4] == [HEADER.replace("regiao,", ""), *rows]
    assert sizes[0] > 1000 and sizes[1] == 4
