import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.01"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
SCHEMA = "doc_id long, text string, _id string, row string, key int, hash long, starts string, n_chars long"


@pytest.fixture(scope="session")
def texts():
    """Ids and texts of the documents at the small scale."""
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return dict(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, an id with two texts."""
    some = "the first of some words that are written here so that there is a text of a few words to be read again"
    rows = [
        (0, None), (1, ""), (2, " \n\t "), (3, "one"), (3, "one"), (3, "two words"), (None, some), (None, None),
        (4, some), (5, some + " and more"), (6, LONG), (7, LONG), (8, "ä ö ü ß 日本語 🎉"), (9, "one"), (2**40, "a\x00b"),
    ]
    return [(i, t, "x", "y", 1, 2, "z", len(t or "")) for i, t in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def docs(spark):
    return lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
