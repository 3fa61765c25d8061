import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from costlens import schema as S  # noqa: E402
from costlens.session import builder  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        builder("costlens-tests")
        .master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def bills(spark):
    """Makes bill lines from (date, service, region, resource, cost) rows."""

    def make(*rows):
        text = "usage_date string, service string, region string, resource_id string, cost string"
        frame = spark.createDataFrame([tuple(map(str, r)) for r in rows], text)
        return frame.select(
            F.to_date(S.USAGE_DATE).alias(S.USAGE_DATE),
            S.SERVICE,
            S.REGION,
            S.RESOURCE,
            F.col("cost").cast(S.MONEY).alias(S.COST),
        )

    return make


@pytest.fixture
def rows():
    return lambda df: [tuple(r) for r in df.collect()]
