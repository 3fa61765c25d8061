"""Connected components of a table of links, by large-star and small-star rounds.

Each round is two grouped minima and two joins on the links alone and is written to the
shared folder, so lineage stays short and a lost executor costs no more than a round. A
node with very many links is met by a partial minimum and by joins that adaptive
execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a table to the shared folder and go on from there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(links: DataFrame) -> DataFrame:
    """Tie all larger neighbours of a node to the smallest node around it."""
    around = links.select(F.col("v").alias("x"), F.col("u").alias("y")).unionByName(
        links.select(F.col("u").alias("x"), F.col("v").alias("y"))
    )
    lowest = around.groupBy("x").agg(F.min("y").alias("m"))
    larger = around.filter("y > x").join(lowest, "x")
    return larger.select(F.col("y").alias("v"), F.least("x", "m").alias("u")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them."""
    lowest = links.groupBy("v").agg(F.min("u").alias("m"))
    others = links.join(lowest, "v").filter("u > m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return others.unionByName(lowest.select("v", F.col("m").alias("u"))).distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """For links ``a``, ``b`` of numbers, the ``root`` of each ``node`` but the roots themselves.

    A root is the smallest node of its component. No links give no rows; a null end or
    a link of a node with itself is no link.
    """
    ends = links.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    current, before, turn = stored(ends, f"{folder}-0"), None, 0
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if seen == before or not seen[0]:
            return current.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before, turn = seen, turn + 1
        current = stored(_small_star(_large_star(current)), f"{folder}-{turn}")
