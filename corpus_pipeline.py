"""From raw documents to encoded training text, in five stages.

Each stage reads what the one before it wrote. All but the last return the columns of
``documents``; rows and texts that a stage rejects are gone for the next one. Null and
empty texts are clean: they pass every stage (copies of them as one group) and are
encoded as no pieces. Columns besides ``doc_id``, ``text`` and ``n_chars`` pass unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm import dart_minhash, decontamination, pieces, substring_dedup, toxicity
from costlens.llm.queries import importable, table
from costlens.llm.rows import KEY, keyed
from costlens.session import scratch_dir

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity reaches the threshold go. Fitted on ``labels``."""
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(docs, model)["score"] < toxicity.REJECT)


def _with_key(docs: DataFrame) -> DataFrame:
    """Key and text of each row, and all its columns as ``row``."""
    return keyed(docs, "doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).drop("text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    importable(spark)
    classes, _ = dart_minhash.near_duplicates(docs)
    kept = classes.filter("keeps").select(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("_id"), "_twin").distinct()
    return _with_key(docs).join(kept, KEY).dropDuplicates(KEY).select("row.*")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words and more stay only where they occur first; no row goes."""
    importable(spark)
    kept = substring_dedup.remove_repeats(docs, window=20, joined=False)
    changed = F.col("n_removed") > 0
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns if c != "text"}
    columns["text"] = F.col("kept_text")
    if "n_chars" in columns:
        columns["n_chars"] = F.when(changed, F.length("kept_text").cast("long")).otherwise(columns["n_chars"])
    return kept.select(*[columns[c].alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of ``benchmark``, also with other values, go."""
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"), exact=True)
    return _with_key(docs).join(found.select(*KEY).distinct(), KEY, "left_anti").select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of each text, their number, and whether decoding gives the text back."""
    importable(spark)
    vocabulary = pieces.Vocabulary.read(MODEL)
    found = docs.select("doc_id", pieces.encode(spark, vocabulary, F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        F.size("found.ids").cast("long").alias("n_pieces"),
        F.col("found.ids").alias("ids"),
        F.col("found.exact").alias("exact"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("pieces", encode_pieces),
]

# Neither the fitted scores nor signatures nor merges can be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_dir(spark)
    for i, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{folder}/{i}")
        docs = spark.read.schema(result.schema).parquet(f"{folder}/{i}")
    return docs
