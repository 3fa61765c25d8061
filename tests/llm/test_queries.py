"""Registered queries against their SQL, and the pipeline as a whole."""

import sys
from pathlib import Path

import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

import __spark_entry__ as registry
import corpus_pipeline
from costlens.llm import decontamination, queries, toxicity

SF = "/root/testdata/sf0.001"


def test_all_queries_are_registered():
    names = registry.queries()
    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert set(queries.oracle_sql()) <= set(names) and set(queries.oracle_sql()) <= set(registry.oracle_sql())


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_gives_rows(spark, name):
    found = queries.queries()[name](spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert found.count() == n if name not in ("op2_hnsw", "op9_decontamination") else found.count() > 0


def test_results_of_fixed_columns(spark):
    kinds = {
        "op2_hnsw": "query_id bigint rank int vec_id bigint score double",
        "op3_token_counts": "doc_id bigint n_bytes bigint n_tokens bigint over_limit boolean",
        "op6_sharding": "doc_id bigint size bigint text_crc32 bigint law string shard int slot bigint grown_shard int",
        "op7_quality": "doc_id bigint held_out boolean score double predicted int",
        "op8_substring_dedup": "doc_id bigint n_words bigint n_removed bigint kept_sha256 string",
        "op10_toxicity": "doc_id bigint held_out boolean score double predicted int",
        "op11_collocations": "lang string rank bigint phrase string a bigint l bigint r bigint n bigint score bigint",
        "op12_divergence": "lang string source string part string item string value bigint rank int",
        "op13_impact": "query_id bigint rank int vec_id bigint score bigint",
    }
    for name, kind in kinds.items():
        found = queries.queries()[name](spark, SF)
        assert " ".join(f"{c} {t}" for c, t in found.dtypes) == kind, name


def stages(spark, docs, sf_dir, folder):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        after = spark.read.parquet(f"{folder}/{i}")
        yield name, docs, after
        docs = after


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for name, before, after in stages(spark, docs, SF, tmp_path):
        if name != "pieces":
            assert after.dtypes == docs.dtypes and after.count() <= before.count()
            assert after.join(before, "doc_id", "left_anti").isEmpty()
        if name == "toxicity":
            model = toxicity.fit_on(before, labels)
            kept = before.filter(toxicity.toxicity(before, model)["score"] < toxicity.REJECT)
            assert after.exceptAll(kept).isEmpty() and kept.exceptAll(after).isEmpty()
        elif name == "near duplicates":
            assert after.count() == after.select("text").distinct().count() < before.count()
        elif name == "substring dedup":
            assert after.count() == before.count()
            assert after.filter(F.length("text") != F.col("n_chars")).join(before, list(before.columns), "left_anti").isEmpty()
        elif name == "benchmark decontamination":
            assert decontamination.leaks(after, bench).isEmpty() and not decontamination.leaks(before, bench).isEmpty()
        else:
            assert after.count() == before.count() and after.filter("not exact or n_pieces <> size(ids)").isEmpty()


def test_run_is_all_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == ["doc_id", "n_pieces", "ids", "exact"] and found.filter("exact").count() == found.count() > 0


def test_stages_on_odd_rows(spark, odd, none, tmp_path):
    for k, docs in enumerate((odd, none)):
        for _, before, after in stages(spark, docs, SF, tmp_path / str(k)):
            assert after.count() <= before.count()


def test_the_rest_does_not_import_the_package():
    root = Path(registry.__file__).parent
    for path in root.glob("costlens/**/*.py"):
        assert "llm" in path.parts or "llm" not in path.read_text(), path
    assert "costlens.llm.queries" in sys.modules
