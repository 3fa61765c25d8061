"""Registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm import (
    collocations,
    dart_minhash,
    decontamination,
    divergence,
    hnsw,
    impact,
    licenses,
    pieces,
    quality,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)
from costlens.llm.labels import not_held_out
from costlens.llm.rows import NO_ID
from costlens.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


TOKEN_LIMIT = 1024
_ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Let Python workers find the package where it is not installed, as in a checkout."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", _ROOT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = dart_minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", "keeps")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    found = docs.withColumn("score", quality.quality(docs, model))
    return found.select(
        "doc_id",
        (~not_held_out()).alias("held_out"),
        "score",
        (F.col("score") >= quality.GOOD).cast("int").alias("predicted"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.leaks(docs, table(spark, sf_dir, "benchmark"), exact=True)
    return found.select(F.nullif(F.col("_id"), F.lit(NO_ID)).alias("doc_id"), "item_id", "n_tokens", "covered", "verbatim")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    found = docs.withColumn("toxic", toxicity.toxicity(docs, model))
    return found.select(
        "doc_id",
        (~not_held_out()).alias("held_out"),
        F.col("toxic.score").alias("score"),
        (F.col("toxic.score") >= toxicity.REJECT).cast("int").alias("predicted"),
    )


def op2_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = token_counts.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    counts = token_counts.count_tokens(docs, tokenizer, cache=scratch_dir(spark))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("notices", F.array_join("notices", ", "))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = pieces.Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
    found = docs.select("doc_id", pieces.encode(spark, vocabulary, F.col("text")).alias("found"))
    return found.select(
        "doc_id",
        F.size("found.ids").cast("long").alias("n_pieces"),
        F.xxhash64("found.ids").alias("ids_hash"),
        F.col("found.exact").alias("round_trip"),
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = substring_dedup.remove_repeats(docs, window=20)
    return kept.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("text", "lang")
    return collocations.collocations(docs, max_words=3, min_count=10, top=2000, inside_pct=50)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text")
    return divergence.divergence(docs, min_docs=3, top=200)


def op13_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return impact.largest_products(vectors, vectors.filter(F.col("vec_id") % 50 == 0), k=5)


def queries() -> dict[str, Query]:
    return {
        "op1_dart_minhash": op1_dart_minhash,
        "op2_hnsw": op2_hnsw,
        "op3_token_counts": op3_token_counts,
        "op4_licenses": op4_licenses,
        "op6_sharding": op6_sharding,
        "op5_pieces": op5_pieces,
        "op7_quality": op7_quality,
        "op9_decontamination": op9_decontamination,
        "op10_toxicity": op10_toxicity,
        "op8_substring_dedup": op8_substring_dedup,
        "op11_collocations": op11_collocations,
        "op12_divergence": op12_divergence,
        "op13_impact": op13_impact,
    }


OP8_SQL = r"""
WITH split AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 18)) AS start FROM split WHERE len(words) >= 20),
shingles AS (
  SELECT doc_id, start, array_to_string(words[start:start + 19], ' ') AS passage FROM starts JOIN split USING (doc_id)),
ranked AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY passage ORDER BY doc_id, start) AS nth FROM shingles),
gone AS (
  SELECT DISTINCT doc_id, start + i AS place FROM ranked, range(0, 20) AS r(i) WHERE nth > 1),
places AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split),
kept AS (
  SELECT doc_id, count(g.place) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY p.place) FILTER (g.place IS NULL), '') AS kept_text
  FROM places p LEFT JOIN gone g USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept_text, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""


def _statements_sql(text: str) -> str:
    out = "lower(x)"
    for pattern in (licenses.COPYRIGHT, licenses.RIGHTS):
        out = f"regexp_replace({out}, '{pattern}', '')"
    out = f"CASE WHEN length({out}) < 100 THEN regexp_replace({out}, '{licenses.TITLE}', '') ELSE {out} END"
    out = f"regexp_replace({out}, '{licenses.BETWEEN_WORDS}', ' ', 'g')"
    for spelling, usual in licenses.SPELLINGS.items():
        out = f"replace({out}, '{spelling}', '{usual}')"
    parts = f"string_split(regexp_replace(coalesce({text}, ''), '{licenses.SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10))"
    return f"list_filter(list_transform({parts}, lambda x: trim({out})), lambda x: x <> '')"


_KNOWN_SQL = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licenses.KNOWN.items())
OP4_SQL = f"""
WITH known AS (
  SELECT license, sha256(array_to_string({_statements_sql("text")}, ' ')) AS digest
  FROM (VALUES {_KNOWN_SQL}) AS k(license, text)),
forms AS (SELECT doc_id, {_statements_sql("text")} AS forms FROM documents),
parts AS (SELECT doc_id, unnest(forms) AS form FROM forms),
found AS (SELECT DISTINCT doc_id, license FROM parts JOIN known ON digest = sha256(form)),
notices AS (
  SELECT doc_id, string_agg(license, ', ' ORDER BY license) AS notices FROM found GROUP BY doc_id),
whole AS (SELECT doc_id, sha256(array_to_string(forms, ' ')) AS digest FROM forms),
names AS (SELECT digest, min(license) AS license FROM known GROUP BY digest)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices
FROM whole LEFT JOIN names USING (digest) LEFT JOIN notices USING (doc_id)"""


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP11_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
phrases AS (
  SELECT lang, len(p) AS k, p FROM (
    SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS p
    FROM words, (VALUES (1), (2), (3)) AS lengths(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, array_to_string(p, ' ') AS phrase, any_value(p) AS p, count(*) AS a FROM phrases GROUP BY 1, 2, 3),
sizes AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
candidates AS (SELECT * FROM f WHERE k > 1 AND a >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, array_to_string(p[1:2], ' ') AS phrase FROM candidates WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(p[2:3], ' ') FROM candidates WHERE k = 3) GROUP BY 1, 2),
open AS (
  SELECT c.* FROM candidates c LEFT JOIN longer o ON o.lang = c.lang AND o.phrase = c.phrase AND c.k = 2
  WHERE o.a IS NULL OR 100 * o.a < 50 * c.a),
parts AS (
  SELECT lang, phrase, a, j, array_to_string(p[1:j], ' ') AS first, array_to_string(p[j + 1:k], ' ') AS last
  FROM open, (VALUES (1), (2)) AS cuts(j) WHERE j < k),
scored AS (
  SELECT parts.*, x.a AS l, y.a AS r,
         (CAST(1000000 AS HUGEINT) * parts.a * parts.a) // (CAST(x.a AS HUGEINT) * y.a) AS score
  FROM parts JOIN f x ON x.lang = parts.lang AND x.phrase = first AND x.k = j
  JOIN f y ON y.lang = parts.lang AND y.phrase = last),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""


OP12_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
found AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
cells AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
shares AS (
  SELECT *, 1 + (1000000000 * (CAST(n AS HUGEINT) + 1)) //
                (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM cells),
langs AS (SELECT lang, term, sum(n) AS n FROM cells GROUP BY 1, 2),
lang_shares AS (
  SELECT lang, term, 1 + (1000000000 * (CAST(n AS HUGEINT) + 1)) //
                     (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM langs),
pair_sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN pair_sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value
  FROM shares JOIN lang_shares USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 200"""


OP13_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_inner_product(q.v, c.v) AS BIGINT)) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v) GROUP BY 1, 2),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_licenses": OP4_SQL,
        "op8_substring_dedup": OP8_SQL,
        "op11_collocations": OP11_SQL,
        "op12_divergence": OP12_SQL,
        "op13_impact": OP13_SQL,
    }
