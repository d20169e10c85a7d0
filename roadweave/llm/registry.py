"""Registered queries of the corpus operators and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm import backoff, html_text, packing, periodic_runs, pseudonyms, quality, relative_lz, segment_search, simhash, spelling, templates, token_counts, toxicity
from roadweave.session import shared_folder

SECRET = b"replace this secret before publishing texts"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), VOCABULARY)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(_read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}", VOCABULARY)


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return segment_search.top_k(table, table.where("vec_id % 50 = 0"), 5, scale=256)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relative_lz.remove_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("found").alias("n_passages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonyms.replace(_read(spark, sf_dir, "documents"), SECRET)
    return found.select("doc_id", "text", F.size("spans").alias("n_replaced"), F.concat_ws(",", F.transform("spans", lambda s: s.kind)).alias("kinds"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", (h % 7 == 2).alias("held_out"))
    return backoff.score(docs, "held_out").withColumnRenamed("held", "held_out")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spelling.variants(spelling.word_counts(_read(spark, sf_dir, "documents"), rate=97))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))))
    g, w, n = F.floor(h / 10).cast("long"), F.col("w"), F.size("w").cast("long")
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
    tail = F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.element_at(w, (a + (i - a) % p + 1).cast("int"))))
    docs = docs.withColumn("text", F.when(n > 0, F.concat_ws(" ", tail)).otherwise(F.col("text")))
    found = periodic_runs.find_runs(docs)
    better = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    kind = "struct<start: long, length: long, period: long>"
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda best, r: F.when(better(best, r), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        sha(F.concat_ws("", lines)).alias("runs_sha256"), sha(F.col("kept")).alias("collapsed_sha256"),
    )


REGISTRY = [
    op1_quality_classifier, op2_best_fit_packing, op3_token_counts, op4_exact_top_k, op5_decontamination,
    op6_substring_dedup, op7_toxicity, op8_pii, op9_html_text, op10_simhash, op11_lm_scores,
    op12_spelling_variants, op13_periodic_runs,
]
SQL: dict[str, str] = {
    "op4_exact_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id, max(list_dot_product(q.e, c.e)::BIGINT) AS score
          FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e) GROUP BY ALL)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_substring_dedup": r"""
        WITH d AS (
          SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
          SELECT rid, i, array_to_string(w[i:i + 34], ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
        starts AS (SELECT rid, i FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
        gone AS (SELECT DISTINCT rid, i + j AS i FROM (SELECT rid, i, unnest(range(0, 35)) AS j FROM starts)),
        kept AS (
          SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept
          FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) AS x
          WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.rid = x.rid AND gone.i = x.i) GROUP BY rid)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid) LEFT JOIN (SELECT rid, count(*) AS n FROM gone GROUP BY rid) USING (rid)""",
}
