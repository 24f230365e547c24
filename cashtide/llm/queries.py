"""The operators of this subpackage over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashtide.llm import bpe, packing, rules, spelling, toxicity, transducer
from cashtide.llm.common import table
from cashtide.llm.embeddings import near_vectors
from cashtide.llm.exact_dedup import exact_dedup
from cashtide.llm.licenses import license_scan
from cashtide.llm.near_dedup import near_dedup
from cashtide.llm.periodic import periodic_runs, run_digest
from cashtide.llm.secrets import secret_scan, span_digest
from cashtide.llm.sharding import shard_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build: Query) -> Query:
    """Register a query under its name."""
    QUERIES[build.__name__] = build
    return build


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secret_scan(table(spark, sf_dir, "documents")))


@query
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL["op2_exact_dedup"] = r"""
WITH bare AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM bare
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id)
"""


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return transducer.token_counts(table(spark, sf_dir, "documents"), path)


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=2)


@query
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.round_trip(table(spark, sf_dir, "documents"), path)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagged = toxicity.tag(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return tagged.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), path)


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def checksum(*parts):
    """crc32 of the parts' text in UTF-8, joined; a null part counts as the empty text."""
    return F.crc32(F.concat(*(F.coalesce(part.cast("string"), F.lit("")) for part in parts)).cast("binary"))


def misspelt(runs: DataFrame) -> DataFrame:
    """(word) of runs (doc_id, word), where every 31st by checksum lacks one code point."""
    h = checksum(F.col("doc_id"), F.lit(":"), F.col("word"))
    at = F.col("h") % F.length("word")
    less = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    numbered = runs.withColumn("h", h).withColumn("at", at.cast("int"))
    return numbered.select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("word")).alias("word"))


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = misspelt(spelling.letter_runs(table(spark, sf_dir, "documents")))
    return spelling.variants(spelling.vocabulary(runs))


@query
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = rules.rate(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    return rated.select(
        "doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def repeating(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents, where each tenth by checksum repeats a passage to its end."""
    chosen = docs.select("doc_id", "text", checksum(F.col("doc_id")).alias("h"))
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    listed = chosen.withColumn("w", words).withColumn("n", F.size("w")).withColumn("g", F.expr("h div 10"))
    placed = listed.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    again = F.expr("array_join(transform(sequence(0, n - 1), i -> w[CAST(if(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return placed.select("doc_id", F.when(F.col("n") > 0, again).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(repeating(table(spark, sf_dir, "documents"))))
