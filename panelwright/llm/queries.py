"""The registered queries of the dealt operators, and their SQL twins where SQL can express them."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import (byte_bpe, chosen_path, dialogue_repair, language_id, license_scan, line_crf, maxent_lm, mixing, packing, pivotal_grams, secret_ledger,
                             vector_join, warc)
from panelwright.llm.common import remainder

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _QUERIES[fn.__name__] = fn
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Twins for DuckDB; the other operators learn models, search greedily or give doubles whose last bits depend on the order of sums."""
    return {"op2_warc": """
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
      FROM h),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to FROM w"""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document, the surest first, with the paragraphs they stand in; `unknown` only where no family is known."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = license_scan.scan(docs, license_scan.train(docs)).drop("text")
    known = F.filter("licences", lambda x: x["family"] != license_scan.UNKNOWN)
    best = F.array_sort(F.when(F.size(known) > 0, known).otherwise(F.col("licences")), lambda a, b: F.when(a["probability"] > b["probability"], -1).when(a["probability"] < b["probability"], 1)
                        .otherwise(a["line"] - b["line"]))
    return found.select("doc_id", F.coalesce(F.get(best, F.lit(0))["family"], F.lit(license_scan.NONE)).alias("license"),
                        F.coalesce(F.get(best, F.lit(0))["probability"], F.lit(0.0)).alias("probability"),
                        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda x: x["family"]))), ",").alias("families"),
                        F.size("licences").alias("n_paragraphs"), F.transform("licences", lambda x: x["line"]).alias("lines"))


@query
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives and read back: responses with their payloads, revisits by their headers alone."""
    spark.conf.set(warc.PUSHDOWN, "true")  # a session setting that concerns Python data sources only
    archive = warc.write_pages(table(spark, sf_dir, "pages"))
    full = warc.read(spark, archive, payload="digest").filter("record_type = 'response'")
    heads = warc.read(spark, archive, payload="none").filter("record_type = 'revisit'")
    declared = F.regexp_replace("declared_digest", "^sha1:", "")
    return full.withColumn("digest", F.col("payload_digest")).unionByName(heads.withColumn("digest", declared)).select(
        warc.page_of("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        warc.page_of("refers_to").alias("refers_to"))


@query
def op3_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every row whose id is divisible by 50."""
    return vector_join.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op4_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under a model of the six sevenths that are not held out."""
    part = remainder("doc_id", 7)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out"))
    learned = docs.filter(F.col("doc_id").isNotNull() & ~F.col("held_out")).select("doc_id", "text")
    model, counts = maxent_lm.train(learned, F.col("doc_id"))
    return maxent_lm.score(docs, model, counts).withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, as pieces placed in sequences of five permitted lengths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", packing.token_count("text").alias("n_tokens"))
    return packing.pack(docs, "doc_id", "n_tokens")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources reach 95 % of the greatest entropy within four repetitions, over a budget of all tokens once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", packing.token_count("text").alias("n_tokens"))
    totals = mixing.source_totals(docs, "source", "n_tokens")
    n, budget = totals.filter("share > 0").agg(F.count(F.lit(1)), F.sum("tokens")).first()
    a = mixing.solve_exponent(totals, entropy=0.95 * math.log(max(n, 1)), limit=4.0, budget_share=1.0)
    return mixing.mix(docs, mixing.weights(totals, a, budget or 0), "doc_id", "source", "n_tokens").withColumn("exponent", F.lit(a))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the texts and labels of three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = language_id.train(docs, "doc_id", "text", "lang", ~held_out)
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "entropy")


@query
def op8_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = line_crf.train(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge(docs, chain).drop("text")


@query
def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document, scanned once per distinct content."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = F.col("findings")
    return secret_ledger.scan(docs).select(
        "doc_id", *[secret_ledger.count_of(found, k).alias(f"n_{k}") for k in secret_ledger.BASE_KINDS],
        F.sha2(secret_ledger.in_order(found, secret_ledger.BASE_KINDS), 256).alias("base_sha256"),
        secret_ledger.in_order(found).alias("spans"))


@query
def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates and its number of links: five-word shingles, Jaccard 0.8 or more."""
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every damaged conversation and its cheapest repair."""
    damaged = dialogue_repair.damage(table(spark, sf_dir, "conversations"))
    return dialogue_repair.repair(damaged)


@query
def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as ids of a public vocabulary, and its bytes back from the ids."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_text=False)
    return byte_bpe.decode(encoded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op13_pivotal_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that occurs three times or more, misspelt at a fixed rate, with its commoner form."""
    return pivotal_grams.variants(pivotal_grams.word_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
