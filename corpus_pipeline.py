"""A corpus prepared in five stages: documents in known languages, one of each group of near duplicates, secrets blanked out, sources mixed, sequences packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. run() writes each
stage's rows to shared storage and gives the next stage a scan of them.

Defined cases, for every stage: texts of any length are taken whole; ids may be null or repeat; columns beyond those of documents, whatever their names, are carried
along by all stages but the last; an empty table gives an empty result. Null texts and texts without a letter have no language and go in the first stage, as do all where no row has a
label. Texts of one to four words are one shingle; of a class that repeats its least id one row stays. A null source is a source; sources without tokens are used once. A text
without words is one end token.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelwright.llm import chosen_path, language_id, mixing, packing, secret_ledger
from panelwright.llm.common import fresh, stage

REPEATS = 2.0  # no source is used more than twice


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model recognises; it learns from the texts that carry a label."""
    model = language_id.train(docs, "doc_id", "text", "lang", F.lit(True))
    rejected = fresh(docs, "lang_pred", "score", "rejected", "entropy")[2]
    return language_id.identify(docs, model).filter(~F.col(rejected)).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates."""
    return chosen_path.keep_one(docs, "doc_id", "text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each secret replaced by the name of its kind; n_chars follows the text."""
    scanned = secret_ledger.scan(docs, keep_text=True)
    found = scanned.columns[-1]
    text = secret_ledger.redact(F.col("text"), F.col(found))
    changed = F.size(found) > 0
    out = scanned.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight says. The exponent is the least that repeats no source more than REPEATS times, and the
    budget the least that uses every document, so none is lost."""
    (tokens,) = fresh(docs, "n_tokens")
    counted = docs.withColumn(tokens, packing.token_count("text"))
    totals = mixing.source_totals(counted, "source", tokens)
    plan = mixing.weights(totals, mixing.solve_exponent(totals, limit=REPEATS))
    return mixing.mix(counted, plan, "doc_id", "source", tokens).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of every document in sequences of five permitted lengths."""
    return packing.pack(docs.select("doc_id", packing.token_count("text").alias("n_tokens")), "doc_id", "n_tokens")


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each),
    ("secret scans", without_secrets),
    ("mixing sources to target weights", mixed),
    ("best-fit packing", packed),
]

#: Character models, sampled min-hashes and greedy packing are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}-{name.replace(' ', '-')}")
    return docs
