"""The corpus pipeline over `documents`: language ID, near-dedup, decontamination, secret redaction and mixing.

Each stage takes and returns the columns of the documents it gets, extra ones included; the last adds the mix's
columns. What stages decide:

* language: documents that are `und`, or that share nothing with any language learned, go;
* near_dedup: of each group of near-duplicates (5-word shingles, similarity 0.8) the document with the least id stays;
  of rows that share an id, one; documents without an id pass untouched;
* decontaminate: documents that hold a benchmark item go;
* redact: secrets in texts are replaced by a mark, and n_chars is renewed;
* mix: documents are repeated or left out by their source's target.

Null and empty texts are `und` and go at the first stage. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontam, langid, minhash, mixing, secrets
from tidemark.llm._store import Tables

#: Ids of duplicates that are broadcast to leave them out; beyond, the join is shuffled.
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs)
    even = 1 / len(model.languages) if model and len(model.languages) > 1 else 0.0
    found = langid.identify(docs.withColumn("_doc", F.struct(*docs.columns)).select("_doc", "text"), model)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") > even + 0.005)).select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = minhash.near_duplicates(docs, k=5, percent=80)
    tables = Tables(spark, "near-dedup")
    gone = tables.put("gone", classes.filter(F.col("doc_id").isNotNull() & ~F.col("kept")).select("doc_id").distinct())
    out = docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = tables.put("repeated", docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    n = repeated.count()
    if not n:
        return out
    some = F.broadcast(repeated) if n <= BROADCAST_IDS else repeated
    first = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), F.to_json(F.struct(*docs.columns)))
    one = out.join(some, "doc_id", "left_semi").withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*docs.columns)
    return out.join(some, "doc_id", "left_anti").select(*docs.columns).unionByName(one)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.find_leaks(docs.withColumn("_doc", F.struct(*docs.columns)).select("_doc", "text"), benchmark)
    return found.filter(F.size("leaks") == 0).select("_doc.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_copies(mixing.mix(docs))


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("mix", mix)]

#: The first three stages can't be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over `documents`; each one's rows are written and read again before the next."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = tables.put(name, docs)
    return docs
