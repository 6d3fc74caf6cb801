"""Corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, then the mix.

Every stage takes all documents its predecessor kept, calls one operator of the corpus
subpackage, and returns the documents that stay, with the columns of ``documents``; the last
returns the mix.  Stages are cut by Parquet tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pinfold.llm.decontamination import drop_leaking
from pinfold.llm.mixing import mix_sources
from pinfold.llm.near_copies import jaccard_near_dedup
from pinfold.llm.quality import select_quality
from pinfold.llm.secrets import scan_secrets
from pinfold.runtime import materialise, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the top grade is at least 0.7; null and empty texts are
    judged like any other, repeated rows alike."""
    return select_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarity 0.8 on five words links: the longest, as
    it holds most of what the others say; of equal lengths, the one with the smallest id.
    Rows without an id stay, repeated rows stay once."""
    groups = jaccard_near_dedup(docs).distinct()
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    best = F.max(F.struct("size", (-F.col("doc_id")).alias("back"))).getField("back")
    first = groups.join(sizes, "doc_id").groupBy("component_id").agg((-best).alias("doc_id")).select("doc_id")
    once = Window.partitionBy("doc_id").orderBy(F.xxhash64(*COLUMNS))
    kept = docs.select(*COLUMNS).join(first, "doc_id", "left_semi").withColumn("copy", F.row_number().over(once)).where("copy = 1")
    return kept.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item; null and empty texts leak none, an empty
    benchmark or an empty input changes nothing, repeated rows are judged alike."""
    return drop_leaking(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts redacted and ``n_chars`` counted anew there;
    null and empty texts stay, repeated rows are redacted alike."""
    scanned = scan_secrets(docs.select(*COLUMNS))
    return scanned.withColumn("n_chars", F.when(F.col("redacted").eqNullSafe(F.col("text")), F.col("n_chars")).otherwise(F.length("redacted").cast(docs.schema["n_chars"].dataType))).withColumn("text", F.col("redacted")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes: one row a row, repeated rows and rows
    of null or empty text included."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The first four stages train, link, tile and vote: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
