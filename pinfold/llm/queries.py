"""The queries of this subpackage and their SQL, added by the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pinfold.llm import mixing
from pinfold.llm.attention_lm import score_documents
from pinfold.llm.decontamination import leaked_items
from pinfold.llm.embedding_dedup import ORACLE as EMBEDDING_ORACLE
from pinfold.llm.embedding_dedup import embedding_near_dedup
from pinfold.llm.exact_dedup import ORACLE as EXACT_ORACLE
from pinfold.llm.exact_dedup import exact_dedup
from pinfold.llm.html_wrapper import extract_main_text
from pinfold.llm.merkle_manifest import ORACLE as MERKLE_ORACLE
from pinfold.llm.merkle_manifest import merkle_manifest
from pinfold.llm.prefix_trie import ORACLE as TRIE_ORACLE
from pinfold.llm.prefix_trie import prefix_trie
from pinfold.llm.quality import select_quality
from pinfold.llm.secrets import secret_findings
from pinfold.llm.simhash import simhash_near_dedup
from pinfold.llm.surrogates import pseudonymise
from pinfold.llm.tool_calls import link_tool_calls
from pinfold.runtime import table


#: For reruns of the test queries to agree; real corpora need a key that nobody knows.
TEST_KEY = "published, hides nothing"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an entity, rewritten; all others are what they were."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, key=TEST_KEY).where("n_entities > 0").select("doc_id", "n_entities", "text")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return select_quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "tail_probability")


def op6_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_dedup(table(spark, sf_dir, "embeddings"))


def op9_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(table(spark, sf_dir, "conversations"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_secret_scan": op2_secret_scan,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_html_main_text": op4_html_main_text,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_language_model_scores": op6_language_model_scores,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_mixing": op8_mixing,
    "op9_tool_call_linking": op9_tool_call_linking,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op8_mixing": mixing.ORACLE,
    "op10_embedding_near_dedup": EMBEDDING_ORACLE,
    "op11_exact_dedup": EXACT_ORACLE,
    "op12_prefix_trie": TRIE_ORACLE,
    "op13_merkle_manifest": MERKLE_ORACLE,
}
