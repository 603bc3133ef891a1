"""The contract's queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from colstate.llm import (
    common,
    op1_token_counts,
    op2_line_dedup,
    op3_mixing,
    op4_quality,
    op5_bagminhash,
    op6_warc,
    op7_decontamination,
    op8_token_store,
    op9_suffix_dedup,
    op10_fingerprints,
    tokenizer,
)

TOKENIZER = "byte_bpe_50k.json"


def definition() -> str:
    return tokenizer.definition(public_tokenizers.path(TOKENIZER))


def op1_token_counts_(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return op1_token_counts.count_tokens(docs, definition(), common.work_dir(spark, "op1") + "/cache")


def op2_line_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_line_dedup.digests(op2_line_dedup.deduplicate(common.table(spark, sf_dir, "documents")))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mixture of three quarters of the corpus's tokens: the documents taken, a row for each epoch."""
    docs = common.table(spark, sf_dir, "documents")
    mixed = op3_mixing.mix(docs, op3_mixing.production_weights(), op3_mixing.DOMAINS, total=0.75)
    return mixed.select("doc_id", "lang", "source", "mix_epoch", op3_mixing.tokens_of().alias("n_tokens"))


def op4_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, its site's, and the decision; fitted on at most 6000 labelled documents."""
    docs = common.table(spark, sf_dir, "documents")
    judged = op4_quality.score(docs, op4_quality.fit(docs, common.table(spark, sf_dir, "labels")), with_text=False)
    return judged.select("doc_id", "source", "lang", "q_document", "q_site", "q_quality", "q_toxic", "q_keep")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_bagminhash.classes(common.table(spark, sf_dir, "documents")).drop("h", "g")


def op6_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_warc.written_pages(common.table(spark, sf_dir, "pages"), common.work_dir(spark, "op6") + "/warc")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_decontamination.decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op8_token_store_(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.work_dir(spark, "op8") + "/store"
    op8_token_store.write_store(common.table(spark, sf_dir, "documents"), definition(), root)
    return op8_token_store.read_store(spark, root)


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_suffix_dedup.digests(op9_suffix_dedup.deduplicate(common.table(spark, sf_dir, "documents")))


def op10_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_fingerprints.edited_likeness(common.table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts_,
    "op2_line_hashing": op2_line_hashing,
    "op3_mixture": op3_mixture,
    "op4_site_quality": op4_site_quality,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_warc_writer": op6_warc_writer,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_token_store": op8_token_store_,
    "op9_repeated_bytes": op9_repeated_bytes,
    "op10_lz_fingerprints": op10_lz_fingerprints,
}

#: SQL gives the kept digest of WARC payloads without archives, the units and windows without hashing.
ORACLES: dict[str, str] = {
    "op2_line_hashing": op2_line_dedup.ORACLE,
    "op6_warc_writer": op6_warc.ORACLE,
    "op7_benchmark_decontamination": op7_decontamination.ORACLE,
}
