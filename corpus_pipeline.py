"""From raw documents to token files: quality, near-duplicates, benchmark passages, mixture, ids.

Each stage works on all that the stage before has kept, which is written as Parquet to the shared
folder and read again. All but the last return the columns of ``documents``; the last one writes the
token store and returns what its files hold.

Defined cases, of each stage: null and empty texts, null languages and sources and further columns are allowed for, and columns that
stay do so unchanged, whatever their names; an empty table gives an empty one. A text without words has its site's quality; of
texts that are equal (null and empty ones too) one row stays, that with the least doc_id, of rows equal in both any one; a null
doc_id ranks last. Rows of equal ids are judged one by one. A document may come twice out of the mixture, and is then in
the token files twice. ``labels`` and ``benchmark`` may be empty: then nothing is known against any document.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colstate.llm import (
    common,
    op3_mixing,
    op4_quality,
    op5_bagminhash,
    op7_decontamination,
    op8_token_store,
    queries,
)


_ADDED = re.compile("(q|mix)_.*")


def _aside(docs: DataFrame) -> DataFrame:
    """Columns named like those that an operator adds, under other names for the time of a stage."""
    return docs.withColumnsRenamed({c: f"own{i}_{c}" for i, c in enumerate(docs.columns) if _ADDED.fullmatch(c)})


def _back(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns that came into the stage, under their names."""
    return docs.select(*[F.col(f"`own{i}_{c}`" if _ADDED.fullmatch(c) else f"`{c}`").alias(c) for i, c in enumerate(columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, together with its sites, takes for good prose that isn't toxic."""
    model, own = op4_quality.fit(docs, common.table(spark, sf_dir, "labels")), docs.columns
    return _back(op4_quality.score(_aside(docs), model).where("q_keep"), own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id."""
    return op5_bagminhash.without_copies(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return op7_decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens that are left, dealt by the production weights, each document at most twice.

    Tokens are parted by white space here.
    """
    mixed = op3_mixing.mix(_aside(docs), op3_mixing.production_weights(), op3_mixing.DOMAINS, total=0.9, epochs=2)
    return _back(mixed, docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store, read back."""
    root = common.work_dir(spark, "pipeline-tokens") + "/store"
    op8_token_store.write_store(docs, queries.definition(), root)
    return op8_token_store.read_store(spark, root)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("mixture", mixture),
    ("token_ids", token_ids),
]

#: A fitted classifier, signatures and a tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    work = common.work_dir(spark, "pipeline")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"{work}/{name}")
    return docs
