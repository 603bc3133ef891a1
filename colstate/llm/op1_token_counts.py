"""Token counts through a digest cache.

The cache is a table ``(version, digest, n_tokens)`` in a folder: ``version`` digests the tokenizer
definition and library version, ``digest`` the normalised content. A run joins the digests of its
documents to the stored counts, encodes each distinct missing content once, appends those counts
to the cache and joins all documents to it.

Defined cases: a null text counts as the empty text, 0 tokens; null and repeated ids are kept row by
row; equal contents are encoded once whatever their number (they are merged before the shuffle,
task by task), and the rows that share one are dealt over several tasks when they are joined to its count; other columns of the input are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colstate.llm import common, tokenizer

CACHE_SCHEMA = "version string, digest binary, n_tokens bigint"


def stored(spark, cache: str, version: str) -> DataFrame | None:
    """The counts that a cache holds for a version; None before its first write."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return None
    rows = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    # two runs at a time may both append a digest: their counts are equal
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def fill(contents: DataFrame, cache: str, definition: str) -> str:
    """Encode those of ``contents (digest, content)`` that the cache lacks, and append their counts."""
    spark = contents.sparkSession
    version = tokenizer.version(definition)
    known = stored(spark, cache, version)
    if known is not None:
        contents = contents.join(known.select("digest"), "digest", "left_anti")
    shared = spark.sparkContext.broadcast(definition)  # one vocabulary, a few MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokenizer.encoder(version, shared.value)
        for b in batches:
            counts = list(map(len, enc.batch(b.column("content").to_pylist())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(counts)), b.column("digest").cast(pa.binary()), pa.array(counts, pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    once = contents.groupBy("digest").agg(F.first("content").alias("content"))
    once.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache)
    return version


def counts_of(docs: DataFrame, definition: str, cache: str, *, text_col: str = "text") -> DataFrame:
    """``digest, n_tokens`` of all contents of ``docs``, those that the cache lacks encoded and appended to it. A digest is the SHA-256."""
    common.tune(docs.sparkSession)
    content = common.text_of(text_col)
    version = fill(docs.select(F.unhex(F.sha2(content, 256)).alias("digest"), content.alias("content")), cache, definition)
    # written, so that the stage of a join with it has no aggregate of its own and a digest of very many rows is split there
    return common.written(stored(docs.sparkSession, cache, version), common.work_dir(docs.sparkSession, "op1") + "/counts")


def count_tokens(
    docs: DataFrame,
    definition: str,
    cache: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    normalise: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Per row: ``id_col, n_bytes, n_tokens, over_limit``. ``normalise`` maps the content that is counted
    (by default the whole text, null as empty, otherwise unchanged, since any other change may change counts)."""
    content = common.text_of(text_col)
    content = normalise(content) if normalise else content
    rows = docs.select(F.col(id_col), content.alias("content"))
    counts = counts_of(rows, definition, cache, text_col="content")
    keyed = rows.select(id_col, F.octet_length("content").cast("long").alias("n_bytes"), F.unhex(F.sha2("content", 256)).alias("digest"))
    return keyed.join(counts, "digest").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
