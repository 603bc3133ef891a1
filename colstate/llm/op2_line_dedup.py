"""Substring deduplication by hashing lines or paragraphs.

A text is split into units at a separator. Units are normalised (lower case, white space runs as one
blank, ends stripped), their 128-bit digests grouped over the whole corpus, and of equal units only
the earliest stays: documents rank by ``rank`` (nulls last), then by text digest, units by position.
Blank units are never removed. The kept units joined by the separator are the new text; where they
stood in the original text is returned with it.

No texts are moved for the grouping, just digests and positions, merged task by task first; a unit that
a third of the corpus shares costs a row a task there. The units that come more than once are written
before they are joined back to their occurrences: adaptive execution splits hot partitions of a
join only if no aggregate by its key is in the same stage.

Defined cases: a null text counts as empty and stays so; rows equal in rank and text are one document
and get equal results; equal ranks are told apart by the text's digest.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colstate.llm import common

LINES, PARAGRAPHS = "\n", "\n\n"
#: Fixed value: the characters that count as white space here, the same in SQL.
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")
_RESULT = "doc_id bigint, n_units bigint, n_removed bigint, removed_spans string, kept_offsets array<struct<start:int,end:int>>, kept_text string"


def normalise(unit: str) -> str:
    # the two letters whose lower case in Python is by context or two letters; in SQL each letter has one of its own
    unit = unit.replace("Σ", "σ").replace("İ", "i")
    return _BLANKS.sub(" ", unit.lower()).strip(" ")


def _units(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, ranks, hs, d1, d2, at = [], [], [], [], [], []
            for doc_id, rank, h, text in zip(*(c.to_pylist() for c in b.columns)):
                for k, unit in enumerate(text.split(separator)):
                    if plain := normalise(unit):
                        d = hashlib.blake2b(plain.encode(), digest_size=16).digest()
                        d1.append(int.from_bytes(d[:8], "little", signed=True))
                        d2.append(int.from_bytes(d[8:], "little", signed=True))
                        ids.append(doc_id), ranks.append(rank), hs.append(h), at.append(k)
            columns = [pa.array(x, pa.int64()) for x in (ids, ranks, hs, d1, d2)] + [pa.array(at, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rank", "h", "d1", "d2", "at"])

    return run


def _clean(separator: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, gone in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "gone"))):
                gone, at, kept, offsets, spans = set(gone or ()), 0, [], [], []
                units = text.split(separator)
                for k, unit in enumerate(units):
                    span = {"start": at, "end": at + len(unit)}
                    at += len(unit) + len(separator)
                    if k in gone:
                        spans.append(f"{span['start']}-{span['end']}")
                    else:
                        kept.append(unit)
                        offsets.append(span)
                out.append((doc_id, len(units), len(gone), ",".join(spans), offsets, separator.join(kept)))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
            names = ["doc_id", "n_units", "n_removed", "removed_spans", "kept_offsets", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def deduplicate(docs: DataFrame, *, separator: str = LINES, rank_col: str = "doc_id") -> DataFrame:
    """Per row of ``docs (doc_id, text)``: units, removed ones and their character spans, kept offsets and text."""
    common.tune(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(rank_col).cast("long").alias("rank"), common.text_of().alias("text")
    ).withColumn("h", F.xxhash64("text"))
    light = rows.select("doc_id", "rank", "h", "text")
    spots = light.mapInArrow(_units(separator), "doc_id bigint, rank bigint, h bigint, d1 bigint, d2 bigint, at int")
    spots = common.written(spots, common.work_dir(docs.sparkSession, "op2") + "/units")
    # where a unit stands, in the order of ranks
    place = F.struct(F.col("rank").isNull().alias("last"), "rank", "h", "doc_id", "at")
    firsts = spots.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = common.written(firsts.drop("n"), common.work_dir(docs.sparkSession, "op2") + "/firsts")
    gone = spots.join(firsts, ["d1", "d2"]).where(~place.eqNullSafe(F.col("first")))
    # a document's removed units are bounded by its own length
    gone = gone.groupBy("doc_id", "rank", "h").agg(F.collect_set("at").alias("gone"))
    a, b = rows.alias("a"), gone.alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in ("doc_id", "rank", "h")]
    joined = a.join(b, on, "left").select("a.doc_id", "a.text", "b.gone")
    return joined.mapInArrow(_clean(separator), _RESULT)


def digests(cleaned: DataFrame) -> DataFrame:
    """The query's columns: counts, spans and the digest of the kept text."""
    return cleaned.select("doc_id", "n_units", "n_removed", "removed_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB SQL for digests() over ``documents`` by lines.
ORACLE = r"""
WITH u AS (
  SELECT doc_id, unit, k, length(unit) AS n, regexp_replace(regexp_replace(lower(unit), '[ \t\n\r\f\v]+', ' ', 'g'), '^ | $', '', 'g') AS plain
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents)
), r AS (
  SELECT *, plain <> '' AND row_number() OVER (PARTITION BY plain ORDER BY doc_id, k) > 1 AS gone,
    sum(n + 1) OVER (PARTITION BY doc_id ORDER BY k) - n - 1 AS s
  FROM u
)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
  coalesce(string_agg(CAST(CAST(s AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(s + n AS BIGINT) AS VARCHAR), ',' ORDER BY k) FILTER (gone), '') AS removed_spans,
  sha256(coalesce(string_agg(unit, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""
