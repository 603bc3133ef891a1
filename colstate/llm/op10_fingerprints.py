"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed from left to right into the phrases of an incremental dictionary: each phrase is
the longest one met so far plus one code point. The set of phrases is hashed, and a fingerprint is
the minimum hash in each of ``SLOTS`` classes of hashes, so that the share of equal slots estimates
the Jaccard likeness of two phrase sets: texts that would compress each other well are alike.

Defined cases: a null text counts as empty, has no phrase and an all-blank fingerprint; two empty
texts have likeness 1, an empty and another one 0. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colstate.llm import common

SLOTS = 128
_EMPTY = 0xFFFF
_MASK = 0xFFFFFFFFFFFFFFFF


class Parse:
    """The dictionary after some text. Entries: (node, code point) -> node; a node's hash is that of its phrase."""

    def __init__(self):
        self.next: dict[int, int] = {}
        self.phrases: list[int] = []  # for each new node: its parent and code point, as one key
        self.node = 0

    def feed(self, text: str) -> None:
        step, get, phrases = self.next, self.next.get, self.phrases
        node, size = self.node, len(self.phrases)
        for c in map(ord, text):
            key = node << 21 | c
            node = get(key, 0)
            if not node:
                size += 1
                step[key] = size
                phrases.append(key)
        self.node = node

    def back(self, size: int, node: int) -> None:
        """Forget all that came after the dictionary had ``size`` entries."""
        for key in self.phrases[size:]:
            del self.next[key]
        del self.phrases[size:]
        self.node = node


def phrase_hashes(keys: list[int], known: np.ndarray | None = None) -> np.ndarray:
    """Hash of each phrase, from its parent's hash and last code point, level by level."""
    start = 0 if known is None else len(known) - 1
    key = np.array(keys[start:], dtype=np.uint64)
    out = np.zeros(len(keys) + 1, np.uint64)
    if start:
        out[: start + 1] = known
    parent = (key >> np.uint64(21)).astype(np.int64)
    own = common.mix((key & np.uint64(0x1FFFFF)) + np.uint64(0x5851F42D4C957F2D))
    done = np.zeros(len(keys) + 1, bool)
    done[: start + 1] = True
    todo = np.arange(len(key))
    while len(todo):  # as many rounds as the longest phrase has code points
        ready = done[parent[todo]]
        now = todo[ready]
        out[start + 1 + now] = common.mix(out[parent[now]] * np.uint64(0x9E3779B97F4A7C15) + own[now])
        done[start + 1 + now] = True
        todo = todo[~ready]
    return out


def slots_of(hashes: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """For each class of hashes its least one, shortened to 16 bits; _EMPTY where there is none."""
    h = common.mix(hashes[1:] + np.uint64(1))
    least = np.full(slots, _MASK, np.uint64)
    np.minimum.at(least, (h % np.uint64(slots)).astype(np.int64), h)
    # shortening: high bits of another mix, since those of a minimum are small
    short = (common.mix(least ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(48)) % np.uint64(_EMPTY)
    return np.where(least == _MASK, _EMPTY, short).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that are filled in either; 1 if both are empty."""
    filled = (a != _EMPTY) | (b != _EMPTY)
    n = int(filled.sum())
    return float(((a == b) & filled).sum() / n) if n else 1.0


def as_string(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def fingerprint(text: str | None, slots: int = SLOTS) -> str:
    p = Parse()
    p.feed(text or "")
    return as_string(slots_of(phrase_hashes(p.phrases), slots))


def _with_edit(text: str, donor: str, slots: int) -> tuple[np.ndarray, np.ndarray, str]:
    """Slots of the text and of its edited text, whose common beginning is parsed once."""
    cut = len(text) - len(text) // 3
    head, edited = text[:cut], text[:cut] + donor[: len(text) // 3]
    p = Parse()
    p.feed(head)
    size, node = len(p.phrases), p.node
    shared = phrase_hashes(p.phrases)
    p.feed(text[cut:])
    own = slots_of(phrase_hashes(p.phrases, shared), slots)
    p.back(size, node)
    p.feed(edited[cut:])
    return own, slots_of(phrase_hashes(p.phrases, shared), slots), edited


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def edited_likeness(docs: DataFrame, *, slots: int = SLOTS, bytes_per_range: int = 16 << 20) -> DataFrame:
    """Fingerprints of ``docs (doc_id, text)`` and of their edited texts (see the contract's columns).

    The edit needs the next document in descending order of (doc_id, text), null ids last; after
    the last comes the first. Documents are dealt into ranges of about equal bytes; a
    range's first row needs the last row of the range before, so that row is sent to both. Ranges may end within
    an id. Texts of one row are the most that a task keeps besides an Arrow batch.
    """
    common.tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    rows = rows.withColumn("at", common.place(F.col("doc_id"), common.beginning(F.col("text"))))
    sizes = rows.agg(F.sum(F.octet_length("text") + 64).alias("b"), F.max("at").alias("top")).first()
    if sizes["top"] is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small inputs keep all cores busy
    ranges = common.ranges_of(rows.select("at", (F.octet_length("text") + 64).alias("nbytes")), min(bytes_per_range, -(-sizes["b"] // least)))
    placed = rows.select("doc_id", "text", "at", ranges.of(F.col("at")).alias("r"))
    is_top = (F.col("at.id") == sizes["top"]["id"]) & (F.col("at.tie") == sizes["top"]["tie"])
    # the end of a range goes to the next one too, that of the last to the first
    to = F.when(is_top, 0).when(F.col("r.last"), F.col("r.part") + 1)
    here = F.struct(F.col("r.part").alias("part"), F.lit(1).alias("own"))
    next_range = F.struct(to.alias("part"), F.lit(0).alias("own"))
    twice = placed.withColumn("to", F.explode(F.when(to.isNotNull(), F.array(here, next_range)).otherwise(F.array(here))))
    dealt = twice.select("to.part", "to.own", "doc_id", "text", "at").repartitionById(len(ranges), "part")
    # in a range: rows from before (own = 0) first, then ascending
    dealt = dealt.sortWithinPartitions("own", "at.id", "at.tie", "text").drop("at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # range, text and slots of the row before
        for b in batches:
            out: list[tuple] = []
            for p, own, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not own:
                    last = (p, text, None)
                    continue
                donor, near = last[1], last[2]
                if near is None:  # a row from another range: its slots aren't known here
                    q = Parse()
                    q.feed(donor)
                    near = slots_of(phrase_hashes(q.phrases), slots)
                mine, changed, edited = _with_edit(text, donor, slots)
                out.append((
                    doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), as_string(mine), as_string(changed),
                    likeness(mine, changed), likeness(mine, near),
                ))
                last = (p, text, mine)
            if out:
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return dealt.mapInArrow(run, SCHEMA)

