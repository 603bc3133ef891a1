"""Content-addressed store of token ids.

Layout under the store's root (a folder that all machines share):

* ``packs/pack-<shard>.bin``   unique chunks, one after the other: ids as little-endian unsigned
  integers of 2 bytes (vocabularies up to 65,536) or 4;
* ``recipes/recipe-<shard>.bin``  per document its id and the places and digests of its chunks;
* ``MANIFEST.json``  the shards in ascending order of doc_id with their first positions, Merkle
  roots and the root over these. It is written last: a store without it doesn't exist.

A rolling hash over ``WINDOW`` ids cuts each document's id stream, so that equal passages give equal
chunks wherever they stand. A chunk is stored once, in the shard of its first occurrence in the
order of doc_id; other shards refer to it there.

How it is made: documents are dealt into ranges of ids; a task encodes a range, writes a spool of
the chunks that are new within it and returns their digests. Digests are grouped over all shards,
with one row a shard and digest, so common chunks stay cheap; then each spool is settled into a
pack without the chunks that an earlier shard owns, and the recipes are written. All files are
written under temporary names and renamed, tasks can be run again at any step.

Defined cases: a null text is empty and has just the end id; rows with null ids come first; rows with
equal ids are ordered by text, and ranges may end within them. A range of more bytes rolls over
to further shards, so a task's memory has a bound of a shard and a document, whatever a range's size.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colstate.llm import common, tokenizer

WINDOW, LONGEST = 8, 4096
_ROLL = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)]


def cuts(ids: np.ndarray, mean: int = 256) -> list[int]:
    """Ends of the chunks of an id stream: where the hash of the last WINDOW ids ends in zeros, the
    stream's end, and every LONGEST ids within longer stretches."""
    return cuts_of_all([ids], mean)[0]


def cuts_of_all(streams: list[np.ndarray], mean: int = 256) -> list[list[int]]:
    """``cuts`` of each stream. They are hashed as one, with zeros between them that no window reaches across."""
    size = np.fromiter(map(len, streams), np.int64, len(streams))
    start = np.cumsum(size + WINDOW - 1) - size
    pad = np.zeros(WINDOW - 1, np.uint32)
    g = np.concatenate([x for ids in streams for x in (pad, ids)] or [pad])
    g = common.mix(g.astype(np.uint64) + np.uint64(1))
    g[(np.append(0, start + size)[:-1, None] + np.arange(WINDOW - 1)).ravel()] = 0
    h = np.zeros(len(g), np.uint64)
    for k, factor in enumerate(_ROLL):
        h[k:] += g[: len(g) - k] * np.uint64(factor)
    found = np.nonzero((h >> np.uint64(40)) & np.uint64(mean - 1) == 0)[0]
    first, last = np.searchsorted(found, start).tolist(), np.searchsorted(found, start + size).tolist()
    return [_ends((found[a:b] - s + 1).tolist(), n) for a, b, s, n in zip(first, last, start.tolist(), size.tolist())]


def _ends(found: list[int], n: int) -> list[int]:
    """The ends within a stream of ``n`` ids: those found, its own, and more where they are too far apart."""
    if not n:
        return []
    if not found or found[-1] != n:
        found.append(n)
    out, last = [], 0
    for e in found:
        while e - last > LONGEST:
            last += LONGEST
            out.append(last)
        out.append(e)
        last = e
    return out


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd last node goes up as it is."""
    if not leaves:
        return digest(b"")
    while len(leaves) > 1:
        up = [digest(b"\x01" + a + b) for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = up + leaves[len(leaves) // 2 * 2 :]
    return leaves[0]


# a shard's spool and recipe files ---------------------------------------------------------------

_SPOOL_CHUNK = np.dtype([("digest", "S16"), ("offset", "<i8"), ("length", "<i4")])
_PLACE = np.dtype([("digest", "S16"), ("pack", "<i8"), ("offset", "<i8"), ("length", "<i4")])
_DOC = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("chunks", "<i4"), ("tokens", "<i8")])


def _frame(head: dict, *arrays: np.ndarray) -> bytes:
    text = json.dumps(head | {"counts": [len(a) for a in arrays]}, sort_keys=True).encode()
    return b"".join([len(text).to_bytes(4, "little"), text, *(a.tobytes() for a in arrays)])


def _unframe(data: bytes, *kinds) -> tuple[dict, list[np.ndarray]]:
    n = int.from_bytes(data[:4], "little")
    head, at, out = json.loads(data[4 : 4 + n]), 4 + n, []
    for kind, count in zip(kinds, head["counts"]):
        out.append(np.frombuffer(data, kind, count, at))
        at += np.dtype(kind).itemsize * count
    return head, out


class _Spool:
    """Collects a shard: its new chunks' bytes, their places, and the documents as chunk numbers."""

    def __init__(self, root: str, shard: int):
        self.root, self.shard = root, shard
        self.number: dict[bytes, int] = {}
        self.parts: list[bytes] = []
        self.size = 0
        self.places: list[tuple[bytes, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.sequence: list[int] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray, width: int, ends: list[int]) -> None:
        data, last = ids.astype(f"<u{width}").tobytes(), 0
        for end in ends:
            chunk = data[last * width : end * width]
            last = end
            d = digest(chunk)
            k = self.number.get(d)
            if k is None:
                k = self.number[d] = len(self.places)
                self.places.append((d, self.size, len(chunk)))
                self.parts.append(chunk)
                self.size += len(chunk)
            self.sequence.append(k)
        self.docs.append((doc_id or 0, doc_id is None, len(ends), len(ids)))
        self.tokens += len(ids)

    def close(self) -> pa.RecordBatch:
        """Write the spool; rows: each distinct digest, and one with a null digest and the totals."""
        common.commit_bytes(f"{self.root}/spool/{self.shard}.pack", *self.parts)
        arrays = np.array(self.places, _SPOOL_CHUNK), np.array(self.docs, _DOC), np.array(self.sequence, "<i4")
        common.commit_bytes(f"{self.root}/spool/{self.shard}.rec", _frame({"shard": self.shard}, *arrays))
        n = len(self.places)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.shard] * (n + 1), pa.int64()),
                pa.array([p[0] for p in self.places] + [None], pa.binary()),
                pa.array([0] * n + [len(self.docs)], pa.int64()),
                pa.array([0] * n + [self.tokens], pa.int64()),
            ],
            names=["shard", "digest", "docs", "tokens"],
        )


def _own(root: str, shard: int, foreign: set[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A spool's places, documents, sequence, and its chunks' offsets in the pack (-1: another shard's)."""
    _, (places, docs, sequence) = _unframe(common.read_bytes(f"{root}/spool/{shard}.rec"), _SPOOL_CHUNK, _DOC, "<i4")
    mine = np.array([_raw(d) not in foreign for d in places["digest"]], bool)
    lengths = np.where(mine, places["length"], 0).astype(np.int64)
    offsets = np.where(mine, np.cumsum(lengths) - lengths, -1)
    return places, docs, sequence, offsets


def _raw(d: bytes) -> bytes:
    """numpy drops trailing zero bytes of fixed strings."""
    return bytes(d).ljust(16, b"\0")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """The rows of each shard; a shard has at most a row for each of its chunks."""
    shard, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["shard"] != shard:
                if rows:
                    yield shard, rows
                shard, rows = r["shard"], []
            rows.append(r)
    if rows:
        yield shard, rows


# writing --------------------------------------------------------------------------------------


def write_store(
    docs: DataFrame,
    definition: str,
    root: str,
    *,
    end_id: int = 0,
    shard_bytes: int = 16 << 20,
    range_bytes: int = 16 << 20,
    mean_chunk: int = 256,
) -> dict:
    """Encode ``docs (doc_id, text)`` into a new store at ``root``; the manifest. A task takes a range of ``range_bytes`` of text."""
    spark = docs.sparkSession
    common.tune(spark)
    version = tokenizer.version(definition)
    shared = spark.sparkContext.broadcast(definition)  # one vocabulary, a few MB
    width = 2 if max(max(json.loads(definition)["model"]["vocab"].values()), end_id) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    at = common.place(F.col("doc_id"), common.beginning(F.col("text"))).alias("at")
    ranges = common.ranges_of(rows.select(at, (F.octet_length("text") + 16).alias("nbytes")), range_bytes)
    dealt = rows.select("doc_id", "text", at).withColumn("part", ranges.of(F.col("at"))["part"])
    dealt = dealt.repartitionById(len(ranges), "part").sortWithinPartitions("at.id", "at.tie", "text").drop("at")

    def spool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, open_ = tokenizer.encoder(version, shared.value), None, None
        for b in batches:
            doc_ids, texts, parts = (b.column(c).to_pylist() for c in ("doc_id", "text", "part"))
            streams = [np.append(ids, np.uint32(end_id)) for ids in enc.batch(texts)]
            for doc_id, ids, ends, p in zip(doc_ids, streams, cuts_of_all(streams, mean_chunk), parts):
                if p != part or open_.size >= 2 * shard_bytes or len(open_.docs) >= 1 << 18:
                    if open_ is not None:
                        yield open_.close()
                    # shards in the order of ranges; the low bits count the rolls within one
                    open_ = _Spool(root, open_.shard + 1 if p == part else (p + 1) << 20)
                    part = p
                open_.add(doc_id, ids, width, ends)
        if open_ is not None:
            yield open_.close()

    found = common.written(
        dealt.mapInArrow(spool, "shard bigint, digest binary, docs bigint, tokens bigint"), f"{root}/work/found"
    )
    totals = found.where("digest is null").orderBy("shard").collect()  # a row a shard
    starts, at = {}, 0
    for r in totals:
        starts[r["shard"]] = at
        at += r["tokens"]

    chunks = found.where("digest is not null").select("shard", "digest")
    owners = chunks.groupBy("digest").agg(F.min("shard").alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refs = common.written(chunks.join(owners.select("digest", "owner"), "digest"), f"{root}/work/refs")
    no_ref = found.where("digest is null").select("shard", F.lit(None).cast("binary").alias("digest"))
    todo = refs.unionByName(no_ref.withColumn("owner", F.lit(None).cast("bigint")))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rs in _by_shard(batches):
            foreign = {r["digest"] for r in rs if r["digest"] is not None and r["owner"] != shard}
            owned = {r["digest"] for r in rs if r["owner"] == shard}
            places, _, _, offsets = _own(root, shard, foreign)
            data = common.read_bytes(f"{root}/spool/{shard}.pack")
            mine = np.nonzero(offsets >= 0)[0]
            spans = [data[o : o + n] for o, n in zip(places["offset"][mine].tolist(), places["length"][mine].tolist())]
            common.commit_bytes(f"{root}/packs/pack-{shard}.bin", *spans)
            out = [
                (d, shard, int(offsets[i]), int(places["length"][i]))
                for i in mine
                if (d := _raw(places["digest"][i])) in owned
            ]
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32()]
            columns = [pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "owner", "offset", "length"])

    n = max(1, len(totals))
    each = lambda df: df.repartition(n, "shard").sortWithinPartitions("shard")
    owned = common.written(
        each(todo).mapInArrow(settle, "digest binary, owner bigint, offset bigint, length int"), f"{root}/work/owned"
    )
    elsewhere = refs.where("owner <> shard").select("shard", "digest").join(owned, "digest")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("owner", "bigint"), ("offset", "bigint"), ("length", "int"))]
    todo = elsewhere.unionByName(no_ref.select("shard", "digest", *nothing))

    def recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rs in _by_shard(batches):
            there = {r["digest"]: (r["owner"], r["offset"]) for r in rs if r["digest"] is not None}
            places, docs_, sequence, offsets = _own(root, shard, set(there))
            at = np.empty(len(places), _PLACE)
            at["digest"], at["length"], at["pack"], at["offset"] = places["digest"], places["length"], shard, offsets
            for i in np.nonzero(offsets < 0)[0]:
                at["pack"][i], at["offset"][i] = there[_raw(places["digest"][i])]
            leaves = [_raw(d) for d in places["digest"]]
            used, roots = 0, []
            order = sequence.tolist()
            for k in docs_["chunks"].tolist():
                roots.append(merkle([leaves[i] for i in order[used : used + k]]))
                used += k
            top = merkle(roots).hex()
            data = _frame({"shard": shard, "start": starts[shard], "width": width, "merkle": top}, at, docs_, sequence)
            common.commit_bytes(f"{root}/recipes/recipe-{shard}.bin", data)
            row = [shard, starts[shard], len(docs_), int(docs_["tokens"].sum()), top, hashlib.sha256(data).hexdigest()]
            names = ["shard", "start", "docs", "tokens", "merkle", "recipe_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=names)

    kind = "shard bigint, start bigint, docs bigint, tokens bigint, merkle string, recipe_sha256 string"
    shards = [r.asDict() for r in each(todo).mapInArrow(recipes, kind).collect()]  # a row a shard
    shards.sort(key=lambda r: r["shard"])
    root_hash = merkle([bytes.fromhex(r["merkle"]) for r in shards]).hex()
    manifest = {"tokenizer": version, "end_id": end_id, "width": width, "root": root_hash, "shards": shards}
    common.commit_bytes(f"{root}/MANIFEST.json", json.dumps(manifest, indent=1).encode())
    for d in ("spool", "work"):
        common._quiet(f"{root}/{d}")
    return manifest


# reading --------------------------------------------------------------------------------------

READ_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


class _Packs:
    """Chunks by place; the shard's own pack in memory, others by ranges."""

    def __init__(self, root: str, shard: int):
        self.root, self.shard, self.own, self.open = root, shard, common.read_bytes(f"{root}/packs/pack-{shard}.bin"), {}

    def get(self, pack: int, offset: int, length: int) -> bytes:
        if pack == self.shard:
            return self.own[offset : offset + length]
        if pack not in self.open:
            if len(self.open) >= 64:
                self.open.pop(next(iter(self.open))).close()
            fs, path = common.filesystem(f"{self.root}/packs/pack-{pack}.bin")
            self.open[pack] = fs.open_input_file(path)
        return self.open[pack].read_at(length, offset)


def documents_of(root: str, entry: dict) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """Each document of a shard: id, first position, ids; everything is checked against its digest."""
    data = common.read_bytes(f"{root}/recipes/recipe-{entry['shard']}.bin")
    if hashlib.sha256(data).hexdigest() != entry["recipe_sha256"]:
        raise ValueError(f"recipe of shard {entry['shard']} is damaged")
    head, (places, docs, sequence) = _unframe(data, _PLACE, _DOC, "<i4")
    packs, at, used, roots = _Packs(root, entry["shard"]), head["start"], 0, []
    where = list(zip(places["pack"].tolist(), places["offset"].tolist(), places["length"].tolist()))
    digests, order = [_raw(d) for d in places["digest"]], sequence.tolist()
    for doc_id, null, k, tokens in docs.tolist():
        chunks = []
        for i in order[used : used + k]:
            chunks.append(packs.get(*where[i]))
            if digest(chunks[-1]) != digests[i]:
                raise ValueError(f"a chunk of shard {entry['shard']} is damaged")
        roots.append(merkle([digests[i] for i in order[used : used + k]]))
        used += k
        ids = np.frombuffer(b"".join(chunks), f"<u{head['width']}").astype("<u4")
        if len(ids) != tokens:
            raise ValueError(f"shard {entry['shard']}: {tokens} ids expected, {len(ids)} found")
        yield (None if null else doc_id), at, ids
        at += tokens
    if merkle(roots).hex() != entry["merkle"]:
        raise ValueError(f"shard {entry['shard']}: Merkle root differs")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Per document of the store: doc_id, start, n_tokens, ids_crc32, from the files."""
    manifest = json.loads(common.read_bytes(f"{root}/MANIFEST.json"))
    shards = manifest["shards"]
    if merkle([bytes.fromhex(r["merkle"]) for r in shards]).hex() != manifest["root"]:
        raise ValueError("the manifest's Merkle root differs")
    if not shards:
        return spark.createDataFrame([], READ_SCHEMA)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for entry in b.to_pylist():
                rows = [(i, at, len(ids), zlib.crc32(ids.tobytes())) for i, at, ids in documents_of(root, entry)]
                names = [c.split()[0] for c in READ_SCHEMA.split(", ")]
                columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = "shard bigint, start bigint, merkle string, recipe_sha256 string"
    entries = [(r["shard"], r["start"], r["merkle"], r["recipe_sha256"]) for r in shards]
    todo = spark.createDataFrame(entries, kind).repartition(len(entries))
    return todo.mapInArrow(read, READ_SCHEMA)
