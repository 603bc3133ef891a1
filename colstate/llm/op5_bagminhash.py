"""Near-duplicate documents by BagMinHash signatures.

A document is the multiset of its five-word shingles. Each shingle's weights 0, 1, 2, ... are cut into
levels [0,1), [1,2), [2,4), [4,8) ...; a level has a Poisson process whose points have a time, one of
``SLOTS`` slots and a weight within the level, and a point counts if that weight is below the
shingle's. A slot's value is the first point in it over all shingles, so two documents agree in a slot
with exactly the probability of their weighted Jaccard likeness. Points are made in the order
of time, only up to the time by which all slots are filled: about SLOTS * log(SLOTS) of them a document,
whatever its length, besides one for each shingle.

Signatures are cut into ``BANDS`` bands of ``ROWS`` slots; documents that share a band are candidates.
At likeness 0.8 a pair shares none with a probability of 6e-5. Candidates are verified on the
shingle multisets themselves, links are those of likeness ``least`` or more, classes the connected components.

Equal texts are one node from the start. Within a shared band's bucket not all pairs are made: every
member is compared with the ``HUBS`` members that share most bands with others; a bucket of up to HUBS + 1
is complete by that. In larger ones the members outside the first hub's component are a query set
against all members of the bucket, in blocks of bounded bytes: a task gets the shingles of one block
of each, counts what they share, and returns links between different components only. Pairs within a
component need no comparison: they can't change a class. No bucket is cut off.

Texts are told apart by 128 bits of hash, nodes are numbered by the first 64 of them; the few texts that agree in these
and differ in the others are looked for, and get numbers made of all 128. Shingles are compared by 64-bit hashes.

Defined cases: null and empty texts are equal texts and one class; a text of fewer than five words has one
shingle of all of them; texts without words aren't candidates; a class's id is its least doc_id (null
only if all are), its keeper the row with that id, of equal ids the one with the least text hash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colstate.llm import common

WORDS, BANDS, ROWS, HUBS = 5, 32, 6, 8
SLOTS = BANDS * ROWS
_WORD = re.compile(r"\w+")
_WORD_HASH: dict[str, int] = {}
_POW = [np.uint64(pow(0xD6E8FEB86659FD93, k, 1 << 64)) for k in range(WORDS)]


def word_hashes(text: str) -> list[int]:
    """64-bit hashes of the lower-cased words, through a memo of the worker's."""
    words = _WORD.findall(text.lower())
    try:
        return [_WORD_HASH[w] for w in words]
    except KeyError:
        if len(_WORD_HASH) > 150_000:
            _WORD_HASH.clear()
        for w in words:
            if w not in _WORD_HASH:
                _WORD_HASH[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return [_WORD_HASH[w] for w in words]


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: the text's number and the hash of each shingle, in order."""
    docs, out = [], []
    for i, t in enumerate(texts):
        w = np.array(word_hashes(t), np.uint64)
        if not len(w):
            continue
        k = min(WORDS, len(w))
        h = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            h += w[j : len(w) - k + 1 + j] * _POW[j]
        out.append(common.mix(h + np.uint64(k)))
        docs.append(np.full(len(h), i))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(out)


def multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: number, distinct shingle hash, times; sorted by number and hash."""
    doc, h = shingles(texts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.nonzero(first)[0]
    return doc[at], h[at], np.diff(np.append(at, len(h)))


def signatures(n_docs: int, doc: np.ndarray, h: np.ndarray, times: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash signatures (n_docs x slots, 64-bit); rows of documents without shingles are 0."""
    total = np.bincount(doc, weights=times, minlength=n_docs)
    # a row for each shingle and level: level 0 is [0, 1), level k is [2^(k-1), 2^k)
    parts = [(doc, h, times, np.zeros(len(doc), np.int64))]
    level = 1
    while (more := times > (1 << (level - 1))).any():
        parts.append((doc[more], h[more], times[more], np.full(int(more.sum()), level)))
        level += 1
    d, s, w, lev = (np.concatenate(x) for x in zip(*parts))
    low = np.where(lev == 0, 0, 1 << np.maximum(lev - 1, 0))
    width = np.where(lev == 0, 1, low)
    seed = common.mix(s ^ common.mix(lev.astype(np.uint64) + np.uint64(17)))
    least = np.full((n_docs, slots), np.inf)
    until = np.where(total > 0, 2 * np.log(slots) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        live = todo[d]
        dd, ss, ww, lo, wi = d[live], seed[live], w[live], low[live], width[live]
        at, k = np.zeros(len(dd)), 0
        while len(dd):
            a = common.salted(ss, 2 * k + 1)
            at = at - np.log1p(-(a >> np.uint64(11)).astype(float) * 2.0**-53) / (slots * wi)
            stay = at <= until[dd]
            dd, ss, ww, lo, wi, at = dd[stay], ss[stay], ww[stay], lo[stay], wi[stay], at[stay]
            b = common.salted(ss, 2 * k + 2)
            slot = (b % np.uint64(slots)).astype(np.int64)
            weight = lo + ((b >> np.uint64(24)) % wi.astype(np.uint64)).astype(np.int64)
            ok = weight < ww
            np.minimum.at(least.reshape(-1), dd[ok] * slots + slot[ok], at[ok])
            k += 1
        todo = todo & np.isinf(least).any(1)
        until[todo] *= 4
        least[todo] = np.inf
    least[total == 0] = 0
    return common.mix(least.view(np.uint64))


def bands_of(sig: np.ndarray) -> np.ndarray:
    """One key for each band, different from band to band."""
    x = sig.reshape(len(sig), BANDS, ROWS)
    key = np.zeros(x.shape[:2], np.uint64) + common.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(3))
    for r in range(ROWS):
        key = common.mix(key ^ x[:, :, r])
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc, h, times = multisets(b.column("text").to_pylist())
        n = len(b)
        size = np.bincount(doc, weights=times, minlength=n).astype(np.int64)
        sig = signatures(n, doc, h, times)
        columns = [b.column("doc_id"), b.column("h"), b.column("g"), pa.array(size), pa.array(list(bands_of(sig)), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "g", "n", "bands"])


_SKETCH_KIND = "doc_id bigint, h bigint, g bigint, n bigint, bands array<bigint>"


def hashes(text: Column, first: Column | None = None) -> dict[str, Column]:
    """The two halves of what a text is known by."""
    return {"h": F.xxhash64(text) if first is None else first, "g": F.xxhash64(F.lit(1), text)}


def numbered(df: DataFrame, alike: list[int]) -> DataFrame:
    """``h`` as the number of a node: for texts that agree in it by chance (``alike``) one that is made of both halves."""
    return df.withColumn("h", F.when(F.col("h").isin(alike), F.xxhash64("h", "g")).otherwise(F.col("h"))) if alike else df


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's multiset as a sorted set: the j-th time of a shingle is an element of its own."""
    for b in batches:
        doc, h, times = multisets(b.column("text").to_pylist())
        at = np.repeat(np.arange(len(h)), times)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
        e, d = np.where(nth == 0, h[at], common.mix(h[at] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), doc[at]
        cut = np.searchsorted(d, np.arange(len(b) + 1))
        sets = [np.sort(e[i:j]).tobytes() for i, j in zip(cut, cut[1:])]
        yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(sets, pa.binary())], names=["h", "e"])


def _overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        like = []
        for x, y in zip(b.column("ea").to_pylist(), b.column("eb").to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            like.append(both / max(1, len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(like, pa.float64())], names=["a", "b", "likeness"])


#: Shingles of a block: so much and no more does a task hold of each side.
BLOCK_BYTES = 4 << 20


def _cross(least: float):
    """Links between members that ask and members of other components, block by block."""

    def links(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        members = [(h, c, np.frombuffer(e, np.uint64)) for asks, h, c, e in rows if not asks]
        size = np.array([len(e) for _, _, e in members])
        all_, owner = np.concatenate([e for _, _, e in members]), np.repeat(np.arange(len(members)), size)
        order = np.argsort(all_)
        all_, owner = all_[order], owner[order]
        comp = np.array([c for _, c, _ in members])
        for asks, h, c, e in rows:
            if not asks:
                continue
            e = np.frombuffer(e, np.uint64)
            lo, hi = np.searchsorted(all_, e), np.searchsorted(all_, e, "right")
            n = hi - lo
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(members))
            near = np.nonzero((both / (size + len(e) - both) >= least) & (comp != c))[0]
            for i in near[np.unique(comp[near], return_index=True)[1]]:  # of a component, one link is enough
                yield h, members[i][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: list[tuple]) -> pa.RecordBatch:
            pairs = list(links(rows)) if any(r[0] for r in rows) and not all(r[0] for r in rows) else []
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

        rows, last = [], None
        for b in batches:
            for key, q, m, asks, h, c, e in zip(*(x.to_pylist() for x in b.columns)):
                if (key, q, m) != last and rows:
                    yield found(rows)
                    rows = []
                last = (key, q, m)
                rows.append((asks, h, c, e))
        if rows:
            yield found(rows)

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float, path: str) -> DataFrame:
    left = sets.select(F.col("h").alias("a"), F.col("e").alias("ea"))
    right = sets.select(F.col("h").alias("b"), F.col("e").alias("eb"))
    tested = pairs.join(left, "a").join(right, "b").select("a", "b", "ea", "eb").mapInArrow(_overlap, "a bigint, b bigint, likeness double")
    return common.written(tested.where(F.col("likeness") >= least), path)


def components(links: DataFrame, path: str) -> DataFrame:
    """``h, comp`` of every linked node: comp is the least node of its component.

    Large stars and small stars in turn (each node's neighbours are hung on the least of them), the
    links written after each turn, until nothing moves; the number of turns grows with the logarithm
    of the nodes.
    """
    edges = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}-0")
    turn, before = 0, None
    while True:
        turn += 1
        # large star: neighbours on both sides; those above a node go to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = common.written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), f"{path}-{turn}")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == tuple(now):
            break
        before = tuple(now)
    roots = edges.select(F.col("v").alias("h"), F.col("v").alias("comp")).distinct()
    return edges.select(F.col("u").alias("h"), F.col("v").alias("comp")).unionByName(roots)


def classes(docs: DataFrame, *, least: float = 0.8, first_half: Callable[[Column], Column] | None = None) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: ``doc_id, h, g, class_id, class_size, keep``; keep: the row stays. ``first_half``: a
    hash in place of ``h``, for tests."""
    spark = docs.sparkSession
    common.tune(spark)
    work = common.work_dir(spark, "op5")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    rows = rows.withColumns(hashes(F.col("text"), first_half and first_half(F.col("text"))))
    found = common.written(rows.mapInArrow(_sketches, _SKETCH_KIND), f"{work}/sketches")
    # pairs of different texts that agree in 64 bits: one in 10^19, so the driver gets a handful even of 10^11 texts
    alike = [x["h"] for x in found.groupBy("h").agg((F.min("g") < F.max("g")).alias("two")).where("two").select("h").collect()]
    drawn = numbered(found, alike)
    nodes = drawn.where("n > 0").select("h", "n", "bands").dropDuplicates(["h"])

    # buckets of two and more
    keys = nodes.select("h", F.explode("bands").alias("key"))
    full = keys.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    multi = common.written(keys.join(full, "key"), f"{work}/buckets")
    shared = multi.groupBy("h").agg(F.sum("c").alias("shared"))
    shared = common.written(shared, f"{work}/shared")
    ranked = multi.join(shared, "h")
    best = Window.partitionBy("key").orderBy(F.col("shared").desc(), "h")
    hubs = ranked.withColumn("r", F.row_number().over(best)).where(F.col("r") <= HUBS)
    hubs = common.written(hubs.select("key", F.col("h").alias("hub"), "r"), f"{work}/hubs")

    # texts of candidates only: a distinct text is moved once
    once = numbered(rows, alike).groupBy("h").agg(F.first("text").alias("text")).join(shared.select("h"), "h", "left_semi")
    sets = common.written(once.select("h", "text").mapInArrow(_sets, "h bigint, e binary"), f"{work}/sets")
    stars = multi.join(hubs, "key").where("h <> hub").select(F.least("h", "hub").alias("a"), F.greatest("h", "hub").alias("b")).distinct()
    links = _verified(stars, sets, least, f"{work}/links1")
    comp = common.written(components(links, f"{work}/comp1"), f"{work}/comp1")

    # larger buckets: members outside the first hub's component, against all
    placed = multi.where(F.col("c") > HUBS + 1).join(comp, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    main = hubs.where("r = 1").select("key", F.col("hub").alias("h")).join(comp, "h", "left")
    placed = placed.join(main.select("key", F.coalesce("comp", "h").alias("main")), "key").join(nodes.select("h", "n"), "h")
    placed = common.written(placed.select("key", "h", "comp", (F.col("comp") != F.col("main")).alias("astray"), "n"), f"{work}/placed")
    blocks = lambda size: F.ceil(size * 8 / BLOCK_BYTES).cast("int")
    sizes = placed.groupBy("key").agg(
        blocks(F.sum("n")).alias("of_all"), blocks(F.sum(F.when(F.col("astray"), F.col("n")))).alias("of_astray")
    )
    open_ = placed.join(sizes.where("of_astray > 0"), "key")
    own = lambda count: F.pmod(F.xxhash64("h", F.lit(5)), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    ofall, ofastray = F.col("of_all"), F.col("of_astray")
    asked = open_.where("astray").select("key", "h", "comp", F.lit(True).alias("asks"), own(ofastray).alias("q"), every(ofall).alias("m"))
    members = open_.select("key", "h", "comp", F.lit(False).alias("asks"), every(ofastray).alias("q"), own(ofall).alias("m"))
    dealt = asked.unionByName(members).join(sets, "h")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select("key", "q", "m", "asks", "h", "comp", "e").repartition(n, "key", "q", "m").sortWithinPartitions("key", "q", "m")
    cross = dealt.mapInArrow(_cross(least), "a bigint, b bigint")
    more = common.written(cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{work}/links2")
    if more.limit(1).count():
        # the first components stand for their links: a node and its component's root
        old = comp.where("h <> comp").select(F.col("h").alias("a"), F.col("comp").alias("b"))
        comp = common.written(components(old.unionByName(more.select("a", "b")), f"{work}/comp2"), f"{work}/comp2")

    member = drawn.select("doc_id", "h", "g").join(comp, "h", "left").withColumn("comp", F.coalesce("comp", "h"))
    member = common.written(member, f"{work}/members")
    rank = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h", "g")
    tops = member.groupBy("comp").agg(F.min(rank).alias("top"), F.count(F.lit(1)).alias("class_size"))
    tops = common.written(tops, f"{work}/tops")  # a join's hot partitions are split only if no aggregate is in its stage
    out = member.join(tops, "comp")
    return out.select("doc_id", "h", "g", F.col("top.doc_id").alias("class_id"), "class_size", rank.eqNullSafe(F.col("top")).alias("keep"))


def without_copies(docs: DataFrame, *, least: float = 0.8) -> DataFrame:
    """One row of ``docs`` for each class, all its columns as they are."""
    # the second half of the hash and the id are enough to find a row again
    kept = classes(docs, least=least).where("keep").select(F.col("doc_id").alias("near_doc"), F.col("g").alias("near_g")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("own_doc"), hashes(common.text_of())["g"].alias("own_g"))
    same = F.col("own_doc").eqNullSafe(F.col("near_doc")) & (F.col("own_g") == F.col("near_g"))
    # equal rows are one class: the first of them stays
    return keyed.join(kept, same).dropDuplicates(["near_doc", "near_g"]).select("row.*")
