"""Substring deduplication by suffix arrays that are made by induced sorting.

Each byte covered by a string of ``LENGTH`` bytes that also starts elsewhere in the corpus goes. A suffix
array over the whole corpus would have to be one piece; here it is sharded so that equal strings
meet in the same shard:

1. Each window of LENGTH bytes is known by its least hashed ``GRAM``-byte string (the leftmost of equal
   ones); consecutive windows with the same one are a run, about 140 windows long. Equal windows have
   equal least strings, so only runs whose string occurs in another run can hold repeats. Just the
   hashes are shuffled to find these; copies of a whole text count once here.
2. The bytes of those runs (less than 2 * LENGTH each) are dealt by that hash. Runs of equal bytes are
   repeats as a whole, one of them stands for all in what follows. A task takes whole groups of
   runs together into shards of a few MB and makes a shard's suffix array by induced sorting: it
   classifies suffixes, sorts the leftmost-smaller substrings by induction, names them, sorts the
   string of names, and induces the whole array from it. All steps work on whole buckets at a time.
   The string of names has as many symbols as positions, so buckets don't help there: it is sorted by
   doubling ranks, which ends after a few rounds as runs are short.
3. Permuted common prefixes: a suffix whose left neighbour equals the left neighbour of its predecessor
   in the array has the common prefix of its left suffix less one; only the others are compared.
   Suffixes with a common prefix of LENGTH are repeats.
4. Repeats go back to their texts as ranges of bytes and are cut out.

A group of more than ``hot_runs`` runs (a passage that a huge number of texts share) isn't taken into one
task: its windows are hashed one by one (128 bits) and counted by hash, merged before the shuffle; what is found goes
back as ranges. No rows are dropped by that, and both ways find the same.

Defined cases: a null text is empty; nothing is removed from texts below LENGTH bytes; a text that comes
more than once, under whatever ids, loses all its bytes if it has LENGTH or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colstate.llm import common

LENGTH, GRAM = 400, 128
_BLOCK = 1 << 22  # bytes that are hashed at a time; positions take 24 bits
_P = 0x9E3779B97F4A7C15


def gram_hashes(b: np.ndarray, size: int, factor: int = _P) -> np.ndarray:
    """Polynomial hashes of all strings of ``size`` bytes, by doubling."""
    n = len(b) - size + 1
    out, have, total = None, b.astype(np.uint64) + np.uint64(1), 0
    span = 1
    while span <= size:
        if size & span:  # strings of the sizes whose sum is size, one after the other
            out = have if out is None else out[: len(have) - total] * np.uint64(pow(factor, span, 1 << 64)) + have[total:]
            total += span
        if span * 2 <= size:
            have = have[:-span] * np.uint64(pow(factor, span, 1 << 64)) + have[span:]
        span *= 2
    return common.mix(out[:n])


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if width > span else v


def runs_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Text number, first and last window start, and hash of each run of windows."""
    out: list[tuple] = []
    pieces = [(i, at, t[at : at + _BLOCK + length - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t) - length + 1), _BLOCK) if len(t) - at >= length]
    while pieces:
        group, size = [], 0
        while pieces and (not group or size + len(pieces[-1][2]) <= _BLOCK):
            group.append(pieces.pop())
            size += len(group[-1][2])
        b = np.frombuffer(b"".join(p[2] for p in group), np.uint8)
        h = gram_hashes(b, gram)
        at = np.arange(len(h), dtype=np.uint64)
        least = sliding_least((h >> np.uint64(24) << np.uint64(24)) | at, length - gram + 1)
        sizes = np.array([len(p[2]) for p in group])
        starts = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(group)), sizes)[: len(least)]
        p = np.arange(len(least))
        inside = p + length <= (starts + sizes)[owner]
        p, owner, least = p[inside], owner[inside], least[inside]
        first = np.ones(len(p), bool)
        first[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
        head = np.nonzero(first)[0]
        tail = np.append(head[1:], len(p)) - 1
        o = owner[head]
        offset = np.array([g[1] for g in group])[o] - starts[o]
        key = h[(least[head] & np.uint64(0xFFFFFF)).astype(np.int64)]
        out.append((np.array([g[0] for g in group])[o], p[head] + offset, p[tail] + offset, key.view(np.int64)))
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out))


# the suffix array -------------------------------------------------------------------------------


def _split(q: np.ndarray, c: np.ndarray, into: list[list[np.ndarray]]) -> None:
    """Append each position to its bucket's list, in order."""
    if not len(q):
        return
    order = np.argsort(c, kind="stable")
    q, c = q[order], c[order]
    cut = np.nonzero(c[1:] != c[:-1])[0] + 1
    for part, k in zip(np.split(q, cut), c[np.concatenate([[0], cut])].tolist()):
        into[k].append(part)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _same_bucket(front: np.ndarray, s: np.ndarray, c: int) -> np.ndarray:
    """The entries of a bucket together with those that they induce within it, round by round."""
    parts = [front]
    while len(front):
        front = front[front > 0] - 1
        front = front[s[front] == c]
        if len(front):
            parts.append(front)
    return _joined(parts)


def induce(s: np.ndarray, least: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, from the leftmost-smaller ones of each bucket in order, and which are of the smaller type.

    Buckets are gone through from the first to induce the larger type and from the last to induce the
    smaller; what a bucket induces elsewhere comes in the order of its entries.
    """
    queued: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    larger: list[np.ndarray] = []
    for c in range(buckets):
        own = _same_bucket(_joined(queued[c]), s, c)
        larger.append(own)
        scan = np.concatenate([own, least[c]])
        q = scan[scan > 0] - 1
        to = s[q]
        up = to > c
        _split(q[up], to[up], queued)
    queued = [[] for _ in range(buckets)]
    smaller: list[np.ndarray] = []  # from the last to the first bucket, each backwards
    last = np.array([len(s) - 1], np.int32)
    queued[int(s[-1])].append(last)  # the sentinel
    for c in range(buckets - 1, -1, -1):
        own = _same_bucket(_joined(queued[c]), s, c)
        smaller.append(own)
        scan = np.concatenate([own, larger[c][::-1]])
        q = scan[scan > 0] - 1
        to = s[q]
        down = to < c
        _split(q[down], to[down], queued)
    smaller.reverse()
    parts, kinds = [], []
    for c in range(buckets):
        parts += [larger[c], smaller[c][::-1]]
        kinds += [np.zeros(len(larger[c]), bool), np.ones(len(smaller[c]), bool)]
    return np.concatenate(parts), np.concatenate(kinds)


def _by_bucket(positions: np.ndarray, s: np.ndarray, buckets: int) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[] for _ in range(buckets)]
    _split(positions, s[positions], out)
    return [_joined(x) for x in out]


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the string of names, by doubling ranks; names are 1 and up."""
    n, rank, span = len(names), names.astype(np.int64), 1
    while True:
        after = np.zeros(n, np.int64)
        if span < n:
            after[:-span] = rank[span:]
        key = rank * (n + 1) + after
        order = np.argsort(key)
        key = key[order]
        step = np.concatenate([[1], (key[1:] != key[:-1]).astype(np.int64)])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == n:
            return order
        span *= 2


def suffix_array(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the segments (none empty), each closed by a mark of its own, and the order of all suffixes.

    Marks are smaller than bytes and ordered by segment. As buckets, all marks are one; their order
    within it is that of their positions, which is where the sort starts from.
    """
    sizes = np.array([len(x) for x in segments])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    flat = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    wide = flat.astype(np.int32) + len(segments)
    wide[ends] = len(segments) - 1 - np.arange(len(segments))  # the last mark is the least: the sentinel
    s = flat.astype(np.int16) + 1
    s[ends] = 0
    # marks in the bucket of marks: by their order, from the last position to the first
    differ = np.append(wide[:-1] != wide[1:], True)
    at = np.nonzero(differ)[0]
    nxt = at[np.searchsorted(at, np.arange(n))]
    follow = np.append(wide, -1)
    smaller = np.where(nxt == n - 1, True, follow[nxt] < follow[nxt + 1])
    smaller[-1] = True
    lms = np.nonzero(smaller[1:] & ~smaller[:-1])[0].astype(np.int32) + 1
    buckets = 257
    if not len(lms):
        lms = np.array([n - 1], np.int32)

    def ordered_marks(lists: list[np.ndarray]) -> list[np.ndarray]:
        lists[0] = np.sort(lists[0])[::-1]  # marks: later positions are smaller
        return lists

    def induced(leasts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, kind = induce(s, ordered_marks(_by_bucket(leasts, s, buckets)), buckets)
        order[: len(ends)] = ends[::-1]  # in the bucket of marks, induction looks at what follows a mark
        return order, kind

    order, kind = induced(lms)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    first = order[kind & is_lms[order]]
    # names: equal leftmost-smaller substrings get the same; compared symbol by symbol, both ends included
    length = np.zeros(n, np.int32)
    length[lms] = np.append(lms[1:] - lms[:-1], 0)
    a, b = first[:-1], first[1:]
    same = length[a] == length[b]
    live = np.nonzero(same)[0]
    j = 0
    while len(live):
        eq = wide[a[live] + j] == wide[b[live] + j]
        same[live[~eq]] = False
        live = live[eq]
        live = live[length[a[live]] > j]
        j += 1
    name = np.zeros(n, np.int32)
    name[first] = np.concatenate([[1], 1 + np.cumsum(~same)])
    names = name[lms]
    if names.max() < len(names):
        first = lms[_sort_names(names)]
    else:
        first = lms[np.argsort(names)]
    return wide, induced(first.astype(np.int32))[0]


def common_prefixes(wide: np.ndarray, order: np.ndarray) -> np.ndarray:
    """By position: the length of the common prefix with the suffix before it in the order (permuted LCP)."""
    n = len(wide)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    i = np.arange(n)
    ok = before >= 0
    # reducible: the left neighbours agree too, so the left suffix's value less one
    red = np.zeros(n, bool)
    j = i[1:][ok[1:] & (before[1:] > 0)]
    red[j] = wide[j - 1] == wide[before[j] - 1]
    hard = np.nonzero(ok & ~red)[0]
    value = np.zeros(n, np.int64)
    padded = np.append(wide, [-1, -2])  # marks differ from one another, so a comparison ends at the next one
    live, step = hard, 0
    while len(live):
        x = padded[np.minimum(live + step, n)]
        y = padded[np.where(before[live] + step < n, before[live] + step, n + 1)]
        live = live[x == y]
        value[live] += 1
        step += 1
    start = np.where(red, 0, i)
    start = np.maximum.accumulate(start)
    return np.maximum(value[start] - (i - start), 0) * ok


def repeats(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, where strings of ``length`` bytes start that also start elsewhere in the segments."""
    wide, order = suffix_array(segments)
    prefix = common_prefixes(wide, order)
    n = len(wide)
    twice = prefix >= length
    hit = twice.copy()
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    hit[order[at[np.nonzero(twice)[0]] - 1]] = True  # and the suffix before
    sizes = np.array([len(x) + 1 for x in segments])
    starts = np.cumsum(sizes) - sizes
    found = np.nonzero(hit)[0]
    seg = np.searchsorted(starts, found, "right") - 1
    cut = np.searchsorted(seg, np.arange(len(segments) + 1))
    return [found[i:j] - st for i, j, st in zip(cut, cut[1:], starts)]


# on tables --------------------------------------------------------------------------------------


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, p0, p1, key = runs_of([x.encode() for x in b.column("text").to_pylist()], length)
            h, g = (b.column(c).to_numpy(zero_copy_only=False)[t] for c in ("h", "g"))
            columns = [pa.array(x.astype(np.int64)) for x in (h, g, p0, p1, key)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "g", "p0", "p1", "key"])

    return run


def _segments(length: int):
    """The bytes of the listed runs of each text; of equal texts that follow each other, of one (more of them would do no
    harm: a text that comes more than once goes as a whole)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            out: list[tuple] = []
            for h, g, text, runs in zip(*(b.column(c).to_pylist() for c in ("h", "g", "text", "runs"))):
                if (h, g) == before:
                    continue
                before, data = (h, g), text.encode()
                out += [(r["key"], r["hot"], h, g, r["p0"], data[r["p0"] : r["p1"] + length]) for r in runs]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["key", "hot", "h", "g", "p0", "seg"])

    return run


def _ranges(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each stretch of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.nonzero(np.diff(starts) != 1)[0]
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


_FOUND = "h bigint, g bigint, s bigint, e bigint"


def _sorted_shards(length: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(group: list[tuple]) -> pa.RecordBatch:
            out = []
            times: dict[bytes, int] = {}
            for *_, seg in group:
                times[seg] = times.get(seg, 0) + 1
            starts = dict(zip(times, repeats(list(times), length)))
            for h, g, p0, seg in group:
                if times[seg] > 1:  # all of it comes again
                    out.append((h, g, p0, p0 + len(seg) - length))
                else:
                    out += [(h, g, p0 + s, p0 + e) for s, e in _ranges(starts[seg])]
            columns = list(zip(*out)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["h", "g", "s", "e"])

        group, seen, size, last = [], {}, 0, None
        for b in batches:
            for key, h, g, p0, seg in zip(*(b.column(c).to_pylist() for c in ("key", "h", "g", "p0", "seg"))):
                if key != last and size >= shard_bytes:
                    yield work(group)
                    group, seen, size = [], {}, 0
                last = key
                if seg not in seen:
                    seen[seg] = seg
                    size += len(seg)
                group.append((h, g, p0, seen[seg]))  # equal bytes are held once
        if group:
            yield work(group)

    return run


def _windows(length: int):
    """Every window of a run by two hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, g, p0, seg in zip(*(b.column(c).to_pylist() for c in ("h", "g", "p0", "seg"))):
                x = np.frombuffer(seg, np.uint8)
                a, c = gram_hashes(x, length), gram_hashes(x, length, 0xD6E8FEB86659FD93)
                n = len(a)
                columns = [a.view(np.int64), c.view(np.int64), np.full(n, h), np.full(n, g), p0 + np.arange(n)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["a", "c", "h", "g", "s"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted starts as ranges: a row for each stretch within a batch."""
    for b in batches:
        h, g, s = (b.column(c).to_numpy() for c in ("h", "g", "s"))
        if len(s):
            first = np.append(True, (h[1:] != h[:-1]) | (g[1:] != g[:-1]) | (s[1:] > s[:-1] + 1))
            at = np.nonzero(first)[0]
            columns = [h[at], g[at], s[at], s[np.append(at[1:], len(s)) - 1]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "g", "s", "e"])


_RESULT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, removed_spans array<struct<start:bigint,end:bigint>>, kept binary"


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, whole, found in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "whole", "found"))):
                data, spans = text.encode(), []
                if whole and len(data) >= length:
                    spans = [[0, len(data)]]
                else:
                    for s, e in sorted((x["s"], x["e"] + length) for x in found or ()):
                        if spans and s <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], e)
                        else:
                            spans.append([s, e])
                at, kept = 0, []
                for s, e in spans:
                    kept.append(data[at:s])
                    at = e
                kept.append(data[at:])
                kept_bytes = b"".join(kept)
                out.append((doc_id, len(data), len(data) - len(kept_bytes), len(spans), [{"start": s, "end": e} for s, e in spans], kept_bytes))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "removed_spans", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def deduplicate(docs: DataFrame, *, length: int = LENGTH, shard_bytes: int = 2 << 20, hot_runs: int = 8192) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: sizes, the removed spans (bytes of the input) and the bytes kept."""
    spark = docs.sparkSession
    common.tune(spark)
    work = common.work_dir(spark, "op9")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    rows = rows.withColumns({"h": F.xxhash64("text"), "g": F.xxhash64(F.lit(1), "text")})  # 128 bits stand for a text
    texts = rows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))
    texts = common.written(texts, f"{work}/texts")

    found = rows.where(F.octet_length("text") >= length).select("h", "g", "text").mapInArrow(_find_runs(length), "h bigint, g bigint, p0 bigint, p1 bigint, key bigint")
    runs = common.written(found.distinct(), f"{work}/runs")  # equal texts have equal runs
    # what hot keys are joined to is written first: a join's partitions are split only if no aggregate is in its stage
    often = common.written(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{work}/often")
    kept = runs.join(often, "key").select("h", "g", F.struct("key", (F.col("n") > hot_runs).alias("hot"), "p0", "p1").alias("r"))
    # a text's runs are bounded by its length
    listed = kept.groupBy("h", "g").agg(F.collect_list("r").alias("runs"))
    listed = listed.join(texts.select("h", "g", F.col("doc_id").alias("one")), ["h", "g"])
    listed = common.written(listed, f"{work}/listed")

    # one document stands for its copies; with its id among the keys they don't meet in a task
    same = (rows["h"] == listed["h"]) & (rows["g"] == listed["g"]) & rows["doc_id"].eqNullSafe(listed["one"])
    of_text = rows.join(listed, same).select(rows["h"], rows["g"], "text", "runs")
    segments = of_text.mapInArrow(
        _segments(length), "key bigint, hot boolean, h bigint, g bigint, p0 bigint, seg binary"
    )
    segments = common.written(segments, f"{work}/segments")  # texts move twice: for this, and to be cut
    size = segments.agg(F.sum(F.octet_length("seg")).alias("b"), F.max("hot").alias("hot")).first()
    n = max(1, -(-(size["b"] or 0) // (16 << 20)), int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = segments.where("NOT hot").repartition(n, "key").sortWithinPartitions("key")
    repeated = dealt.mapInArrow(_sorted_shards(length, shard_bytes), _FOUND)
    if size["hot"]:
        hot = segments.where("hot").mapInArrow(_windows(length), "a bigint, c bigint, h bigint, g bigint, s bigint")
        twice = common.written(hot.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), f"{work}/twice")
        again = hot.join(twice, ["a", "c"]).select("h", "g", "s").repartition(n, "h", "g", F.shiftright("s", 16))
        repeated = repeated.unionByName(again.sortWithinPartitions("h", "g", "s").mapInArrow(_merged, _FOUND))
    marks = repeated.groupBy("h", "g").agg(F.collect_list(F.struct("s", "e")).alias("found"))
    copies = texts.where("copies > 1").select("h", "g", F.lit(True).alias("whole"))
    marks = common.written(marks.join(copies, ["h", "g"], "full"), f"{work}/marks")
    out = rows.join(marks, ["h", "g"], "left").select("doc_id", "h", "g", "text", "whole", "found")
    return out.mapInArrow(_cut(length), _RESULT)


def digests(cleaned: DataFrame) -> DataFrame:
    """The query's columns."""
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """Removed spans of each text by a dictionary of all windows; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            d = hashlib.blake2b(t[i : i + length], digest_size=16).digest()
            seen[d] = seen.get(d, 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[hashlib.blake2b(t[i : i + length], digest_size=16).digest()] > 1:
                gone[i : i + length] = True
        out.append([(s, e + 1) for s, e in _ranges(np.nonzero(gone)[0])])
    return out
