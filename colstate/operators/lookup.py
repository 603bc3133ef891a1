"""Lookup of names in another dataset: exact first, then the most similar one.

Exact: equal lower-cased names; of equal names in the other dataset the last id counts, their place is
that of the first. Fuzzy, for names without an exact match: the other name with the largest
``SequenceMatcher(None, own, other).ratio()``, of equal ratios the one that came first, if the
ratio is at least 0.8. The ratio isn't symmetric, so the order of its arguments matters.

Only distinct unmatched names are compared, and no product of them is made. A ratio of t needs t * (l + m) / 2 characters in
common for lengths l and m, each as often as both names have it. So a name is a set of (occurrence, character); for each
length that the other name may have, so many of its elements, those of high occurrence and code point first, as
are left over by that number, and one: two such names share at least one of these (the prefixes of a set join). Names are
joined on an element and both lengths, pairs are counted once, at their first common element, and
just those with enough characters in common are aligned.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8


def similarity(own: str, other: str) -> float:
    return SequenceMatcher(None, own, other).ratio()


def known_names(ext: DataFrame, name: str, id_: str, seq: str) -> DataFrame:
    """One row per lower-cased name: ``key, id`` (the last) and ``first_seq`` (the first)."""
    named = ext.where(F.col(name).isNotNull())
    return named.groupBy(F.lower(name).alias("key")).agg(F.max_by(F.col(id_), F.col(seq)).alias("id"), F.min(seq).alias("first_seq"))


def _pairs(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for other, group in b.groupby("key", sort=False):
            m, seq = SequenceMatcher(None, "", other), int(group["first_seq"].iloc[0])  # caches what it knows of its second text
            for own, id_ in zip(group["own"], group["id"]):
                m.set_seq1(own)
                if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold and (r := m.ratio()) >= threshold:
                    out.append((own, r, seq, id_))
        yield pd.DataFrame(out, columns=["own", "ratio", "first_seq", "id"])


def _elements(name: Column) -> Column:
    """A name's characters with the number of their occurrence, late ones first: what few names share comes early."""
    signs = F.split(name, "")
    nth = lambda c, i: F.size(F.filter(F.slice(signs, F.lit(1), i + 1), lambda x: x == c))
    return F.sort_array(F.transform(signs, lambda c, i: F.concat(F.lpad(nth(c, i).cast("string"), 6, "0"), c)), asc=False)


def _prefixes(names: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows ``element, own_len, other_len, need`` for each length of the other name, with the name and its elements."""
    step = threshold / (2 - threshold)  # shorter / longer at least
    size = F.size("elements")
    rows = names.where(F.length(column) > 0).withColumn("elements", _elements(F.col(column)))
    other = F.explode(F.sequence(F.ceil(size * step - 1e-9).cast("int"), F.floor(size / step + 1e-9).cast("int")))
    rows = rows.select("*", size.alias("own_len"), other.alias("other_len"))
    rows = rows.withColumn("need", F.ceil((F.col("own_len") + F.col("other_len")) * threshold / 2 - 1e-9).cast("int"))
    rows = rows.where(F.col("need") <= F.least("own_len", "other_len")).withColumn("prefix", F.slice("elements", F.lit(1), F.col("own_len") - F.col("need") + 1))
    return rows.select("*", F.explode("prefix").alias("element"))


def candidates(names: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``own, key, id, first_seq`` of all pairs that have enough characters in common, each once."""
    left = _prefixes(names.select("own"), "own", threshold).withColumnsRenamed({"elements": "own_elements", "prefix": "own_prefix"})
    right = _prefixes(known.select("key", "id", "first_seq"), "key", threshold)
    right = right.select("key", "id", "first_seq", "elements", "prefix", "element", F.col("own_len").alias("other_len"), F.col("other_len").alias("own_len"))
    pairs = left.join(right, ["element", "own_len", "other_len"])
    first = F.array_intersect("own_prefix", "prefix")[0] == F.col("element")
    enough = F.size(F.array_intersect("own_elements", "elements")) >= F.col("need")
    return pairs.where(first).where(enough).select("own", "key", "id", "first_seq")


def fuzzy(names: DataFrame, known: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``own, id`` for the distinct ``names (own)`` that have a similar known name."""
    scored = candidates(names, known, threshold).mapInPandas(lambda b: _pairs(b, threshold), "own string, ratio double, first_seq bigint, id string")
    best = F.max_by(F.col("id"), F.struct("ratio", -F.col("first_seq")))
    return scored.groupBy("own").agg(best.alias("id"))


def lookup(base: DataFrame, column: str, ext: DataFrame | None, match_columns: tuple[str, str], seq: str, out: str, fuzzy_match: bool = True) -> DataFrame:
    """``base`` with ``out``: the id that its name finds in ``ext``; NULL for all if ``ext`` or a column of it is missing."""
    name, id_ = match_columns
    if ext is None or not {name, id_} <= set(ext.columns):
        return base.withColumn(out, F.lit(None).cast("string"))
    known = known_names(ext.select(name, F.col(id_).cast("string").alias(id_), seq), name, id_, seq)
    own = base.withColumn("_own", F.lower(column))
    exact = own.join(known.select(F.col("key").alias("_own"), F.col("id").alias("_id"), F.lit(True).alias("_hit")), "_own", "left")
    if not fuzzy_match:
        return exact.withColumn(out, F.col("_id")).drop("_own", "_id", "_hit")
    open_ = exact.where(F.col("_hit").isNull() & F.col("_own").isNotNull()).select(F.col("_own").alias("own")).distinct()
    near = fuzzy(open_, known).select(F.col("own").alias("_own"), F.col("id").alias("_near"))
    both = exact.join(near, "_own", "left")
    return both.withColumn(out, F.when(F.col("_hit"), F.col("_id")).otherwise(F.col("_near"))).drop("_own", "_id", "_hit", "_near")


def brute_force(names: list[str | None], ext: list[tuple[str | None, str]], threshold: float = THRESHOLD) -> list[str | None]:
    """The same by plain loops; for tests."""
    known: dict[str, str] = {}
    for n, i in ext:
        if n is not None:
            known[n.lower()] = i
    out: list[str | None] = []
    for n in names:
        if n is None:
            out.append(None)
        elif n.lower() in known:
            out.append(known[n.lower()])
        else:
            scores = [(similarity(n.lower(), k), -at) for at, k in enumerate(known)]
            best = max(scores, default=(0.0, 0))
            out.append(known[list(known)[-best[1]]] if best[0] >= threshold else None)
    return out

