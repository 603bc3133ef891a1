"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows are its runs of ``window`` consecutive words; an item of fewer words is one window.
A document holds a window only if it holds the window's rarest word, at the window's own offset. So
all words of the benchmark are counted over the corpus, each window's words are ordered by rarity,
and just the rarest is joined to the documents' words: the prefix. A candidate must then fit into
the document (position and length), have the second rarest word in its place, and at last equal
the document's words at that place, word by word.

Words are runs of ASCII letters, digits and all non-ASCII characters, after lower-casing A-Z. Texts are
cut into words as they are; a word is lower-cased when it is looked up, a run of them when it is compared.

The benchmark side is broadcast only if its measured size is at most ``broadcast_bytes``; beyond it,
the words are shuffled to it instead, without the texts, and the candidates verified after a join
back to the documents they are in.

Defined cases: a null text has no words; null items have no windows; equal rows (same doc_id and text)
get equal results; a null item_id isn't listed among the items, but its windows hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colstate.llm import common

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's words before lower-casing: ASCII letters, digits and all that isn't ASCII. The other characters are
#: listed one by one, since the regular expression engine looks single ones up in a table and tries ranges in turn.
WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"


def lowered(x: Column) -> Column:
    """A-Z in lower case, all else as it is; lower() is the same for ASCII and faster."""
    return F.when(F.octet_length(x) == F.char_length(x), F.lower(x)).otherwise(F.translate(x, _UPPER, _LOWER))


def words(column: str = "text") -> Column:
    """The words of a text, not yet in lower case."""
    return F.regexp_extract_all(common.text_of(column), F.lit(WORD), F.lit(0))


def windows_of(items: DataFrame, window: int) -> DataFrame:
    """The distinct windows of ``items (item_id, text)``: ``win`` (its words), ``items`` (ids as strings)."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), F.transform(words(), lowered).alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - window + 1, F.lit(1))
    each = w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, window))).alias("win"))
    return each.groupBy("win").agg(F.collect_set("item_id").alias("items"))


def _small(df: DataFrame, nbytes: int, limit: int) -> DataFrame:
    return F.broadcast(df) if nbytes <= limit else df


def prefixes(docs_words: DataFrame, wins: DataFrame, broadcast_bytes: int) -> tuple[DataFrame, int]:
    """A row for each window with its rarest word, and the bytes of the whole table.

    ``word, at`` (the rarest and its place, from 0), ``second, second_at`` (null if there is one word only), ``run, n`` (the
    window as a string and its words), ``items``.
    """
    vocabulary = wins.select(F.explode("win").alias("word")).distinct()
    size = vocabulary.agg(F.sum(F.octet_length("word") + 64).alias("b")).first()["b"] or 0
    seen = docs_words.select(F.explode("w").alias("word")).select(lowered(F.col("word")).alias("word"))
    counts = seen.join(_small(vocabulary, size, broadcast_bytes), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # a window with a word that no document has can't occur: the inner join drops it below
    spots = wins.select("win", "items", F.posexplode("win").alias("at", "word")).join(counts, "word")
    rarity = F.array_sort(F.collect_list(F.struct("n", "word", "at")))
    ranked = spots.groupBy("win").agg(F.first("items").alias("items"), rarity.alias("r")).where(F.size("r") == F.size("win"))
    second = F.get("r", F.lit(1))
    table = ranked.select(
        F.col("r")[0]["word"].alias("word"), F.col("r")[0]["at"].alias("at"), second["word"].alias("second"), second["at"].alias("second_at"),
        F.array_join("win", " ").alias("run"), F.size("win").alias("n"), "items",
    )
    table = common.written(table, common.work_dir(docs_words.sparkSession, "op7") + "/prefixes")
    weight = 2 * F.octet_length("run") + F.aggregate("items", F.lit(0), lambda s, x: s + F.octet_length(x) + 16) + 128
    return table, table.agg(F.sum(weight).alias("b")).first()["b"] or 0


_KEYS = ["doc_id", "h"]


def occurrences(docs_words: DataFrame, table: DataFrame, nbytes: int, broadcast_bytes: int) -> DataFrame:
    """Where windows occur: ``doc_id, h, start`` (from 0), ``n`` (words), ``items``; and a row without these for each row of
    the documents, all with ``n_words``."""
    of_window = ["at", "second", "second_at", "run", "n", "items"]
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))
    sized = docs_words.withColumn("n_words", F.size("w").cast("long"))
    next_word = F.col("second").isNull() | (lowered(F.get("w", start + F.col("second_at"))) == F.col("second"))
    # as one string: no word holds a blank. slice() may be asked before ``fits`` is, hence the least start
    own = F.array_join(F.slice("w", F.greatest(start, F.lit(0)) + 1, F.col("n")), " ")
    whole = F.translate(own, _UPPER, _LOWER) == F.col("run")
    if nbytes <= broadcast_bytes:
        # an empty word closes each document, a window's row without a window meets it: texts are read once for both
        closed = sized.select(*_KEYS, "w", "n_words", F.posexplode(F.concat("w", F.array(F.lit("")))).alias("pos", "word"))
        close = docs_words.sparkSession.range(1).select(*[F.lit("" if c == "word" else None).cast(table.schema[c].dataType).alias(c) for c in table.columns])
        found = closed.withColumn("word", lowered(F.col("word"))).join(F.broadcast(table.unionByName(close)), "word")
        found = found.where(F.col("run").isNull() | (fits & next_word & whole))
        return found.select(*_KEYS, "n_words", start.alias("start"), "n", "items")
    spots = sized.select(*_KEYS, "n_words", F.posexplode("w").alias("pos", "word")).withColumn("word", lowered(F.col("word")))
    candidates = spots.join(table, "word").where(fits).select(*_KEYS, "n_words", "pos", *of_window)
    texts = docs_words.dropDuplicates(_KEYS).select(*[F.col(k).alias(f"own_{k}") for k in _KEYS], "w")
    # rows with the same id and text have the same candidates
    found = candidates.distinct().join(texts, F.col("doc_id").eqNullSafe(F.col("own_doc_id")) & (F.col("h") == F.col("own_h")))
    found = found.where(next_word).where(whole).select(*_KEYS, "n_words", start.alias("start"), "n", "items")
    return found.unionByName(sized.select(*_KEYS, "n_words"), allowMissingColumns=True)


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", common.text_of().alias("text")).withColumn("h", F.xxhash64("text"))


def _found(keyed: DataFrame, items: DataFrame, window: int, broadcast_bytes: int) -> DataFrame:
    docs_words = keyed.select("doc_id", "h", words().alias("w"))
    table, nbytes = prefixes(docs_words, windows_of(items, window), broadcast_bytes)
    found = occurrences(docs_words, table, nbytes, broadcast_bytes)
    return common.written(found, common.work_dir(keyed.sparkSession, "op7") + "/found")


def clean(docs: DataFrame, items: DataFrame, *, window: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` without any window, all columns as they are."""
    found = _found(_keyed(docs), items, window, broadcast_bytes).where("start IS NOT NULL")
    hits = found.select(F.col("doc_id").alias("hit_doc"), F.col("h").alias("hit_h")).distinct()
    hits = common.written(hits, common.work_dir(docs.sparkSession, "op7") + "/hits")
    hits = _small(hits, 48 * hits.count(), broadcast_bytes)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col("doc_id").alias("own_doc"), F.xxhash64(common.text_of()).alias("own_h"))
    same = F.col("own_doc").eqNullSafe(F.col("hit_doc")) & (F.col("own_h") == F.col("hit_h"))
    return keyed.join(hits, same, "left_anti").select("row.*")


def decontaminate(docs: DataFrame, items: DataFrame, *, window: int = 10, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Per row of ``docs (doc_id, text)``: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = _found(_keyed(docs), items, window, broadcast_bytes)
    # a document's occurrences are bounded by its own length
    per_doc = found.where("start IS NOT NULL").groupBy(*_KEYS).agg(
        F.collect_set(F.struct("start", "n")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    hits = per_doc.select(
        F.col("doc_id").alias("hit_doc"),
        F.col("h").alias("hit_h"),
        F.size(covered).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    light = found.where("start IS NULL").select(*_KEYS, "n_words")
    joined = light.join(hits, light["doc_id"].eqNullSafe(hits["hit_doc"]) & (light["h"] == hits["hit_h"]), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: DuckDB SQL for the result over ``documents`` and ``benchmark``.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item_id, array_to_string(w[s : s + 9], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, grams.n, item_id FROM grams JOIN win ON grams.g = win.g AND grams.n = win.n
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
