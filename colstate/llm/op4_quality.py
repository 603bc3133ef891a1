"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic models read a whole text: is it good prose, and is it toxic. Their features are shares that
describe a text's shape (capitals, symbols, repeated words and lines ...) and the presence of the
words that tell the labelled classes apart best. They are fitted on at most ``sample_rows`` labelled
documents, drawn by a seeded hash.

A document's evidence is then combined with that of its site. Over all documents, posteriors of being
good are summed by host and by path within host (for ``documents``: source and language). A host's
rate is shrunk toward the global rate, a path's rate toward its host's, each by a prior strength that
the method of moments takes from the spread of the rates beyond sampling noise. A document's own
part is left out of its site's rate, so that a site of one document says just the prior. The
difference of the site's log-odds to the global ones is added to the document's.

Fitting looks at a bounded sample, everything else at all documents: one pass for the sums by site (merged
task by task first, so a host with a third of the rows costs a row a task), one for the scores. The
table of sites is broadcast only if its measured size is at most ``broadcast_bytes``, otherwise joined.

Defined cases: a null text counts as empty; a text without words has no evidence of its own and gets its
site's rate and no toxicity; null hosts and paths are a site of their own; repeated labels of a
document count as the worst of them; without labels of both kinds a model says the same of every text (0.5, or not toxic).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colstate.llm import common

_WORD = re.compile(r"\w+")
_ODD_SIGN = re.compile(r"[^\w\s.,;:?'\"()\-]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
SHAPE = 9


def read(text: str) -> tuple[list[float], set[str]] | None:
    """Shape shares of a whole text and its set of words; None without words."""
    tokens = text.split()
    found = _WORD.findall(text.lower())
    if not tokens or not found:
        return None
    n, distinct, lines = len(tokens), set(found), text.split("\n")
    full = [x for x in lines if x.strip()]
    shape = [
        np.log1p(n),
        len(_CAPITAL.findall(text)) / len(text),
        sum(map(str.isupper, tokens)) / n,
        min(3.0, len(_ODD_SIGN.findall(text)) / n),
        sum(not t[-1].isalnum() for t in tokens) / n,
        len(distinct) / len(found),
        sum(map(str.__eq__, tokens, tokens[1:])) / n,
        1 - len(set(full)) / len(full),
        sum(map(len, found)) / len(found) / 10,
    ]
    return shape, distinct


@dataclass
class Model:
    """Words, and for each of the two heads a mean, scale and weights over shape, squared shape and words."""

    words: dict[str, int]
    mean: np.ndarray
    scale: np.ndarray
    heads: np.ndarray  # 2 rows: good, toxic; the last column is the constant

    def row(self, text: str) -> np.ndarray | None:
        if (x := read(text)) is None:
            return None
        shape, distinct = x
        out = np.zeros(2 * SHAPE + len(self.words))
        out[:SHAPE] = shape
        out[SHAPE : 2 * SHAPE] = np.square(shape)
        for w in distinct & self.words.keys():
            out[2 * SHAPE + self.words[w]] = 1
        return out

    def logits(self, texts: list[str]) -> np.ndarray:
        """Log-odds of good and toxic, null (nan) for texts without words."""
        out = np.full((len(texts), 2), np.nan)
        for i, t in enumerate(texts):
            if (x := self.row(t)) is not None:
                out[i] = self.heads[:, :-1] @ ((x - self.mean) / self.scale) + self.heads[:, -1]
        return np.clip(out, -20, 20)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, empty: float) -> np.ndarray:
    """Weights and constant of a logistic model, by Newton's method."""
    if not len(y) or y.min() == y.max():
        return np.append(np.zeros(x.shape[1]), empty)
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-6)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 6000, words: int = 150, ridge: float = 3.0, seed: int = 11) -> Model:
    """Fit both heads on at most ``sample_rows`` labelled documents of ``labels (doc_id, quality, toxic)``."""
    drawn = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    drawn = drawn.where("quality is not null and toxic is not null")
    drawn = drawn.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample_rows)
    labelled = docs.select(F.col("doc_id"), common.text_of().alias("text")).join(F.broadcast(drawn), "doc_id")  # sample_rows rows
    labelled = common.written(labelled.dropDuplicates(["doc_id"]), common.work_dir(docs.sparkSession, "op4") + "/sample")

    # documents of each class that have a word; the best words of each head by their G statistic
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, bad, rude = Counter(), Counter(), Counter()
            for t, q, tox in zip(*(b.column(c).to_pylist() for c in ("text", "quality", "toxic"))):
                if (x := read(t)) is not None:
                    (good if q else bad).update(x[1])
                    if tox:
                        rude.update(x[1])
            ws = list(good.keys() | bad.keys())
            columns = [pa.array(ws, pa.string())] + [pa.array([c[w] for w in ws], pa.int64()) for c in (good, bad, rude)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "good", "bad", "rude"])

    sizes = labelled.agg(F.sum((F.col("quality") > 0).cast("long")).alias("g"), F.sum((F.col("toxic") > 0).cast("long")).alias("t"), F.count(F.lit(1)).alias("n")).first()
    n, g, t = sizes["n"] or 0, sizes["g"] or 0, sizes["t"] or 0
    counts = labelled.mapInArrow(tally, "word string, good bigint, bad bigint, rude bigint").groupBy("word")
    counts = counts.agg(*[F.sum(c).alias(c) for c in ("good", "bad", "rude")]).where("good + bad >= 5")

    def score(inside: str, size_in: int, outside: str, size_out: int):
        i, o = F.expr(inside), F.expr(outside)
        e = (i + o) * (size_in / max(1, size_in + size_out))
        signed = i * F.log((i + 0.5) / (e + 0.5)) + o * F.log((o + 0.5) / (i + o - e + 0.5))
        return signed

    best: list[str] = []
    for how in (score("bad", n - g, "good", g), score("rude", t, "good + bad - rude", n - t)):
        best += [r["word"] for r in counts.orderBy(how.desc(), "word").limit(words).collect()]  # ``words`` rows
    model = Model({w: i for i, w in enumerate(dict.fromkeys(best))}, np.zeros(1), np.ones(1), np.zeros((2, 1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(shared.value.row(t), q, x) for t, q, x in zip(*(b.column(c).to_pylist() for c in ("text", "quality", "toxic")))]
            found = [(r.astype("<f4").tobytes(), q, x) for r, q, x in found if r is not None]
            columns = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["x", "quality", "toxic"])

    got = labelled.mapInArrow(rows, "x binary, quality int, toxic int").collect()  # sample_rows rows at most
    width = 2 * SHAPE + len(model.words)
    x = np.array([np.frombuffer(r["x"], "<f4") for r in got], dtype=float).reshape(-1, width)
    model.mean = x.mean(0) if len(x) else np.zeros(width)
    model.scale = np.maximum(x.std(0) if len(x) else np.ones(width), 0.02)
    z = (x - model.mean) / model.scale
    quality, toxic = np.array([r["quality"] > 0 for r in got], float), np.array([r["toxic"] > 0 for r in got], float)
    model.heads = np.vstack([_fit(z, quality, ridge, 0.0), _fit(z, toxic, ridge, -20.0)])
    return model


# sites ------------------------------------------------------------------------------------------


def _logit(p):
    return F.log(p) - F.log(1 - p)


def _strength(spread: float, noise: float, m: float) -> float:
    """Of a Beta prior with mean m, whose rates spread so much beyond the noise; within [1, 10^6]."""
    tau = max(spread - noise, 1e-12)
    return float(min(max(m * (1 - m) / tau - 1, 1.0), 1e6))


def score(
    docs: DataFrame,
    model: Model,
    *,
    host_col: str = "source",
    path_col: str = "lang",
    least: float = 0.5,
    most_toxic: float = 0.5,
    broadcast_bytes: int = 32 << 20,
    with_text: bool = True,
) -> DataFrame:
    """All columns of ``docs``, with ``q_document, q_site, q_quality, q_toxic, q_keep`` added (or replaced, if there).

    The models read each text once: rows are written with their evidence, the sums by site read the evidence only. Without
    ``with_text`` neither what is written nor the result has the text.
    """
    spark = docs.sparkSession
    common.tune(spark)
    shared = spark.sparkContext.broadcast(model)  # as large as the model: shape and chosen words

    @F.pandas_udf("good double, toxic double")
    def judge(text: pd.Series) -> pd.DataFrame:
        x = 1 / (1 + np.exp(-shared.value.logits(text.tolist())))
        return pd.DataFrame({"good": pd.Series(x[:, 0]), "toxic": pd.Series(x[:, 1])})

    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    own_columns = [c for c in docs.columns if c not in ("q_document", "q_site", "q_quality", "q_toxic", "q_keep")]
    own_columns = [c for c in own_columns if with_text or c != "text"]
    # the input's columns travel as one, so their names can't clash with those used here
    row = F.struct(*[F.col(f"`{c}`") for c in own_columns]).alias("row")
    keyed = docs.select(row, host.alias("q_host"), path.alias("q_path"), judge(common.text_of()).alias("q_judged"))
    keyed = common.written(keyed, common.work_dir(spark, "op4") + "/evidence")
    # a text without words: nan from the model, null from here on
    good = F.when(~F.isnan("q_judged.good"), F.col("q_judged.good"))

    sites = keyed.select("q_host", "q_path", good.alias("p")).groupBy("q_host", "q_path")
    sites = sites.agg(F.sum("p").alias("s"), F.count("p").alias("n"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v"))
    sites = common.written(sites.fillna(0.0, ["s", "v"]), common.work_dir(spark, "op4") + "/sites")
    hosts = sites.groupBy("q_host").agg(F.sum("s").alias("hs"), F.sum("n").alias("hn"))
    whole = sites.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    m = float(min(max((whole["s"] or 0.0) / (whole["n"] or 1), 0.01), 0.99)) if whole["n"] else 0.5

    def strength(rates: DataFrame, s: str, n: str, around) -> float:
        """From the sites' rates, weighted by their rows."""
        p = (F.col(s) + F.lit(0.5) * m) / (F.col(n) + 0.5)
        r = rates.where(F.col(n) > 0).agg(
            (F.sum(F.col(n) * (p - around) ** 2) / F.sum(n)).alias("spread"), (F.sum(p * (1 - p)) / F.sum(n)).alias("noise")
        ).first()
        return _strength(r["spread"] or 0.0, r["noise"] or 0.0, m)

    k_host = strength(hosts, "hs", "hn", F.lit(m))
    host_rate = (F.col("hs") + k_host * m) / (F.col("hn") + k_host)
    tree = sites.join(hosts, "q_host")
    k_path = strength(tree.withColumn("around", host_rate), "s", "n", F.col("around"))
    tree = tree.select("q_host", "q_path", "s", "n", "hs", "hn")
    size = tree.agg(F.sum(F.octet_length("q_host") + F.octet_length("q_path") + 96).alias("b")).first()["b"] or 0
    joined = keyed.join(F.broadcast(tree) if size <= broadcast_bytes else tree, ["q_host", "q_path"])

    own, one = F.coalesce(good, F.lit(0.0)), F.when(good.isNotNull(), 1).otherwise(0)
    host_rate = (F.col("hs") - own + k_host * m) / (F.col("hn") - one + k_host)
    rate = (F.col("s") - own + k_path * host_rate) / (F.col("n") - one + k_path)
    site = F.least(F.greatest(rate, F.lit(0.01)), F.lit(0.99))
    odds = _logit(F.least(F.greatest(F.coalesce(good, F.lit(m)), F.lit(1e-9)), F.lit(1 - 1e-9))) + _logit(site) - float(np.log(m / (1 - m)))
    toxic = F.coalesce(F.when(~F.isnan("q_judged.toxic"), F.col("q_judged.toxic")), F.lit(0.0))
    out = joined.withColumns({"q_document": good, "q_site": site, "q_quality": 1 / (1 + F.exp(-odds)), "q_toxic": toxic})
    out = out.withColumn("q_keep", (F.col("q_quality") >= least) & (F.col("q_toxic") < most_toxic))
    return out.select("row.*", "q_document", "q_site", "q_quality", "q_toxic", "q_keep")
