"""Documents that no leaf of the production tree names."""

from collections import Counter

import corpus_pipeline as cp
from colstate.llm import common
from colstate.llm import op3_mixing as op

SF = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string"
UNLISTED = [("it", "src0"), ("en", "blog"), (None, "src1"), ("de", None), (None, None)]


def mixed(docs, **kw):
    return Counter(tuple(r) for r in op.mix(docs, op.production_weights(), op.DOMAINS, **kw).select("doc_id", "mix_leaf", "mix_epoch").collect())


def test_unlisted_documents_have_a_leaf(spark):
    rows = [(i, "w " * (i % 7), *[("en", "src0"), *UNLISTED][i % 6]) for i in range(120)]
    got = mixed(spark.createDataFrame(rows, KIND), total=10**9)
    name = lambda r: "\x1f".join(("web", "en", "src0") if r[2:] == ("en", "src0") else op.OTHER)
    assert got == Counter((r[0], name(r), e) for r in rows for e in (1, 2))


def test_their_budget(spark):
    rows = [(i, "a b", "en", "src0") for i in range(1000)] + [(1000 + i, "a b", *UNLISTED[i % 5]) for i in range(1000)]
    got = Counter(leaf for _, leaf, _ in mixed(spark.createDataFrame(rows, KIND), total=700).elements())
    assert got == {"web\x1fen\x1fsrc0": 300, "\x1f".join(op.OTHER): 50}  # 6 : 1


def test_a_corpus_of_new_names(spark):
    docs = common.table(spark, SF, "documents")
    new = docs.selectExpr("doc_id", "text", *[f"'new ' || {c} AS {c}" if c in ("lang", "source") else c for c in docs.columns if c not in ("doc_id", "text")])
    count = lambda df: df.agg({"n": "sum"}).first()[0]
    n = lambda df: count(df.select(op.tokens_of().alias("n")))
    assert 0.85 * n(new) < n(cp.mixture(spark, new, SF)) <= 0.9 * n(new)


def test_listed_documents_keep_their_mixture(spark):
    docs = common.table(spark, SF, "documents")
    bare = {p: w for p, w in op.production_weights().items() if p != op.OTHER[: len(p)]}
    want = op.mix(docs, bare, op.DOMAINS, total=0.75).select("doc_id", "mix_leaf", "mix_epoch").collect()
    assert mixed(docs, total=0.75) == Counter(map(tuple, want))
