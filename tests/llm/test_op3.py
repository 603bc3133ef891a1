from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from colstate.llm import op3_mixing as op


def test_budgets():
    t = {("a",): 1, ("b",): 1, ("a", "x"): 1, ("a", "y"): 1, ("b", "x"): 1, ("a", "x", "1"): 1, ("a", "x", "2"): 3, ("a", "y", "1"): 1, ("b", "x", "1"): 1}
    able = {p: 1000 for p in t if len(p) == 3}
    assert op.allocate(t, able, 800) == {("a", "x", "1"): 50, ("a", "x", "2"): 150, ("a", "y", "1"): 200, ("b", "x", "1"): 400}
    able[("a", "x", "2")] = 100  # its sibling takes the shortage, nobody else sees it
    assert op.allocate(t, able, 800) == {("a", "x", "1"): 100, ("a", "x", "2"): 100, ("a", "y", "1"): 200, ("b", "x", "1"): 400}
    able[("a", "x", "1")] = 60  # now the language is short: the other language of the domain takes it
    assert op.allocate(t, able, 800) == {("a", "x", "1"): 60, ("a", "x", "2"): 100, ("a", "y", "1"): 240, ("b", "x", "1"): 400}
    able[("a", "y", "1")] = 0  # and now the domain
    assert op.allocate(t, able, 800) == {("a", "x", "1"): 60, ("a", "x", "2"): 100, ("a", "y", "1"): 0, ("b", "x", "1"): 640}
    assert sum(op.allocate(t, able, 10**9).values()) == 1160
    assert op.allocate({}, {}, 5) == {}


DOMAINS = {"s1": "d", "s2": "d", "s3": "e"}
TREE = {("d",): 1, ("e",): 2, ("d", "en"): 1, ("d", "fr"): 1, ("e", "en"): 1, ("d", "en", "s1"): 1, ("d", "en", "s2"): 2, ("d", "fr", "s1"): 1, ("e", "en", "s3"): 1}


@pytest.mark.parametrize("total,epochs,bits", [(0.5, 2, 12), (0.9, 3, 2), (1.5, 2, 1), (40, 2, 12), (0, 2, 12), (10**9, 2, 3)])
def test_mixture(spark, total, epochs, bits):
    rows = [(i, "w " * (i % 13), ["en", "fr", None][i % 7 // 3], f"s{i % 4}", "c") for i in range(400)]
    rows += [(5, None, "en", "s1", "c"), (7, "x y", "en", "s2", "c"), (7, "x y", "en", "s2", "c"), (None, "x y z", "en", "s3", "c"), (9, "x", "en", None, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n string")
    got = op.mix(df, TREE, DOMAINS, total=total, epochs=epochs, class_bits=bits)
    assert got.columns == [*df.columns, "mix_leaf", "mix_epoch"] or set(df.columns) < set(got.columns)
    # brute force: sort each leaf by each epoch's hash
    keyed = df.select("*", *[op.order_key(7, F.lit(e)).alias(f"k{e}") for e in range(1, epochs + 1)]).collect()
    leaf = lambda r: (DOMAINS.get(r.source), r.lang, r.source)
    count = lambda r: len((r.text or "").split())
    by = {p: [r for r in keyed if leaf(r) == p] for p in TREE if len(p) == 3}
    have = {p: sum(map(count, rs)) for p, rs in by.items() if rs}
    sought = int(total * sum(have.values())) if isinstance(total, float) else total
    budget = op.allocate(TREE, {p: n * epochs for p, n in have.items()}, sought)
    want = []
    for p, rs in by.items():
        left, n = budget.get(p, 0), have.get(p, 0)
        for e in range(1, epochs + 1):
            if not n or left >= n:
                want += [(r.doc_id, r.text, e) for r in rs]
                left -= n
                continue
            if left > 0:
                groups = {}
                for r in rs:
                    groups.setdefault(r[f"k{e}"], []).append(r)
                for k in sorted(groups):
                    left -= sum(map(count, groups[k]))
                    if left < 0:
                        break
                    want += [(r.doc_id, r.text, e) for r in groups[k]]
            break
    assert sorted(((r.doc_id, r.text, r.mix_epoch) for r in got.collect()), key=str) == sorted(want, key=str)
    assert op.mix(df.limit(0), TREE, DOMAINS, total=total).count() == 0
    assert Fraction(1)
