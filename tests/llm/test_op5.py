import random
from collections import Counter

import numpy as np
import pytest

from colstate.llm import common, op5_bagminhash as op


def multiset(text):
    w = op._WORD.findall((text or "").lower())
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def like(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def brute(rows, least=0.8):
    sets, up = [multiset(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or (sets[i] and like(sets[i], sets[j]) >= least):
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    return sorted((sorted((rows[i] for i in g), key=str) for g in groups.values()), key=str)


def corpus(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for base in range(25):
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 6, 40, 150]))]
        for _ in range(rng.choice([1, 2, 30 if base == 4 else 4])):
            w = list(words)
            for _ in range(rng.randrange(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w)))
            n += 3
    rep = "again and again and "
    rows += [(1000, rep * 30), (1001, rep * 33), (1002, rep * 10), (1003, None), (1004, ""), (None, rows[0][1]), (1005, "Two words"), (1006, "two  WORDS!"), (0, rows[0][1]), (1007, ". . !")]
    return rows


def test_signatures_estimate_weighted_likeness():
    rng = np.random.default_rng(5)
    a = [f"x{i} " * int(rng.integers(1, 9)) for i in range(300)]
    one, two = " ".join(a), " ".join(a[40:] + ["new words come here"] * 10)
    doc, h, times = op.multisets([one, two, one])
    sig = op.signatures(3, doc, h, times, slots=4096)
    want = like(multiset(one), multiset(two))
    assert (sig[0] == sig[2]).all()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * (want * (1 - want) / 4096) ** 0.5
    # weights alone tell: the same shingle, more and less often
    doc, h, times = op.multisets(["k " * 104, "k " * 54])
    sig = op.signatures(2, doc, h, times, slots=4096)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.03


@pytest.mark.parametrize("hubs,block", [(8, 4 << 20), (1, 4 << 20), (1, 3000)])
def test_classes_against_all_pairs(spark, monkeypatch, hubs, block):
    monkeypatch.setattr(op, "HUBS", hubs)
    monkeypatch.setattr(op, "BLOCK_BYTES", block)
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, h int, comp string")
    got = {}
    out = op.classes(df).collect()
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in out:
        got.setdefault(r.class_id, []).append(r.doc_id)
    want = {min((i for i, _ in g if i is not None), default=None): sorted((str(i) for i, _ in g)) for g in brute(rows)}
    assert {k: sorted(map(str, v)) for k, v in got.items()} == want
    kept = op.without_copies(df.withColumnRenamed("comp", "near_h"))
    assert kept.columns == ["doc_id", "text", "h", "near_h"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, want))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert op.classes(df).count() == 0 and op.without_copies(df).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 400), rng.randrange(100, 400)) for _ in range(200)] + [(500, i) for i in range(501, 600)]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.h: r.comp for r in op.components(df, common.work_dir(spark, "t") + "/c").collect()}
    up = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {x: find(x) for x in up}
