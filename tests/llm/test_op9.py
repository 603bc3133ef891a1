import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from colstate.llm import op9_suffix_dedup as op


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.binary(min_size=1, max_size=60), st.text("ab", min_size=1, max_size=80).map(str.encode)), min_size=1, max_size=6))
def test_suffix_array(segments):
    wide, order = op.suffix_array(segments)
    x = wide.tolist()
    assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    prefix = op.common_prefixes(wide, order)
    for a, b in zip(order.tolist(), order.tolist()[1:]):
        k = 0
        while a + k < len(x) and b + k < len(x) and x[a + k] == x[b + k]:
            k += 1
        assert prefix[b] == k
    assert prefix[order[0]] == 0


def test_longer_array():
    rng = random.Random(4)
    part = bytes(rng.randrange(256) for _ in range(700))
    segments = [part, b"a" * 500, part[100:] + b"!", b"ab" * 300, part] + [bytes(rng.choices(b"acgt", k=600)) for _ in range(8)]
    wide, order = op.suffix_array(segments)
    x = wide.tolist()
    assert order.tolist() == sorted(range(len(x)), key=lambda i: x[i : i + 1500])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=500).map(str.encode), max_size=5), st.integers(130, 160))
def test_runs_cover_all_windows(texts, length):
    t, p0, p1, key = op.runs_of(texts, length)
    seen = sorted((int(i), p) for i, a, b in zip(t, p0, p1) for p in range(a, b + 1))
    assert seen == [(i, p) for i, x in enumerate(texts) for p in range(len(x) - length + 1)]
    of = {}
    for i, a, b, k in zip(t, p0, p1, key):
        for p in range(a, b + 1):
            w = texts[i][p : p + length]
            assert of.setdefault(w, k) == k  # equal windows, equal keys


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzé ", k=7))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long = text(70), text(900)
    rows = [(1, text(40) + shared + text(30)), (2, shared), (3, text(9) + shared[20:] + text(5)), (4, None), (5, ""), (6, long), (7, long),
            (8, long[:4000] + "X" + long[4000:]), (9, "z" * 1500), (10, "ab" * 240 + text(3)), (None, shared + text(60)), (11, text(200)),
            (12, shared[:399]), (13, shared[:400]), (14, "short"), (15, "short"), (16, text(5) + (q := text(80)) + "--" + q), (7, long), (17, "é" * 450)]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot_runs": 2}, {"shard_bytes": 1000}, {"length": 140}])
def test_against_all_windows(spark, options):
    rows = corpus()
    want = op.brute_force([(t or "").encode() for _, t in rows], options.get("length", op.LENGTH))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id bigint, text string, h int, key string")
    got = op.deduplicate(df, **options)
    exp = []
    for (i, t), spans in zip(rows, want):
        data, at, kept = (t or "").encode(), 0, b""
        for s, e in spans:
            kept, at = kept + data[at:s], e
        kept += data[at:]
        exp.append((i, len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    rows_out = [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in op.digests(got).collect()]
    assert sorted(rows_out, key=str) == sorted(exp, key=str)


def test_empty(spark):
    assert op.deduplicate(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_long_text():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, op._BLOCK + 5000).astype(np.uint8).tobytes()
    t, p0, p1, _ = op.runs_of([data])
    assert (p1 - p0 + 1).sum() == len(data) - op.LENGTH + 1
