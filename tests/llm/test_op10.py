import hashlib

from colstate.llm import op10_fingerprints as op


def brute(rows, slots=op.SLOTS):
    """By the contract's words: fingerprints of every whole and edited text, one by one."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    out = []
    for i, (doc, text) in enumerate(order):
        text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + nxt[:k]
        prints = [_simple(t) for t in (text, edited, nxt)]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), op.fingerprint(text), op.fingerprint(edited),
                    _like(prints[0], prints[1]), _like(prints[0], prints[2])))
    return out


def phrases(text):
    found, w = set(), ""
    for c in text:
        w += c
        if w not in found:
            found.add(w)
            w = ""
    return found


def _simple(text):
    import numpy as np

    f = op.fingerprint(text)
    return np.frombuffer(bytes.fromhex(f), ">u2").astype("u2")


def _like(a, b):
    return op.likeness(a, b)


TEXTS = [None, "", "a", "abab" * 40, "the cat sat on the mat " * 9, "the cat sat on the hat " * 9, "né à l'école 😀😀" * 5, "z" * 5000]


def test_phrases():
    for t in TEXTS:
        p = op.Parse()
        p.feed(t or "")
        assert len(p.phrases) == len(phrases(t or ""))
        h = op.phrase_hashes(p.phrases)
        assert len(set(h.tolist())) == len(h)


def test_against_brute_force(spark):
    rows = [(i * 7 % 31, t) for i, t in enumerate(TEXTS * 2)] + [(3, "tie"), (3, "tie"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, part int")
    want = sorted(brute(rows), key=str)
    for size in (1 << 20, 300):
        got = op.edited_likeness(df, bytes_per_range=size).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert op.edited_likeness(df.limit(0)).count() == 0


def test_likeness_follows_phrase_sets():
    a, b = "the cat sat on the mat and looked around " * 30, "completely other words were written here " * 30
    x, y = _simple(a), _simple(b)
    assert op.likeness(x, x) == 1 and op.likeness(x, y) < 0.5
    assert op.likeness(_simple(""), x) == 0
