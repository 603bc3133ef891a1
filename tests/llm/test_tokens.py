import itertools
import subprocess
import sys

import pytest
import public_tokenizers
from array import array
from hypothesis import given, settings, strategies as st

from colstate.llm import op1_token_counts as op1, tokenizer

DEF = tokenizer.definition(public_tokenizers.path("byte_bpe_50k.json"))
ENC = tokenizer.Encoder(DEF)
CHARS = st.one_of(
    st.characters(max_codepoint=0x24F),
    st.sampled_from(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  ''sdtmrvel1²½ªµ.,!–’€"),
    st.characters(exclude_categories=["Cs"]),
)


@settings(max_examples=600, deadline=None)
@given(st.text(CHARS, max_size=60))
def test_ids_are_the_librarys(text):
    want = ENC.library.encode(text, add_special_tokens=False).ids
    assert array("I", ENC.ids(text)).tolist() == want


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "<|endoftext|>", "x<|endoftext|> y", "\n\n\nfoo", "'s's 's", "a" * 70000])
def test_ids_fixed(text):
    assert array("I", ENC.ids(text)).tolist() == ENC.library.encode(text, add_special_tokens=False).ids


def test_cache(spark, tmp_path):
    texts = [None, "", "hello world", "hello world", "zwölf <|endoftext|> é", "x " * 1100]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "hello world", "c"), (2, "hello world", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string")
    cache = f"file://{tmp_path}/cache"
    want = sorted(
        ((i, len((t or "").encode()), len(ENC.library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows), key=str
    )
    for _ in range(2):
        got = op1.count_tokens(df, DEF, cache).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
        kept = spark.read.parquet(cache)
        assert kept.count() == kept.select("digest").distinct().count() == 4  # only distinct misses, once
    assert op1.count_tokens(df.limit(0), DEF, f"file://{tmp_path}/none").count() == 0


def test_memo_forgets():
    enc = tokenizer.Encoder(DEF)
    enc.pieces.most = 5
    texts = [" ".join(f"w{(i * k) % 23}x," for i in range(30)) + "\n y" * (k % 3) for k in range(40)] + ["", "日本", "<|endoftext|>"]
    for got in (enc.batch(texts), enc.batch(texts[::-1])[::-1], [enc.batch([t])[0] for t in texts]):
        assert [g.tolist() for g in got] == [enc.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_a_batch():
    """Texts of one batch don't touch each other's pieces, long pieces and odd texts among them."""
    texts = ["it's", "'s", "", " ", "a  ", "\n b", "s 'tis we'll'd'x ''s 1's", "é" * 63, "é" * 64, "é" * 65, "é" * 64 + "e", " " * 200 + "x", "日本 's", "a￿b", "😀's", "<|endoftext|>", "x" * 300, "x" * 300]
    enc = tokenizer.Encoder(DEF)
    for order in (texts, texts[::-1], texts * 3):
        assert [g.tolist() for g in enc.batch(order)] == [enc.library.encode(t, add_special_tokens=False).ids for t in order]
    assert enc.batch([]) == []


def test_a_worker_remembers_half_a_million_pieces():
    enc, asked = tokenizer.Encoder(DEF), []
    plain = enc._encode
    enc._encode = lambda pieces: asked.append(len(pieces)) or plain(pieces)
    words = [" " + "".join(x) for x in itertools.islice(itertools.product("abcdefghijklmnop", repeat=5), 500_000)]
    text = ["".join(words[i : i + 10_000]) for i in range(0, len(words), 10_000)]
    first = [x.tolist() for x in enc.batch(text)]
    assert sum(asked) == 500_000
    assert [x.tolist() for x in enc.batch(text)] == first and sum(asked) == 500_000


_GROWTH = """
import itertools, re, sys
from colstate.llm import tokenizer

def mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", f.read()))) / 1024

enc = tokenizer.encoder("a", tokenizer.definition(sys.argv[1]))
enc.batch(["to begin with"])
before = most = mb()
words = itertools.product("abcdefghijklmnop", repeat=5)
while text := "".join(" " + "".join(w) for w in itertools.islice(words, 2_500)):
    enc.batch([text])
    most = max(most, mb())
print(most - before)
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_workers_memory_has_a_bound():
    """The memory that 1,048,576 different words take, more than an encoder remembers."""
    run = [sys.executable, "-c", _GROWTH, public_tokenizers.path("byte_bpe_50k.json")]
    assert float(subprocess.run(run, capture_output=True, text=True, check=True).stdout) < 60
