import zlib

import numpy as np
import public_tokenizers
import pytest

from colstate.llm import op8_token_store as op, tokenizer

DEF = tokenizer.definition(public_tokenizers.path("byte_bpe_50k.json"))
LONG = " ".join(f"word{i % 977} is number {i}" for i in range(4000))
DOCS = [(5, LONG), (3, LONG + " tail"), (9, "head " + LONG), (1, None), (2, ""), (None, "no id"), (7, "short"), (7, "a tie"), (8, "short"), (4, "a" * 9000)]


@pytest.mark.parametrize("size", [1 << 20, 2000])
def test_round_trip(spark, tmp_path, size):
    root = f"file://{tmp_path}/store"
    df = spark.createDataFrame([(*d, "clash") for d in DOCS], "doc_id bigint, text string, part string")
    m = op.write_store(df, DEF, root, shard_bytes=size)
    assert op.write_store(df.repartition(3), DEF, f"file://{tmp_path}/two", shard_bytes=size)["root"] == m["root"]
    lib = tokenizer.Encoder(DEF).library
    at, want = 0, []
    for doc_id, text in sorted(DOCS, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or "")):
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in op.read_store(spark, root).collect()), key=lambda r: r[1]) == want
    stored = sum(p.stat().st_size for p in (tmp_path / "store" / "packs").iterdir())
    assert stored < 0.6 * at * 2  # three copies of LONG share most chunks, within and across shards
    assert not (tmp_path / "store" / "spool").exists()


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    op.write_store(df, DEF, f"file://{tmp_path}/s")
    pack = max((tmp_path / "s" / "packs").iterdir(), key=lambda p: p.stat().st_size)
    data = bytearray(pack.read_bytes())
    data[100] ^= 1
    pack.write_bytes(data)
    with pytest.raises(Exception, match="damaged"):
        op.read_store(spark, f"file://{tmp_path}/s").collect()


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    op.write_store(df, DEF, f"file://{tmp_path}/e")
    assert op.read_store(spark, f"file://{tmp_path}/e").count() == 0


def test_cuts_follow_content():
    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype("<u4")
    a, b = set(op.cuts(ids)), {c - 777 for c in op.cuts(np.concatenate([ids[:777], ids]))}
    assert len(a & b) > 0.9 * len(a)
    assert max(np.diff([0, *op.cuts(np.zeros(20000, "<u4"))])) <= op.LONGEST
    assert op.cuts(ids)[-1] == len(ids) and op.merkle([]) and op.merkle([b"a"]) == b"a"
