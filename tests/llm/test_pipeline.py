import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from colstate.llm import common, op5_bagminhash, op7_decontamination, queries, tokenizer

from .test_op5 import like, multiset

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = common.table(spark, SF, "documents")
    out, work = [docs], common.work_dir(spark, "test-pipeline")
    for name, stage in cp.STAGES:
        out.append(common.written(stage(spark, out[-1], SF), f"{work}/{name}"))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_columns_and_counts(stages):
    for df in stages[:5]:
        assert df.columns == stages[0].columns
    for before, after in zip(stages[:3], stages[1:4]):
        assert not rows(after) - rows(before) and after.count()


def test_quality_keeps_the_clean(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = common.table(spark, SF, "labels").collect()
    clean = [r.doc_id in kept for r in labels if r.quality and not r.toxic]
    assert sum(clean) >= 0.97 * len(clean)


def test_one_of_each_group_stays(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    after = {r.doc_id for r in stages[2].collect()}
    sets = {i: multiset(t) for i, t in before}
    for i, _ in before:  # what went has a chain of near copies to one that stayed; none that stayed are near
        if i in after:
            assert not any(like(sets[i], sets[j]) >= 0.8 for j in after if j != i)
        else:
            assert any(like(sets[i], sets[j]) >= 0.8 for j in sets if j != i)


def test_decontaminated(spark, stages):
    judged = op7_decontamination.decontaminate(stages[2], common.table(spark, SF, "benchmark"))
    assert {r.doc_id for r in stages[3].collect()} == {r.doc_id for r in judged.where("n_hit = 0").collect()}


def test_mixture(stages):
    have, mixed = rows(stages[3]), rows(stages[4])
    assert set(mixed) <= set(have) and max(mixed.values()) <= 2
    n = lambda c: sum(len(r[1].split()) * k for r, k in c.items())
    assert 0.5 * n(have) < n(mixed) <= 0.9 * n(have)  # a leaf's prefix ends up to a document early, and leaves are small here


def test_ids(stages):
    lib, at, want = tokenizer.Encoder(queries.definition()).library, 0, []
    for r in sorted(stages[4].collect(), key=lambda r: (r.doc_id, r.text)):
        ids = np.array([*lib.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in stages[5].collect()), key=lambda r: r[1]) == want


def test_empty(spark):
    docs = common.table(spark, SF, "documents").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
    assert op5_bagminhash.HUBS
