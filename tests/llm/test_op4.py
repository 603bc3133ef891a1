import pytest
from pyspark.sql import functions as F

from colstate.llm import op4_quality as op

SF = "/root/testdata/sf0.1"


def test_held_out(spark):
    """Fitted on a part of the labelled documents, judged on the others."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    test = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 1)
    model = op.fit(docs, train)
    rows = op.score(docs, model).join(test, "doc_id").select("quality", "toxic", "q_quality", "q_toxic", "q_keep").collect()
    right = sum((r.q_quality >= 0.5) == (r.quality > 0) for r in rows) / len(rows)
    rude = sum((r.q_toxic >= 0.5) == (r.toxic > 0) for r in rows) / len(rows)
    clean = [r.q_keep for r in rows if r.quality and not r.toxic]
    foul = [r.q_keep for r in rows if not r.quality or r.toxic]
    print(len(rows), right, rude, sum(clean) / len(clean), sum(foul) / len(foul))
    assert right > 0.97 and rude > 0.97
    assert sum(clean) / len(clean) > 0.98 and sum(foul) / len(foul) < 0.1


DOCS = [(1, "Plain words were written in a row.", "a", "en"), (2, None, "a", None), (3, "", None, "en"), (4, "x " * 50000, "b", "en"),
        (None, "No id here at all", "a", "en"), (4, "x " * 50000, "b", "en"), (5, "!!! ???", "c", "fr")]
KIND = "doc_id bigint, text string, source string, lang string"


def test_odd_rows(spark):
    docs = spark.createDataFrame(DOCS, KIND).withColumn("s", F.lit("clash"))
    for labels in ([(1, 1, 0), (4, 0, 0), (4, 1, 0), (99, 1, 1), (None, 0, 0), (2, None, 0)], []):
        model = op.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        out = op.score(docs, model, broadcast_bytes=0)
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert len(rows) == len(DOCS)
        for r in rows:
            assert 0 < r.q_quality < 1 and 0 <= r.q_toxic <= 1 and (r.q_document is None) == (r.doc_id in (2, 3, 5))
            if not labels:
                assert r.q_quality == pytest.approx(0.5) and r.q_keep
    assert op.score(docs.limit(0), model).count() == 0
    light = op.score(docs, model, with_text=False)
    assert "text" not in light.columns
    cols = [c for c in light.columns if c != "text"]
    assert sorted(map(str, light.select(cols).collect())) == sorted(map(str, op.score(docs, model).select(cols).collect()))


def test_sites_shrink(spark):
    """Many bad documents of a site pull down a doubtful one there; a site of one has no say of its own."""
    rows = [(i, "bad BAD !! $$ %% " * 9 + f"w{i}", "low", "en") for i in range(60)] + [(100 + i, f"Fine words stand here, number {i}.", "high", "en") for i in range(60)]
    doubtful = "Fine words stand here, BAD !! $$ %% bad"
    rows += [(900, doubtful, "low", "en"), (901, doubtful, "high", "en"), (902, doubtful, "alone", "en")]
    docs = spark.createDataFrame(rows, KIND)
    labels = spark.createDataFrame([(i, 0, 0) for i in range(30)] + [(100 + i, 1, 0) for i in range(30)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in op.score(docs, op.fit(docs, labels)).collect()}
    assert got[900].q_document == got[901].q_document == got[902].q_document
    assert got[900].q_quality < got[902].q_quality < got[901].q_quality
    assert got[902].q_site == pytest.approx(sum(r.q_document for r in got.values()) / len(got), abs=0.02)
