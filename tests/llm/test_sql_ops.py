"""Operators that SQL can express, against SQL and small fixtures with the odd cases."""

import os

import pyarrow as pa
import pytest

from colstate.llm import op2_line_dedup, op6_warc, op7_decontamination, queries

from .helpers import spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    want = sql_rows(queries.ORACLES[name], **{t: f"{SF}/{t}.parquet" for t in TABLES})
    assert spark_rows(queries.QUERIES[name](spark, SF)) == want


DOCS = [
    (1, "a b c\nShared line\nother", "x"),
    (2, "shared   LINE\n\n\nown\nown", "x"),
    (3, None, None),
    (4, "", "x"),
    (None, "Shared line\nnull id's line", "x"),
    (5, "shared line", "x"),
    (6, "é\tShared\tline \n" * 3, "x"),
    (5, "shared line", "x"),
]


def test_lines(spark):
    df = spark.createDataFrame(DOCS, "doc_id bigint, text string, h string")
    got = {(r.doc_id, r.n_units, r.n_removed, r.removed_spans, r.kept_text) for r in op2_line_dedup.deduplicate(df).collect()}
    assert got == {
        (1, 3, 0, "", "a b c\nShared line\nother"),
        (2, 5, 2, "0-13,20-23", "\n\nown"),
        (3, 1, 0, "", ""),
        (4, 1, 0, "", ""),
        (None, 2, 1, "0-11", "null id's line"),
        (5, 1, 1, "0-11", ""),
        (6, 4, 2, "15-29,30-44", "é\tShared\tline \n"),
    }
    rows = {r.doc_id: r for r in op2_line_dedup.deduplicate(df).collect()}
    assert [tuple(o) for o in rows[2].kept_offsets] == [(14, 14), (15, 15), (16, 19)]
    assert op2_line_dedup.deduplicate(df.limit(0)).count() == 0
    by_paragraph = op2_line_dedup.deduplicate(df, separator=op2_line_dedup.PARAGRAPHS)
    assert by_paragraph.where("doc_id = 2").first().n_units == 2


def test_lines_equal_sql_on_odd_letters(spark):
    """Capital sigma at the end of a word and capital i with a dot: each letter's lower case doesn't depend on its neighbours."""
    texts = ["ΟΔΟΣ ΑΘΗΝΑΣ\nİZMİR", "οδοσ αθηνασ\nizmir\nown", "οδος αθηνας\ni\u0307zmi\u0307r", "Οδοσ  Αθηνασ \r\nIZMIR", "É 🇩🇪\x1cΣ\n\u00a0x", "é 🇩🇪\x1cσ\n\u00a0X"]
    rows = [(i, t) for i, t in enumerate(texts, 1)]
    got = spark_rows(op2_line_dedup.digests(op2_line_dedup.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string"))))
    documents = pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    assert got == sql_rows(op2_line_dedup.ORACLE, documents=documents)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_windows(spark, limit):
    long = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, long), (10, "Short item"), (2, None), (3, ""), (None, "NO ID here"), (11, long + " thirteen"), (1, long)]
    docs = [
        (1, f"x {long.upper()}! y", 0),
        (2, "one two three short, ITEM short item", 0),
        (3, None, 0),
        (4, "", 0),
        (None, "no id here short item", 0),
        (5, "item short " * 50, 0),
        (5, "item short " * 50, 0),
        (6, "nine ten eleven twelve thirteen", 0),
        (7, "Straße é1 " * 3 + long + " thirteen", 0),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, w int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = spark_rows(op7_decontamination.decontaminate(d, i, broadcast_bytes=limit))
    as_table = lambda rows, names: pa.table({n: [r[k] for r in rows] for k, n in enumerate(names)})
    # SQL has one row a doc_id, so ties and null ids are looked at apart
    plain = [r for r in docs if r[0] is not None][:-1][:5] + [docs[7], docs[8]]
    want = sql_rows(
        op7_decontamination.ORACLE,
        documents=as_table(plain, ["doc_id", "text", "w"]),
        benchmark=as_table([x for x in items if x[0] is not None], ["item_id", "text"]),
    )
    cols = sorted(["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
    at = cols.index("doc_id")
    assert sorted({r for r in got if r[at] is not None}, key=str) == sorted(want, key=str)
    assert len(got) == len(docs)
    none = dict(zip(cols, next(r for r in got if r[at] is None)))
    assert (none["n_hit"], none["n_items"], none["n_words"]) == (5, 1, 5)
    assert all(not r[cols.index("contaminated")] for r in spark_rows(op7_decontamination.decontaminate(d, i.limit(0), broadcast_bytes=limit)))
    assert op7_decontamination.decontaminate(d.limit(0), i, broadcast_bytes=limit).count() == 0
    left = op7_decontamination.clean(d.withColumnRenamed("w", "hit_h"), i, broadcast_bytes=limit)
    assert left.columns == ["doc_id", "text", "hit_h"]
    assert sorted(r.doc_id for r in left.collect()) == sorted(
        r[cols.index("doc_id")] for r in got if not r[cols.index("contaminated")]
    )


def test_warc(spark, tmp_path):
    big, small = "<p>é</p>" * 400, "<p>tiny</p>"
    pages = [(5, "http://a/\r\nx", big), (9, "http://b", big), (7, None, big), (1, "u", small), (2, "u", small), (3, "u", None),
             (4, "u", ""), (None, "n", big), (9, "http://c", big), (8, "z", "q" * 3_000_000), (None, "u", "w" * 2000), (None, "v", "w" * 2000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, sha1 string")
    for k, size in enumerate((1 << 20, 4000)):
        root = f"file://{tmp_path}/w{k}"
        rows = [tuple(r) for r in op6_warc.written_pages(df, root, range_bytes=size, roll_bytes=size // 8).collect()]
        kinds = sorted(((r[0], r[3], r[4]) for r in rows), key=str)
        assert kinds == sorted([(5, "revisit", 9), (9, "response", None), (7, "revisit", 9), (1, "response", None), (2, "response", None),
                         (3, "response", None), (4, "response", None), (None, "revisit", 9), (9, "revisit", 9), (8, "response", None),
                         (None, "response", None), (None, "revisit", None)], key=str)
        assert {r[1] for r in rows if r[0] in (3, 4)} == {0}
    # the same bytes a second time
    op6_warc.write_warc(df.repartition(3), f"file://{tmp_path}/again", range_bytes=4000, roll_bytes=500)
    for name in sorted(os.listdir(tmp_path / "w1")):
        assert (tmp_path / "w1" / name).read_bytes() == (tmp_path / "again" / name).read_bytes()
    assert op6_warc.written_pages(df.limit(0), f"file://{tmp_path}/none").count() == 0
    name = sorted(os.listdir(tmp_path / "w0"))[-1]
    data = (tmp_path / "w0" / name).read_bytes()
    (tmp_path / "w0" / name).write_bytes(data[: len(data) // 2])
    with pytest.raises(Exception):
        op6_warc.read_warc(spark, f"file://{tmp_path}/w0").collect()
