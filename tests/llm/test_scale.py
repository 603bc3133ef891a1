"""Ranges, hot keys, independent recomputations and damaged files."""

import math
import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from colstate.llm import common, op1_token_counts, op2_line_dedup, op3_mixing, op4_quality, op5_bagminhash, op6_warc, op9_suffix_dedup, queries
from colstate.llm import op10_fingerprints as op10

SF = "/root/testdata/sf0.001"


# ranges -----------------------------------------------------------------------------------------


def test_ranges_hold_equal_bytes_even_of_one_id(spark):
    """Half of the rows have the same id, a tenth none; a few rows have most of the bytes."""
    rows = [(7 if i % 2 else None if i % 10 == 0 else i * i, f"{i * 7919 % 10007:05d}" + "x" * (3000 if i % 97 == 0 else 20)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    at = common.place(F.col("doc_id"), common.beginning(F.col("text"))).alias("at")
    size = F.octet_length("text").alias("nbytes")
    ranges = common.ranges_of(df.select(at, size), 10_000)
    assert common.ranges_of(df.repartition(5, "text").select(at, size), 10_000).ends == ranges.ends
    got = df.select("doc_id", "text", at, size).withColumn("r", ranges.of(F.col("at"))).select("doc_id", "text", "nbytes", "r.*").collect()
    total = sum(r.nbytes for r in got)
    by = {}
    for r in got:
        by[r.part] = by.get(r.part, 0) + r.nbytes
    assert set(by) == set(range(len(ranges))) and 0.7 < len(ranges) / (total / 10_000) < 1.4
    assert max(by.values()) < 25_000
    order = sorted(got, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text))
    assert [r.part for r in order] == sorted(r.part for r in got)
    ends = [r for r in got if r.last]
    assert sorted(r.part for r in ends) == list(range(len(ranges) - 1))
    assert len({r.part for r in got if r.doc_id == 7}) > 3 and len({r.part for r in got if r.doc_id is None}) > 1
    least = spark.createDataFrame([(-(1 << 63), "a"), (None, "z"), (None, "b"), (3, "")], "doc_id bigint, text string").withColumn("at", at).orderBy("at")
    assert [r.text for r in least.collect()] == ["b", "z", "a", ""]


def test_one_id_for_most_rows(spark):
    """op10 and op6 give the same whatever the ranges, which end within the id."""
    rows = [(5, f"text number {i} " * (i % 7 + 1)) for i in range(60)] + [(1, "first"), (9, "last"), (None, "none")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(map(tuple, op10.edited_likeness(df, bytes_per_range=1 << 20).collect()), key=str)
    assert sorted(map(tuple, op10.edited_likeness(df, bytes_per_range=300).collect()), key=str) == want
    assert all(r[1:4] for r in want) and len(want) == len(rows)


# hot keys ---------------------------------------------------------------------------------------


@pytest.fixture
def splitting(spark):
    new = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_hot_keys_are_split(spark, splitting):
    df = spark.createDataFrame([(i, "the same text of all" if i % 2 else f"text {i}") for i in range(3000)], "doc_id bigint, text string").repartition(6)
    counted = op1_token_counts.count_tokens(df, queries.definition(), common.work_dir(spark, "t") + "/cache")
    rows, plan = final_plan(counted)
    assert len(rows) == 3000 and "skew=true" in plan
    rows, plan = final_plan(op2_line_dedup.deduplicate(df))
    assert sum(r.n_removed for r in rows) == 1499 and "skew=true" in plan


def test_hot_passage(spark):
    """A passage in more runs than a shard may hold: windows by hash, with the same result as by suffix arrays."""
    passage = "".join(f"{i * 7919 % 1009} " for i in range(140))
    df = spark.createDataFrame([(i, f"{i * 31} head " * 5 + passage + f" tail {i * 17}" * 9) for i in range(40)] + [(99, passage[:450])], "doc_id bigint, text string")
    columns = ("doc_id", "n_removed", "n_spans", "kept")
    want = sorted(tuple(r) for r in op9_suffix_dedup.deduplicate(df).select(*columns).collect())
    assert sorted(tuple(r) for r in op9_suffix_dedup.deduplicate(df, hot_runs=10).select(*columns).collect()) == want
    spans = op9_suffix_dedup.brute_force([r.text.encode() for r in df.orderBy("doc_id").collect()])
    assert [r[1] for r in want] == [sum(e - s for s, e in x) for x in spans] and min(r[1] for r in want) >= 400


def test_texts_that_agree_in_half_of_their_hash(spark):
    """With a first half of two bits, nodes are still told apart, and classes are the same."""
    docs = common.table(spark, SF, "documents")
    rows = lambda **how: sorted((r.doc_id, r.class_id, r.class_size, r.keep) for r in op5_bagminhash.classes(docs, **how).collect())
    assert rows(first_half=lambda text: F.pmod(F.xxhash64(text), F.lit(4))) == rows()


# independent recomputations ------------------------------------------------------------------------


def mix64(x):
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def slots_by_hand(text):
    """Phrases as strings, hashed character by character; the least hash of each class, shortened."""
    m, found, w = (1 << 64) - 1, set(), ""
    for c in text:
        w += c
        if w not in found:
            found.add(w)
            w = ""
    least = {}
    for p in found:
        h = 0
        for c in p:
            h = mix64((h * 0x9E3779B97F4A7C15 + mix64(ord(c) + 0x5851F42D4C957F2D)) & m)
        h = mix64(h + 1 & m)
        least[h % 128] = min(least.get(h % 128, m), h)
    return [(mix64(least[k] ^ 0xA5A5A5A5A5A5A5A5) >> 48) % 0xFFFF if k in least else 0xFFFF for k in range(128)]


def alike(a, b):
    filled = [(x, y) for x, y in zip(a, b) if (x, y) != (0xFFFF, 0xFFFF)]
    return sum(x == y for x, y in filled) / len(filled) if filled else 1.0


def test_fingerprints_by_hand(spark):
    docs = common.table(spark, SF, "documents").limit(40).unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "né 😀 né 😀 né")], "doc_id bigint, text string"), allowMissingColumns=True)
    docs = common.written(docs, common.work_dir(spark, "t") + "/docs")
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    got = {r.doc_id: r for r in op10.edited_likeness(docs).collect()}
    for k, (i, text) in enumerate(rows):
        donor = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + donor[:cut]
        a, b, c = slots_by_hand(text), slots_by_hand(edited), slots_by_hand(donor)
        assert got[i].fingerprint == "".join(f"{x:04x}" for x in a) and got[i].edited_fingerprint == "".join(f"{x:04x}" for x in b)
        assert got[i].near_edited == pytest.approx(alike(a, b)) and got[i].near_next == pytest.approx(alike(a, c))


def test_site_posteriors_by_hand(spark):
    docs, labels = common.table(spark, SF, "documents"), common.table(spark, SF, "labels")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, None, "src1"), (-2, "!!", "en", None)], "doc_id bigint, text string, lang string, source string"), allowMissingColumns=True)
    rows = op4_quality.score(docs, op4_quality.fit(docs, labels)).collect()
    site, host, all_ = {}, {}, [0.0, 0]
    for r in rows:
        for where, key in ((site, (r.source or "", r.lang or "")), (host, r.source or "")):
            x = where.setdefault(key, [0.0, 0])
            if r.q_document is not None:
                x[0] += r.q_document
                x[1] += 1
        if r.q_document is not None:
            all_[0] += r.q_document
            all_[1] += 1
    m = min(max(all_[0] / all_[1], 0.01), 0.99)

    def strength(rates):
        """((sum, n), centre) of each site: what spreads beyond the noise of sampling."""
        n = sum(x[1] for x, _ in rates)
        ps = [((x[0] + 0.5 * m) / (x[1] + 0.5), x[1], c) for x, c in rates if x[1]]
        spread = sum(k * (p - c) ** 2 for p, k, c in ps) / n
        noise = sum(p * (1 - p) for p, _, _ in ps) / n
        return min(max(m * (1 - m) / max(spread - noise, 1e-12) - 1, 1.0), 1e6)

    k_host = strength([(x, m) for x in host.values()])
    centre = lambda h: (host[h][0] + k_host * m) / (host[h][1] + k_host)
    k_path = strength([(x, centre(key[0])) for key, x in site.items()])
    logit = lambda p: math.log(p / (1 - p))
    for r in rows:
        own, one = (r.q_document, 1) if r.q_document is not None else (0.0, 0)
        h, s = host[r.source or ""], site[r.source or "", r.lang or ""]
        of_host = (h[0] - own + k_host * m) / (h[1] - one + k_host)
        rate = min(max((s[0] - own + k_path * of_host) / (s[1] - one + k_path), 0.01), 0.99)
        good = min(max(m if r.q_document is None else r.q_document, 1e-9), 1 - 1e-9)
        odds = logit(good) + logit(rate) - logit(m)
        assert r.q_site == pytest.approx(rate, rel=1e-6) and r.q_quality == pytest.approx(1 / (1 + math.exp(-odds)), rel=1e-6)
        assert r.q_keep == (r.q_quality >= 0.5 and r.q_toxic < 0.5)


def test_own_column_names(spark):
    """Columns named like those that the classifier adds are replaced, others of any name stay."""
    docs = spark.createDataFrame([(1, "Fine words stand here.", "a", "en", 5, "x", 7), (2, None, None, None, 6, "y", 8)], "doc_id bigint, text string, source string, lang string, q_keep int, row string, q_host int")
    model = op4_quality.fit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int"))
    out = op4_quality.score(docs, model)
    assert out.columns[:6] == ["doc_id", "text", "source", "lang", "row", "q_host"] and dict(out.dtypes)["q_keep"] == "boolean"
    assert {(r.doc_id, r.row, r.q_host) for r in out.collect()} == {(1, "x", 7), (2, "y", 8)}


@pytest.mark.parametrize("rows", [4096, 3])
def test_prefix_is_found_in_steps(spark, rows):
    """A leaf's prefix is the same however fine the classes are in which it is sought; tokens may come from a table."""
    docs = common.table(spark, SF, "documents")
    counts = docs.select(F.unhex(F.sha2("text", 256)).alias("digest"), op3_mixing.tokens_of().alias("n_tokens")).distinct()
    weights, domains = op3_mixing.production_weights(), op3_mixing.DOMAINS
    key = lambda df: sorted((r.doc_id, r.mix_epoch) for r in df.collect())
    want = key(op3_mixing.mix(docs, weights, domains, total=0.6, class_bits=12))
    assert want and key(op3_mixing.mix(docs, weights, domains, total=0.6, class_bits=2, class_rows=rows, counts=counts)) == want


# files ------------------------------------------------------------------------------------------


def test_a_changed_byte_of_an_archive_is_found(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "<p>page</p>" * i) for i in range(30)], "page_id bigint, url string, html string")
    op6_warc.write_warc(pages, f"file://{tmp_path}/w")
    name = next(n for n in sorted(os.listdir(tmp_path / "w")) if n.endswith(".gz"))
    data = bytearray((tmp_path / "w" / name).read_bytes())
    assert op6_warc.read_warc(spark, f"file://{tmp_path}/w").count() == 30
    data[9] ^= 1  # the operating system in the first member's header: still a readable archive
    (tmp_path / "w" / name).write_bytes(data)
    with pytest.raises(Exception, match="isn't the file"):
        op6_warc.read_warc(spark, f"file://{tmp_path}/w").collect()


def test_members_in_small_blocks():
    import gzip

    parts = [os.urandom(n) for n in (0, 5, 20_000, 1, 300)]
    data = b"".join(gzip.compress(p) for p in parts)
    for step in (1, 7, 1 << 14):
        assert list(op6_warc.members([data[i : i + 1000] for i in range(0, len(data), 1000)], step)) == parts
    with pytest.raises(ValueError):
        list(op6_warc.members([data[:-3]]))


def test_schemes():
    assert common.filesystem("file:///a/b")[1] == "/a/b" and common.filesystem("/a/b")[1] == "/a/b"
    assert common._SCHEMES["s3a"] == "s3"


# the pipeline -------------------------------------------------------------------------------------


ODD = [(1, None, None, None), (2, "", "en", "src1"), (3, "Plain words were written here, one after the other, about a garden.", "en", "src1"),
       (3, "Plain words were written here, one after the other, about a garden.", "en", "src1"), (4, "Plain words were written here, one after the other, about a garden.", "de", "src2"),
       (None, "No id here, but whole sentences about rivers and hills.", "xx", "elsewhere"), (5, "x " * 60000, "en", "src3")]


def test_stages_with_odd_rows(spark):
    docs = common.table(spark, SF, "documents").limit(60)
    odd = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string")
    docs = docs.unionByName(odd, allowMissingColumns=True)
    for name in ("h", "row", "q_keep", "mix_leaf", "near_doc", "hit_h", "digest", "n"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))))
    work = common.work_dir(spark, "odd")
    now = common.written(docs, f"{work}/0")
    for name, stage in cp.STAGES:
        out = common.written(stage(spark, now, SF), f"{work}/{name}")
        if name != "token_ids":
            assert out.columns == docs.columns
            rows, before = out.collect(), {tuple(r) for r in now.collect()}
            assert {tuple(r) for r in rows} <= before and rows
        if name == "near_duplicates":
            texts = [r.text or "" for r in rows]
            assert len(texts) == len(set(texts))
        now = out
    assert now.count() >= 1 and now.where("n_tokens < 1").count() == 0


def test_run(spark):
    assert cp.run(spark, SF).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
