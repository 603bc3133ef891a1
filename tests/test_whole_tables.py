"""Queries that take every row of their tables."""

import hashlib
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colstate.functions import text
from colstate.operators import processors
from colstate.plans import catalogue
from colstate.plans.engine import Engine
from colstate.plans.model import parse

SF = "/root/testdata/sf0.001"


def test_every_vector_is_encoded(spark):
    thousand = np.float32(1000)
    rows = catalogue.load(spark, SF, "embeddings").collect()
    want = {r.vec_id: [int(np.floor(np.float32(x) * thousand)) for x in r.embedding] for r in rows}
    got = [(r.vec_id, json.loads(r.encoded)) for r in catalogue.QUERIES["json_encode_list_whole"](spark, SF).collect()]
    assert len(got) == len(rows) and dict(got) == want


def test_every_repo_is_converged(spark):
    clean = lambda name: "".join(w.capitalize() for w in re.findall("[A-Za-z]+|[^A-Za-z]+", name.strip()))
    parts = {r.p_partkey: clean(r.p_name) for r in catalogue.load(spark, SF, "part").collect()}
    last = {}
    for key in sorted(parts):
        last[parts[key].lower()] = str(key)
    want = sorted((key, name, last[name.lower()], "people,repos") for key, name in parts.items())
    got = catalogue.QUERIES["converge_all_order_whole"](spark, SF).select("p_partkey", "cleaned_name", "linkedin_match", "run_order")
    assert sorted(map(tuple, got.collect())) == want


def plans_of(monkeypatch):
    """The plans by which levels are computed from now on."""
    plans, computed = [], Engine.computed

    def noted(self, *a):
        out = computed(self, *a)
        plans.append(out[0]._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(Engine, "computed", noted)
    return plans


def test_vectors_are_computed_in_place(spark, monkeypatch):
    """Vectors are many times their files' size, by which Spark would decide to broadcast them in a join."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.LongType())
    def length(s: pd.Series) -> pd.Series:
        seen.add(len(s))
        return s.str.len()

    monkeypatch.setitem(processors.REGISTRY, "length", processors.Processor("length", "vectorised", lambda c: length(c), T.LongType()))
    plans = plans_of(monkeypatch)
    raw = catalogue.raw_profiles(spark, SF)
    n = raw.count()
    d = catalogue.PROFILES | {"columns": [*catalogue.PROFILES["columns"], {"name": "n", "processor": "length", "derived_from": ["name"], "scaling": {"parallelism": 3}}]}
    e = Engine(parse(d), catalogue.stored(spark, "profiles", "p_partkey", raw, ["p_partkey"]))
    assert not e.converge().columns_failed and seen.value == n
    e.table.append(raw.limit(7).withColumn("p_partkey", F.col("p_partkey") + 10_000_000))
    e.table.compact(0)  # old and new rows in one fragment: just the new ones go to Python
    e.converge()
    assert seen.value == n + 7
    got = e.table.read().select("p_partkey", F.size("profile_embedding"), F.col("n") == F.length("name")).collect()
    assert len({r[0] for r in got}) == len(got) == n + 7 and {r[1:] for r in got} == {(64, True)}
    assert len(plans) == 4 and not any("Join" in p for p in plans)


def test_every_part_has_its_vector(spark, monkeypatch):
    plans = plans_of(monkeypatch)
    texts = {r.p_partkey: r.t for r in catalogue.flagship(spark, SF).select("p_partkey", F.concat("cleaned_name", "cleaned_skills").alias("t")).collect()}
    got = catalogue.QUERIES["mock_embedding"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        v = np.random.RandomState(int(hashlib.md5(texts[r.p_partkey].encode()).hexdigest()[:8], 16)).randn(64).astype(np.float32)
        assert np.array_equal(np.array(r.profile_embedding, np.float32), v / np.linalg.norm(v))
    assert plans and not any("Join" in p for p in plans)


def test_vectors_can_be_collected_with_a_small_heap(spark):
    """Partitions of less than half a region of 1 MB, of which a heap under 2 GB consists."""
    sf = "/root/testdata/sf0.1"
    df, row = catalogue.QUERIES["mock_embedding"](spark, sf), 4 * 64 + 48
    sizes = [r["count"] * row for r in df.groupBy(F.spark_partition_id()).count().collect()]
    n = catalogue.load(spark, sf, "part").count()
    assert sum(sizes) == n * row and max(sizes) < 512 << 10
    got = {r.p_partkey: r.profile_embedding for r in df.collect()}
    seeds = catalogue.flagship(spark, sf).select("p_partkey", text.embedding_seed(F.col("cleaned_name"), F.col("cleaned_skills"))).collect()
    assert len(got) == n == len(seeds)
    for key, seed in seeds:
        v = np.random.RandomState(seed).randn(64).astype(np.float32)
        assert np.array_equal(np.array(got[key], np.float32), v / np.linalg.norm(v))


def test_what_cannot_be_collected_stays_in_its_partitions(spark):
    t = catalogue.stored(spark, "parts", "p_partkey", catalogue.load(spark, SF, "part"), ["p_partkey"])
    as_read = t.read(["p_partkey"]).rdd.getNumPartitions()
    at_most, above = (t.read_to_collect(["p_partkey"], n // t.count_rows()) for n in (1 << 30, (1 << 30) + 1000))
    assert (at_most.rdd.getNumPartitions(), above.rdd.getNumPartitions()) == (-(-(1 << 30) // (384 << 10)), as_read)
