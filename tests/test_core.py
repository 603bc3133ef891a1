"""Definitions, graphs, tables, processors, convergence, leases, the facade."""

import json
import random
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colstate.__main__ import serve
from colstate.api import Colstate, UnknownWorkflow
from colstate.functions import text
from colstate.operators import lookup, processors
from colstate.operators.locks import Leases
from colstate.plans import graph, journal
from colstate.plans.engine import Engine
from colstate.plans.model import load_dir, parse, spark_type
from colstate.sources import records
from colstate.sources.snapshots import SEQ, Conflict, SnapshotTable

PEOPLE = {
    "name": "linkedin-workflow", "dataset_path": "x", "workflow_version": 1,
    "sources": [{"name": "a", "topic": "t", "mapping": {"full_name": "name"}}],
    "columns": [
        {"name": "member_id"}, {"name": "name"}, {"name": "skills"},
        {"name": "profile_embedding", "type": "vector", "processor": "mock_embedding", "derived_from": ["cleaned_name", "cleaned_skills"], "scaling": {"batch_size": 100, "parallelism": 2}},
        {"name": "cleaned_name", "processor": "clean_name", "derived_from": "name"},
        {"name": "cleaned_skills", "processor": "clean_skills", "derived_from": ["skills"]},
    ],
}
REPOS = {
    "name": "github-workflow", "dataset_path": "y", "workflow_version": "1", "primary_key": "github_username",
    "columns": [
        {"name": "github_username"}, {"name": "name"}, {"name": "repos"},
        {"name": "cleaned_name", "processor": "clean_name", "derived_from": ["name"]},
        {"name": "linkedin_match", "processor": "match_linkedin_profile", "derived_from": ["cleaned_name"],
         "lookup": {"workflow": "linkedin-workflow", "on": "cleaned_name", "match_columns": ["cleaned_name", "member_id"]}},
    ],
}
RAW = "member_id string, name string, skills string"


def test_definitions(tmp_path):
    w = parse(PEOPLE)
    assert (w.primary_key, w.max_passes, w.max_retries, w.compaction_threshold) == ("member_id", 3, 2, 20)
    assert w.column("cleaned_name").derived_from == ("name",) and w.workflow_version == "1"
    assert [c.name for c in w.raw_columns] == ["member_id", "name", "skills"]
    assert w.sources[0].mapping == {"full_name": "name"}
    assert spark_type("vector") == T.ArrayType(T.FloatType()) and spark_type("odd") == T.StringType()
    with pytest.raises(KeyError):
        parse({k: v for k, v in PEOPLE.items() if k != "columns"})
    with pytest.raises(KeyError):
        parse(REPOS | {"columns": [{"name": "x", "processor": "p", "lookup": {"workflow": "w"}}]})
    (tmp_path / "b.yaml").write_text(json.dumps(PEOPLE))
    (tmp_path / "a.yaml").write_text(json.dumps(REPOS))
    assert list(load_dir(tmp_path)) == ["github-workflow", "linkedin-workflow"]
    assert list(load_dir(tmp_path / "none", tmp_path / "b.yaml")) == ["linkedin-workflow"]
    c = parse(REPOS).column("linkedin_match")
    assert journal.column_from_json(journal.column_to_json(c)) == c


def test_orders():
    a, b = parse(PEOPLE), parse(REPOS)
    assert [[c.name for c in layer] for layer in graph.column_levels(a)] == [["cleaned_name", "cleaned_skills"], ["profile_embedding"]]
    assert [c.name for c in graph.columns_in_order(a)][-1] == "profile_embedding"
    assert graph.workflow_order([b, a]) == ["linkedin-workflow", "github-workflow"]
    assert graph.workflow_order([b]) == ["github-workflow"]
    loop = [{"name": "p", "processor": "clean_name", "derived_from": ["q"]}, {"name": "q", "processor": "clean_name", "derived_from": ["p"]}]
    with pytest.raises(ValueError, match="p, q"):
        graph.column_levels(parse(PEOPLE | {"columns": loop}))
    own = REPOS["columns"][-1] | {"lookup": REPOS["columns"][-1]["lookup"] | {"workflow": "github-workflow"}}
    with pytest.raises(ValueError):
        graph.workflow_order([parse(REPOS | {"columns": [own]})])


def values(df, f, inputs):
    spark = df
    got = spark.createDataFrame(list(enumerate(inputs)), "i int, s string").select("i", f(F.col("s")).alias("o")).orderBy("i").collect()
    return [r.o for r in got]


def test_names_and_skills(spark):
    rng = random.Random(2)
    odd = [None, "", "  ", "mary-jane o'neil 3rd", "McDONALD", "\t a\nb \x1c", "a_b c.d", "élan ÉCOLE", "x1y2z"]
    fuzz = odd + ["".join(rng.choices("abZ -_'1.\té\n,", k=rng.randrange(12))) for _ in range(400)]
    assert values(spark, text.clean_name, fuzz) == [None if s is None else s.strip().title() for s in fuzz]
    assert values(spark, text.clean_name_strict, odd + ["ﬁn ßa"]) == [None if s is None else s.strip().title() for s in odd + ["ﬁn ßa"]]
    skills = fuzz + ["B , a,,b", "x,", "Q,q, Q"]
    want = [None if s is None else ", ".join(sorted({t.strip().lower() for t in s.split(",")})) for s in skills]
    assert values(spark, text.clean_skills, skills) == want


def test_embedding(spark):
    import hashlib

    rows = [("ab", "c"), ("a", "bc"), (None, None), ("", "é")]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", text.mock_embedding(F.col("a"), F.col("b")).alias("v"))
    for r in df.collect():
        seed = int(hashlib.md5(((r.a or "") + (r.b or "")).encode()).hexdigest()[:8], 16)
        v = np.random.RandomState(seed).randn(64).astype(np.float32)
        assert np.array_equal(np.array(r.v, np.float32), v / np.linalg.norm(v))


def test_lookup_against_loops(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcde ", k=rng.randrange(1, 9)))
    names = [None, "", "tide", "Diet", "ABC", "x" * 250] + [word() for _ in range(120)]
    ext = [("diet", "1"), ("abc", "2"), (None, "3"), ("Abc", "4"), ("", "5"), ("x" * 249 + "y", "6")] + [(word(), str(10 + i)) for i in range(120)]
    left = spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"{SEQ} bigint, n string")
    right = spark.createDataFrame([(i, n, k) for i, (n, k) in enumerate(ext)], f"{SEQ} bigint, cleaned_name string, member_id string")
    got = lookup.lookup(left, "n", right, ("cleaned_name", "member_id"), SEQ, "m").orderBy(SEQ).collect()
    assert [r.m for r in got] == lookup.brute_force(names, ext)
    assert {r.m for r in lookup.lookup(left, "n", None, ("cleaned_name", "member_id"), SEQ, "m").collect()} == {None}
    assert {r.m for r in lookup.lookup(left, "n", right.drop("member_id"), ("cleaned_name", "member_id"), SEQ, "m").collect()} == {None}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_table_against_a_dictionary(spark, tmp_path):
    """Random mutations, and the same on a list of rows."""
    rng, t, model = random.Random(8), SnapshotTable(spark, f"file://{tmp_path}/t", "k"), []
    t.append(spark.createDataFrame([], "k string, a int, b string"))
    for step in range(14):
        new = [(f"k'{rng.randrange(12)}", rng.randrange(100), rng.choice(["x", None])) for _ in range(rng.randrange(1, 6))]
        df = spark.createDataFrame([(*r, i) for i, r in enumerate(new)], "k string, a int, b string, at int").coalesce(1)
        how = rng.choice(["append", "upsert", "preserve", "delete", "replace", "compact", "short"])
        if how == "append":
            t.append(df, ["at"])
            model += new
        elif how == "short":
            t.append(df.select("a", "k"))
            model += [(k, a, None) for k, a, _ in new]
        elif how == "upsert":
            t.upsert(df, order_by=["at"])
            last = {r[0]: r for r in new}
            model = [r for r in model if r[0] not in last] + list(last.values())
        elif how == "preserve":
            t.upsert(df.select("k", "a", "at"), "preserve", ["at"])
            last = {r[0]: r for r in new}
            have = {r[0] for r in model}
            model = [(k, last[k][1], b) if k in last else (k, a, b) for k, a, b in model] + [(k, a, None) for k, a, _ in last.values() if k not in have]
        elif how == "delete":
            n = t.delete_rows("a > 50 AND b = 'x'")
            gone = [r for r in model if r[1] > 50 and r[2] == "x"]
            assert n == len(gone)
            model = [r for r in model if r not in gone]
        elif how == "replace":
            t.replace_rows("a < 10", df)
            model = [r for r in model if not r[1] < 10] + new
        else:
            t.compact(1)
        assert rows(t.read()) == sorted(model, key=str), how
        assert t.count_rows() == len(model)
    assert t.null_counts(["a", "b"]) == {"a": 0, "b": sum(r[2] is None for r in model)}
    t.vacuum()
    assert rows(t.read()) == sorted(model, key=str)
    t.drop()
    assert not t.exists() and t.stats()["exists"] is False and t.columns() == []


def test_compaction_threshold_and_conflict(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/c", "id")
    for _ in range(3):
        t.append(spark.range(5).coalesce(1))
    assert t.fragmentation() == 3 and not t.compact(3) and t.compact(2) and t.fragmentation() == 1
    base = t.version()
    t.append(spark.range(1))
    with pytest.raises(Conflict):
        t.replace_all(base, t.read_version(base), base.schema)
    assert t.count_rows() == 16
    t.add_column("v", T.ArrayType(T.FloatType()))
    assert t.column_exists("v") and t.null_count("v") == 16


def raw(n, start=0, name="  ada LOVELACE "):
    return [(f"member_{i:06d}", name, "Go, ada") for i in range(start, start + n)]


def engine(spark, path, data, definition=PEOPLE, **options):
    w = parse(definition)
    t = SnapshotTable(spark, f"file://{path}", w.primary_key)
    t.append(spark.createDataFrame(data, RAW), ["member_id"])
    return Engine(w, t, sleep=lambda s: None, **options)


def test_counters(spark, tmp_path):
    e = engine(spark, tmp_path / "a", raw(40))
    plan = e.diff()
    assert [t.mode for t in plan.tasks] == ["add_new"] * 3 and plan.dirty_row_count == 40
    r = e.converge()
    assert (r.rows_processed, r.passes, sorted(r.columns_computed)) == (120, 1, ["cleaned_name", "cleaned_skills", "profile_embedding"])
    r = e.converge()
    assert (r.rows_processed, r.passes, r.fragments_before) == (0, 0, r.fragments_after)
    new = spark.createDataFrame(raw(10, 40) + raw(5, name="grace"), RAW)
    e.table.upsert(new)
    r = e.converge()
    assert (r.rows_processed, r.passes) == (45, 1)
    assert e.table.read().where("name = 'grace'").select("cleaned_name").distinct().collect()[0][0] == "Grace"
    assert Engine(e.workflow, SnapshotTable(spark, f"file://{tmp_path}/none")).diff().empty


def test_stuck_columns(spark, tmp_path):
    e = engine(spark, tmp_path / "a", raw(20) + [(f"z{i}", None, "x") for i in range(3)], PEOPLE | {"columns": [c for c in PEOPLE["columns"] if c["name"] != "profile_embedding"]})
    r = e.converge()
    assert (r.passes, r.rows_processed, r.columns_computed.count("cleaned_name")) == (2, 23 * 2 + 3, 2)
    r = e.converge()
    assert (r.passes, r.rows_processed) == (1, 3)


def test_failures(spark, tmp_path):
    calls = []

    @processors.register("flaky")
    def flaky(c):
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("not yet")
        return F.upper(c)

    @processors.register("broken")
    def broken(c):
        raise RuntimeError("never")

    d = PEOPLE | {"columns": [*PEOPLE["columns"][:3], {"name": "f", "processor": "flaky", "derived_from": ["name"]},
                              {"name": "b", "processor": "broken", "derived_from": ["name"]}, {"name": "u", "processor": "absent", "derived_from": ["name"]},
                              {"name": "ok", "processor": "clean_name", "derived_from": ["name"]}, {"name": "after", "processor": "clean_name", "derived_from": ["b"]}]}
    e = engine(spark, tmp_path / "a", raw(5), d, journal=(j := journal.Journal(spark, f"file://{tmp_path}/j")))
    r = e.converge()
    assert "ok" in r.columns_computed and "f" in r.columns_computed and "after" not in r.columns_computed + r.columns_failed
    assert r.columns_failed.count("b") == r.passes == 3 and r.columns_failed.count("u") == 3
    assert [x["pass"] for x in j.entries()] == [1, 2, 3]
    # a run that is cut off after the write of a level goes on where it was
    assert Engine(parse(PEOPLE), e.table).converge().columns_failed == []
    assert set(e.table.columns()) >= {"cleaned_name", "cleaned_skills", "profile_embedding", "ok"}


def test_leases(spark, tmp_path):
    now = [100.0]
    leases = Leases(spark, f"file://{tmp_path}/l", 10, lambda: now[0])
    ids = lambda *x: spark.createDataFrame([(str(i),) for i in x], "id string")
    names = lambda df: sorted(r.id for r in df.collect())
    a, b = leases.acquire("w", ids(1, 2), "me")
    assert (names(a), names(b)) == (["1", "2"], [])
    a, b = leases.acquire("w", ids(2, 3), "me", 50)  # not re-entrant
    assert (names(a), names(b)) == (["3"], ["2"])
    assert names(leases.acquire("other", ids(1), "you")[0]) == ["1"]
    assert leases.release("w", ids(1), "you") == 0 and leases.release("w", ids(1), "me") == 1
    assert leases.extend("w", ids(2), "me", 30) == 1
    now[0] = 120
    assert sorted((r.id, r.owner) for r in leases.locked("w", ids(1, 2, 3)).collect()) == [("2", "me"), ("3", "me")]
    now[0] = 1000
    assert names(leases.locked("w", ids(1, 2, 3))) == [] and leases.ping()
    e = engine(spark, tmp_path / "a", raw(6), leases=leases)
    leases.acquire(e.workflow.name, ids("member_000001"), "someone", 1e6)
    e.converge()
    got = {r.member_id: r.cleaned_name for r in e.table.read().collect()}
    assert got.pop("member_000001") is None and set(got.values()) == {"Ada Lovelace"}


def test_facade_and_http(spark, tmp_path):
    c = Colstate(spark, [parse(REPOS), parse(PEOPLE)], f"file://{tmp_path}/data", default="linkedin-workflow")
    assert c.workflows()["dependency_order"] == ["linkedin-workflow", "github-workflow"]
    assert c.status()["exists"] is False and c.sample()["count"] == 0
    r = c.ingest(count=12)
    assert (r["count"], r["id_range"], r["fragments"]) == (12, ["member_000000", "member_000011"], 1)
    assert c.ingest(count=3)["id_range"] == ["member_000012", "member_000014"]
    people = c.tables["linkedin-workflow"].read()
    c.tables["github-workflow"].append(records.github_overlapping(spark, 8, people, 5))
    cls = records.message_class("GithubProfileBatch")
    body = cls(profiles=[{"github_username": "u", "name": "n"}]).SerializeToString()
    assert c.ingest("github-workflow", body)["count"] == 1
    done = c.converge_all()
    assert done["dependency_order"][0] == "linkedin-workflow"
    hits = c.tables["github-workflow"].read().where("github_username LIKE 'gh_%' AND github_username NOT LIKE 'gh_unique%'").collect()
    assert len(hits) == 5 and all(r.linkedin_match for r in hits)
    up = c.upsert(count=4, updates=6)
    assert (up["new"], up["updates"], up["total_records"]) == (4, 6, 19)
    assert c.converge()["rows_processed"] == 30
    with pytest.raises(UnknownWorkflow):
        c.converge("nope")
    server = serve(c, 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    get = lambda p: json.load(urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/{p}"))
    assert get("status")["rows"] == 19 and get("sample?n=2")["count"] == 2
    for path, code in (("nothing", 404), ("status?workflow=x", 400)):
        with pytest.raises(urllib.error.HTTPError) as err:
            get(path)
        assert err.value.code == code
    server.shutdown()
    assert "dropped" in c.reset()["message"] and c.status()["exists"] is False


def test_generators(spark):
    got = records.github(spark, 50, 7).collect()
    assert all(r.github_username.endswith(f"_{i}") for i, r in enumerate(got, 7))
    assert all(1 <= len(set(r.repos.split(", "))) <= 5 for r in got)
    assert records.users_from_protobuf(spark.createDataFrame([(records.message_class("UserData")(id="1", name="n", location="l").SerializeToString(),)], "body binary")).collect()[0] == ("1", "n", "l")
    with pytest.raises(KeyError):
        records.generate(spark, "other", 1)
