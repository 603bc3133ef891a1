"""Definitions as they come, routes, errors, durable runs, untouched fragments, fuzzy candidates, a database."""

import json
import random
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from colstate.__main__ import main, serve, wait_ready
from colstate.api import Colstate, descriptor, open_leases, reopen
from colstate.operators import lookup, processors
from colstate.plans import journal
from colstate.plans.engine import Engine
from colstate.plans.model import load, load_dir, parse
from colstate.sources import records
from colstate.sources.jdbc import JdbcTable
from colstate.sources.snapshots import SnapshotTable
from colstate.streaming import ingest

ONE = """
name: person-enrichment
dataset_path: "persons.snap"
primary_key: member_id
workflow_version: 0.1.0
sources:
  stream_A:
    topic: "raw-scraper-1"
    mapping:
      full_name: name
columns:
  - name: member_id
    type: string
    source: raw
  - name: name
    type: string
    source: raw
  - name: skills
    type: string
    source: raw
  - name: cleaned_name
    type: string
    processor: clean_name
    derived_from: [name]
    scaling: {parallelism: 50, num_cpus: 1}
"""
TWO = """
name: user-enrichment
dataset_path: "users/of.snap"
primary_key: github_username
workflow_version: 0.1.0
sources: {}
columns:
  - {name: github_username, type: string, source: raw}
  - {name: name, type: string, source: raw}
  - {name: repos, type: string, source: raw}
  - {name: cleaned_name, processor: clean_name, derived_from: [name]}
  - name: linkedin_match
    type: string
    processor: match_linkedin_profile
    derived_from: [cleaned_name]
    lookup:
      workflow: person-enrichment
      dataset_path: persons.snap
      match_columns: [cleaned_name, member_id]
execution_config:
  convergence_mode: continuous
  compaction_fragment_threshold: 20
  heartbeat_timeout_seconds: 60
"""
PEOPLE = [(f"member_{i:06d}", f"  ada LOVELACE{'xyz'[i % 3]} ", "Go") for i in range(6)]
RAW = "member_id string, name string, skills string"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.yaml").write_text(TWO)
    (tmp_path / "w" / "b.yaml").write_text(ONE)
    return tmp_path


def test_lookup_without_on_and_dataset_paths(spark, folder):
    w = load(folder / "w" / "a.yaml")
    look = w.column("linkedin_match").lookup
    assert (look.on, look.dataset_path, look.match_columns) == (None, "persons.snap", ("cleaned_name", "member_id"))
    assert journal.column_from_json(journal.column_to_json(w.column("linkedin_match"))) == w.column("linkedin_match")
    root = f"file://{folder}/data"
    c = Colstate.from_dir(spark, folder / "w", root)
    assert c.tables["person-enrichment"].path == f"{root}/persons.snap" and c.tables["user-enrichment"].path == f"{root}/users/of.snap"
    c.tables["person-enrichment"].append(spark.createDataFrame(PEOPLE, RAW))
    c.tables["user-enrichment"].append(spark.createDataFrame([("u", "Ada Lovelacex", "r"), ("v", "Zoe", "r")], "github_username string, name string, repos string"))
    assert c.converge_all()["dependency_order"] == ["person-enrichment", "user-enrichment"]
    match = {r.github_username: r.linkedin_match for r in c.tables["user-enrichment"].read().collect()}
    assert match == {"u": "member_000003", "v": None}
    # the other workflow isn't known here: its dataset is found by the path
    alone = Colstate(spark, {"user-enrichment": w}, root)
    alone.tables["user-enrichment"].upsert(spark.createDataFrame([("w", "Ada Lovelacey", "r")], "github_username string, name string, repos string"))
    alone.converge("user-enrichment")
    assert alone.tables["user-enrichment"].read(where="github_username = 'w'").first().linkedin_match == "member_000004"
    # ``on`` names another column
    other = parse({"name": "o", "dataset_path": "/abs/o", "workflow_version": "1", "columns": [
        {"name": "member_id"}, {"name": "nick"}, {"name": "m", "processor": "match_linkedin_profile", "derived_from": ["member_id"], "lookup": {"workflow": "p", "on": "nick", "match_columns": ["name", "id"]}}]})
    rows = spark.createDataFrame([("1", "x", 0)], "member_id string, nick string, _seq bigint")
    ext = spark.createDataFrame([("x", "found", 0)], "name string, id string, _seq bigint")
    got = processors.get("match_linkedin_profile").run(rows, other.column("m"), lambda name, path=None: ext, "_seq").first()
    assert got.m == "found"
    assert Colstate(spark, [other], root).tables["o"].path == "/abs/o"


def test_names_have_blanks(spark):
    for df in (records.github(spark, 5), records.linkedin(spark, 5)):
        assert all(r.name.startswith("  ") and r.name.endswith("  ") and r.name.strip() for r in df.collect())
    rows = records.github_overlapping(spark, 9, records.linkedin(spark, 9), 9).collect()
    assert len({r.repos for r in rows}) > 1


def test_routes_and_errors(spark, folder):
    c = Colstate.from_dir(spark, folder / "w", f"file://{folder}/http", default="person-enrichment")
    server = serve(c, 0)
    assert not wait_ready("http://127.0.0.1:1", 0.1)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def ask(method, path, body=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(f"{url}/{path}", body, headers, method=method)) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert wait_ready(url, 5) and ask("POST", "ingest?count=4")[1]["count"] == 4
    for method, path in (("GET", "reset"), ("GET", "ingest"), ("GET", "converge"), ("POST", "status"), ("PUT", "ingest"), ("GET", "other")):
        assert ask(method, path)[0] == 404, path
    assert ask("GET", "status")[1]["rows"] == 4 and ask("GET", "sample?n=x")[0] == 400 and ask("GET", "status?workflow=x")[0] == 400
    code, said = ask("POST", "ingest", b"\xff\xff\xff", **{"Content-Type": "application/x-protobuf"})
    assert code == 500 and said["error"]
    code, said = ask("POST", "converge?durable=1")
    assert code == 200 and said["columns_computed"] == ["cleaned_name"]
    again = ask("POST", f"converge?run={said['run_id']}")[1]
    assert again == said  # a run that has ended gives its result again
    assert ask("POST", "reset")[0] == 200 and ask("GET", "status")[1]["exists"] is False
    server.shutdown()


def test_reasons_settings_and_resumed_runs(spark, tmp_path):
    calls, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"

    @processors.register("breaks_once")
    def breaks_once(c):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("not yet")
        return F.upper(c)

    d = parse({"name": "w", "dataset_path": "w", "workflow_version": "1", "execution_config": {"max_retries": 0, "max_convergence_passes": 1}, "columns": [
        {"name": "member_id"}, {"name": "name"}, {"name": "skills"}, {"name": "ok", "processor": "clean_name", "derived_from": ["name"]},
        {"name": "up", "processor": "breaks_once", "derived_from": ["ok"]},
        {"name": "e", "type": "vector", "processor": "mock_embedding", "derived_from": ["ok"], "scaling": {"batch_size": 7}}]})
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    t.append(spark.createDataFrame(PEOPLE, RAW))
    before = spark.conf.get(key)
    e = Engine(d, t, sleep=lambda s: None)
    r = e.converge(journal=journal.Journal(spark, f"file://{tmp_path}/j", "first"))
    assert r.columns_failed == ["up"] and "not yet" in r.errors["up"] and set(r.columns_computed) == {"ok", "e"}
    assert spark.conf.get(key) == before
    log = journal.Journal(spark, f"file://{tmp_path}/j", "first")
    assert [x["level"] for x in log.entries("w")] == [0, 1] and log.entries("w")[1]["errors"]["up"] == r.errors["up"]
    # as if the run had been cut off before its end: it goes on in the same pass and counts what it had done
    log._fs.delete(log._jvm_path(f"{log.path}/w.result"), False)
    r2 = e.converge(journal=log)
    assert set(r2.columns_computed) == {"ok", "e", "up"} and r2.passes == 1 and r2.rows_processed == r.rows_processed + 6
    assert e.converge(journal=journal.Journal(spark, f"file://{tmp_path}/j", "first")) == r2
    assert e.diff().empty and not e.converge().columns_computed


def test_untouched_fragments_stay(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t", "id")
    for k in range(4):
        t.append(spark.range(k * 10, k * 10 + 10).withColumn("v", F.col("id")).coalesce(1))
    paths = lambda: [f["path"] for f in t.version().fragments]
    first = paths()
    t.upsert(spark.createDataFrame([(5, 50), (99, 1)], "id bigint, v bigint"))
    assert set(first) & set(paths()) == set(first[1:])
    assert t.delete_rows("id BETWEEN 12 AND 13") == 2 and set(first) & set(paths()) == set(first[2:])
    before = paths()
    assert t.delete_rows("id = -1") == 0 and paths() == before
    t.upsert(spark.createDataFrame([(25, 7)], "id bigint, v bigint"), "preserve")
    t.replace_rows("id = 26", spark.createDataFrame([(26, 8)], "id bigint, v bigint"))
    t.merge_column(spark.createDataFrame([(27, 9), (27, 3)], "id bigint, v bigint"), "v", keep_unmatched=True)
    assert first[3] in paths()
    got = {r.id: r.v for r in t.read().collect()}
    want = {i: i for i in range(40) if i not in (12, 13)} | {5: 50, 99: 1, 25: 7, 26: 8, 27: 9}
    assert got == want and t.count_rows() == len(want)


def test_converge_writes_dirty_fragments_only(spark, tmp_path):
    t = SnapshotTable(spark, f"file://{tmp_path}/t")
    e = Engine(parse(load_dict(ONE)), t)
    for k in range(3):
        t.append(spark.createDataFrame([(f"m{k}{i}", " x ", "s") for i in range(4)], RAW).coalesce(1))
    e.converge()
    clean = [f["path"] for f in t.version().fragments]
    t.append(spark.createDataFrame([("new", " y ", "s")], RAW).coalesce(1))
    e.converge()
    assert set(clean) <= {f["path"] for f in t.version().fragments} and t.null_count("cleaned_name") == 0


def load_dict(text):
    import yaml

    return yaml.safe_load(text)


def test_leases_by_configuration(spark, tmp_path, monkeypatch):
    monkeypatch.delenv("COLSTATE_LEASES", raising=False)
    assert open_leases(spark) is None
    monkeypatch.setenv("COLSTATE_LEASES", f"file://{tmp_path}/l")
    assert open_leases(spark).ping()
    (tmp_path / "file").write_text("x")
    monkeypatch.setenv("COLSTATE_LEASES", f"file://{tmp_path}/file/l")
    assert open_leases(spark) is None


def test_fuzzy_candidates(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéoxz ") for _ in range(rng.randrange(1, 14)))
    known = list(dict.fromkeys(word() for _ in range(250))) + ["tide", "q" * 210 + "rs"]
    own = list(dict.fromkeys([word() for _ in range(120)] + [k[:-1] + "x" for k in known[:60] if k[:-1] + "x" not in known] + ["diet", "", "q" * 205 + "rs"]))
    own = [o for o in own if o not in known]
    k = spark.createDataFrame([(x, str(i), i) for i, x in enumerate(known)], "key string, id string, first_seq bigint")
    o = spark.createDataFrame([(x,) for x in own], "own string")
    pairs = [(r.own, r.key) for r in lookup.candidates(o, k).collect()]
    assert len(pairs) == len(set(pairs)) < 0.1 * len(known) * len(own)
    near = {(a, b) for a in own for b in known if lookup.similarity(a, b) >= lookup.THRESHOLD}
    assert near and near <= set(pairs)
    got = {r.own: r.id for r in lookup.fuzzy(o, k).collect()}
    want = dict(zip(own, lookup.brute_force(own, [(x, str(i)) for i, x in enumerate(known)])))
    assert got == {a: b for a, b in want.items() if b is not None}


def test_database(spark, tmp_path, monkeypatch):
    """The same mutations on a table of an embedded database and on a snapshot table."""
    a, b = JdbcTable(spark, "jdbc:derby:memory:colstate;create=true", "t", "id"), SnapshotTable(spark, f"file://{tmp_path}/t", "id")
    rows = lambda t: sorted((tuple(r) for r in t.read().collect()), key=str)
    one = spark.createDataFrame([(1, "a", None), (2, "b'", [1.0, 0.5]), (3, None, None)], "id bigint, s string, v array<float>").coalesce(1)
    two = spark.createDataFrame([(2, "z"), (4, "n")], "id bigint, s string").coalesce(1)
    assert not a.exists() and a.stats()["exists"] is False and a.sample().count() == 0
    steps = [
        lambda t: t.append(one), lambda t: t.upsert(two, "preserve"), lambda t: t.upsert(two.where("id = 4")), lambda t: t.add_column("n", one.schema["id"].dataType),
        lambda t: t.merge_column(spark.createDataFrame([(1, 7), (1, 9), (3, 1)], "id bigint, n bigint"), "n"),
        lambda t: t.merge_column(spark.createDataFrame([(4, 2)], "id bigint, n bigint"), "n", keep_unmatched=True),
        lambda t: t.replace_rows("n = 1", spark.createDataFrame([(8, "new")], "id bigint, s string")), lambda t: t.upsert(two.limit(0)),
    ]
    for k, step in enumerate(steps):
        step(a), step(b)
        assert rows(a) == rows(b) and a.columns() == b.columns() and a.count_rows() == b.count_rows(), k
    assert a.null_counts(["s", "v", "n"]) == b.null_counts(["s", "v", "n"]) and a.null_count("v") == 3
    assert a.delete_rows("id > 3") == b.delete_rows("id > 3") == 2 and rows(a) == rows(b)
    assert a.sample(1).count() == 1 and not a.compact() and a.read_keys(two).count() == 1 and a.read_null_rows("n", ["id"]).count() == 1
    a.drop()
    assert not a.exists()
    with pytest.raises(ValueError):
        one and a.upsert(one, "other")
    monkeypatch.setenv("STORAGE_BACKEND", "JDBC")
    monkeypatch.setenv("DATABASE_URL", "derby:memory:colstate;create=true")
    c = Colstate(spark, [parse(load_dict(ONE)), parse(load_dict(TWO))], f"file://{tmp_path}/none", default="person-enrichment")
    c.tables["person-enrichment"].append(spark.createDataFrame(PEOPLE, RAW))
    c.tables["user-enrichment"].append(spark.createDataFrame([("u", "Ada Lovelacex", "r")], "github_username string, name string, repos string"))
    done = c.converge_all()["results"]
    assert done["person-enrichment"]["columns_computed"] == ["cleaned_name"] and done["user-enrichment"]["passes"] == 1
    assert c.tables["user-enrichment"].read().first().linkedin_match == "member_000003"
    assert c.status()["storage_backend"] == "jdbc" and c.workflows()["workflows"][0]["storage_backend"] == "jdbc"
    monkeypatch.setenv("STORAGE_BACKEND", "other")
    with pytest.raises(ValueError):
        Colstate(spark, [parse(load_dict(ONE))], f"file://{tmp_path}/none")


def test_runs_are_taken_up(spark, folder):
    """A run that another process began: begun, cut off after its first workflow, taken up as a whole."""
    root = f"file://{folder}/runs"
    c = Colstate.from_dir(spark, folder / "w", root)
    c.tables["person-enrichment"].append(spark.createDataFrame(PEOPLE, RAW))
    c.tables["user-enrichment"].append(spark.createDataFrame([("u", "Ada Lovelacex", "r"), ("v", "Zoe", "r")], "github_username string, name string, repos string"))
    log = c._begun("cut", list(c.engines))
    c.engines["person-enrichment"].converge(journal=log)
    assert journal.open_runs(spark, c.runs_path) == ["cut"]
    done = Colstate.from_dir(spark, folder / "w", root).take_up()["runs"]["cut"]
    assert done["person-enrichment"]["columns_computed"] == ["cleaned_name"] and set(done["user-enrichment"]["columns_computed"]) == {"cleaned_name", "linkedin_match"}
    assert c.take_up() == {"runs": {}} and journal.open_runs(spark, f"{root}/nowhere") == []
    report = c.match_report("user-enrichment")
    assert (report["rows"], report["matched"], report["unmatched"]) == (2, 1, 1)
    assert [r["github_username"] for r in report["first_matched"] + report["first_unmatched"]] == ["u", "v"]
    same = reopen(spark, json.loads(json.dumps(descriptor(c.tables["user-enrichment"]))))
    assert same.count_rows() == 2 and same.primary_key == "github_username"
    db = JdbcTable(spark, "derby:memory:colstate;create=true", "x", "id")
    assert vars(reopen(spark, descriptor(db))) == vars(db)


def test_command_line(spark, folder, capsys):
    args = ["--workflows", str(folder / "w"), "--root", f"file://{folder}/cli"]
    main([*args, "--workflow", "person", "--count", "7", "ingest"])
    main([*args, "--workflow", "person", "converge"])
    main([*args, "--workflow", "person", "--n", "2", "sample"])
    main([*args, "lifecycle"])
    said = capsys.readouterr().out
    assert '"count": 7' in said and '"columns_computed"' in said and "dependency_order" in said
    with pytest.raises(SystemExit):
        main([*args, "nothing"])


def test_enriching_stream(spark, tmp_path):
    """Serialised records, a file each, enriched and appended by micro-batch."""
    user = records.message_class("UserData")
    for k in range(3):
        body = user(id=str(k), name=f"n{k}", location="l").SerializeToString()
        spark.createDataFrame([(body,), (None,)], "body binary").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    table = SnapshotTable(spark, f"file://{tmp_path}/out", "id")
    stream = ingest.files(spark, f"file://{tmp_path}/in", spark.read.parquet(f"file://{tmp_path}/in").schema, max_files=1)
    ingest.start_enriching(stream, ingest.appending(table), f"file://{tmp_path}/ck", None).awaitTermination(120)
    got = sorted((r.id, r.summary, r.status) for r in table.read().collect())
    assert got == [(str(k), f"Enriched n{k} from l", "processed") for k in range(3)] and table.fragmentation() == 3


def test_load_dir(folder):
    assert list(load_dir(folder / "w")) == ["user-enrichment", "person-enrichment"]
