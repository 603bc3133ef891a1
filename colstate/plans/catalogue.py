"""The driver's queries: each goes through tables, processors and the engine; the SQL beside each says
what must come out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colstate.functions import text
from colstate.operators import lookup as lookups
from colstate.operators.locks import Leases
from colstate.plans import graph
from colstate.plans.engine import Engine, converge_all
from colstate.plans.model import Source, parse
from colstate.sources import records, scratch
from colstate.sources.snapshots import SEQ, SnapshotTable
from colstate.streaming import ingest as streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return put


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(spark: SparkSession, name: str, key: str, df: DataFrame, order_by: list | None = None) -> SnapshotTable:
    t = scratch.table(spark, name, key)
    t.append(df, order_by)
    return t


# scans ------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 20 AND p_name LIKE '%a%'")
def scan_project_filter(spark, sf_dir):
    return stored(spark, "part", "p_partkey", load(spark, sf_dir, "part")).read(["p_partkey", "p_name"], "p_size > 20 AND p_name LIKE '%a%'")


def labelled(spark, sf_dir) -> SnapshotTable:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return stored(spark, "labelled", "doc_id", docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left"), ["doc_id"])


@query("SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE quality IS NULL")
def read_null_rows(spark, sf_dir):
    return labelled(spark, sf_dir).read_null_rows("quality", ["doc_id", "lang"])


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def key_list_scan(spark, sf_dir):
    t = stored(spark, "orders", "o_custkey", load(spark, sf_dir, "orders"))
    keys = load(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"))
    return t.read_keys(keys, ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT true AS table_exists, count(*) AS row_count, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def stats_row_count(spark, sf_dir):
    s = stored(spark, "lineitem", "l_orderkey", load(spark, sf_dir, "lineitem")).stats()
    return spark.createDataFrame([(s["exists"], s["row_count"], len(s["columns"]))], "table_exists boolean, row_count bigint, n_columns bigint")


@query("SELECT count(*) - count(quality) AS quality, count(*) - count(toxic) AS toxic, count(*) - count(lang) AS lang FROM documents LEFT JOIN labels USING (doc_id)")
def null_counts(spark, sf_dir):
    n = labelled(spark, sf_dir).null_counts(["quality", "toxic", "lang"])
    return spark.createDataFrame([(n["quality"], n["toxic"], n["lang"])], "quality bigint, toxic bigint, lang bigint")


@query("SELECT max(regexp_extract(replace(c_name, '#', '_'), '_([0-9]+)$', 1)::BIGINT) + 1 AS next_id FROM customer")
def next_id_offset(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.regexp_replace("c_name", "#", "_").alias("member_id"), "c_acctbal")
    n = records.next_id(stored(spark, "members", "member_id", c))
    return spark.createDataFrame([(n,)], "next_id bigint")


@query("SELECT min_by(user_id, event_id) AS first_id, max_by(user_id, event_id) AS last_id FROM events")
def id_range(spark, sf_dir):
    t = stored(spark, "events", "user_id", load(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"])
    return records.id_range(t.read_version(t.version()), "user_id", F.col(SEQ))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 25")
def sample_rows(spark, sf_dir):
    return stored(spark, "orders", "o_orderkey", load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"]).sample(25)


# mutations ----------------------------------------------------------------------------------------


@query(
    "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg FROM customer"
    " UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier"
)
def append_align(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    t = stored(spark, "parties", "k", c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")))
    t.append(s.select("s_nationkey", F.col("s_acctbal").alias("bal"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("k")))
    return t.read()


def people(spark, sf_dir) -> SnapshotTable:
    """Customers with a derived column."""
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return stored(spark, "people", "c_custkey", c.withColumn("shout", F.upper("c_name")), ["c_custkey"])


def batch(spark, sf_dir) -> DataFrame:
    """New names: for every tenth customer, and for as many new ones."""
    c = load(spark, sf_dir, "customer").where("c_custkey % 10 = 0")
    old = c.select("c_custkey", F.concat(F.lit("new "), "c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return old.unionByName(old.withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


_BATCH = (
    "b AS (SELECT c_custkey, 'new ' || c_name AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0"
    " UNION ALL SELECT c_custkey + 10000000, 'new ' || c_name, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0)"
)


@query(
    f"WITH {_BATCH} SELECT c_custkey, c_name, c_acctbal, upper(c_name) AS shout FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM b)"
    " UNION ALL SELECT c_custkey, c_name, c_acctbal, NULL FROM b"
)
def upsert_invalidate(spark, sf_dir):
    t = people(spark, sf_dir)
    t.upsert(batch(spark, sf_dir))
    return t.read()


@query(
    f"WITH {_BATCH} SELECT coalesce(b.c_custkey, c.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN c.c_name ELSE b.c_name END AS c_name,"
    " CASE WHEN b.c_custkey IS NULL THEN c.c_acctbal ELSE b.c_acctbal END AS c_acctbal, upper(c.c_name) AS shout FROM customer c FULL JOIN b ON b.c_custkey = c.c_custkey"
)
def upsert_preserve(spark, sf_dir):
    t = people(spark, sf_dir)
    t.upsert(batch(spark, sf_dir), "preserve")
    return t.read()


@query(
    f"WITH {_BATCH}, f AS (SELECT * FROM b WHERE c_custkey % 20 <> 0) SELECT c_custkey, c_name, c_acctbal, upper(c_name) AS shout FROM customer"
    " WHERE c_custkey NOT IN (SELECT c_custkey FROM f) UNION ALL SELECT c_custkey, c_name, c_acctbal, NULL FROM f"
)
def upsert_skip_locked(spark, sf_dir):
    t, new = people(spark, sf_dir), batch(spark, sf_dir)
    leases = Leases(spark, scratch.path(spark, "leases"))
    leases.acquire("people", new.where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("id")), "someone")
    held = leases.locked("people", new.select(F.col("c_custkey").alias("id")))
    t.upsert(new.join(held.select(F.col("id").alias("c_custkey")), "c_custkey", "left_anti"))
    return t.read()


@query("SELECT user_id, max_by(event_id, event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def upsert_last_wins(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    t = stored(spark, "users", "user_id", e.limit(0))
    t.upsert(e, order_by=["event_id"])
    return t.read()


@query("SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
def merge_column_left(spark, sf_dir):
    t = stored(spark, "docs", "doc_id", load(spark, sf_dir, "documents").select("doc_id", "lang"))
    t.merge_column(load(spark, sf_dir, "labels").select("doc_id", "quality"), "quality")
    return t.read()


@query(
    "WITH s AS (SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY o_custkey)"
    " SELECT c_custkey, CASE WHEN last IS NULL THEN c_nationkey ELSE last END AS c_nationkey FROM customer LEFT JOIN s ON o_custkey = c_custkey"
)
def update_join(spark, sf_dir):
    t = stored(spark, "customers", "c_custkey", load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c_nationkey")))
    last = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("c_nationkey"))
    t.merge_column(last, "c_nationkey", keep_unmatched=True)
    return t.read()


@query("SELECT n_nationkey, n_name, CAST(NULL AS VARCHAR) AS note FROM nation")
def add_null_column(spark, sf_dir):
    t = stored(spark, "nations", "n_nationkey", load(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    t.add_column("note", text.T.StringType())
    return t.read()


@query(
    "SELECT l_orderkey, l_linenumber, (SELECT count(*) FROM lineitem WHERE l_quantity > 30 AND l_returnflag = 'R') AS deleted"
    " FROM lineitem WHERE NOT coalesce(l_quantity > 30 AND l_returnflag = 'R', false)"
)
def delete_rows(spark, sf_dir):
    t = stored(spark, "lines", "l_orderkey", load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"))
    n = t.delete_rows("l_quantity > 30 AND l_returnflag = 'R'")
    return t.read(["l_orderkey", "l_linenumber"]).withColumn("deleted", F.lit(n).cast("long"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, upper(s_name) FROM supplier WHERE s_suppkey % 3 = 0")
def replace_rows(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    t = stored(spark, "suppliers", "s_suppkey", s)
    t.replace_rows("s_suppkey % 3 = 0", s.where("s_suppkey % 3 = 0").withColumn("s_name", F.upper("s_name")))
    return t.read()


@query("SELECT o_orderkey, o_custkey, o_totalprice, true AS compacted, true AS fewer FROM orders")
def compact_preserves_rows(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    t = scratch.table(spark, "orders", "o_orderkey")
    t.append(o, ["o_orderkey"], rows_per_fragment=max(1, o.count() // 25))
    before, done = t.fragmentation(), t.compact(20)
    return t.read().withColumns({"compacted": F.lit(done), "fewer": F.lit(t.fragmentation() < before)})


# processors ---------------------------------------------------------------------------------------

_MESSY = "concat('  ', upper(p_name), '-o''x 3rd ')"
_SKILLS = "concat_ws(' , ', p_name, p_brand, p_type, p_name)"
_CLEAN = "array_to_string(list_transform(regexp_extract_all(trim({0}), '[A-Za-z]+|[^A-Za-z]+'), lambda x: upper(x[1]) || lower(x[2:])), '')"
_CLEAN_SKILLS = "array_to_string(list_sort(list_distinct(list_transform(string_split({0}, ','), lambda t: lower(trim(t))))), ', ')"
_SEED = "CAST(concat('0x', substr(md5({0}), 1, 8)) AS UINT32)::BIGINT"

PROFILES = {
    "name": "profiles", "dataset_path": "profiles", "workflow_version": "1", "primary_key": "p_partkey",
    "columns": [
        {"name": "p_partkey", "type": "int64"}, {"name": "name"}, {"name": "skills"},
        {"name": "cleaned_name", "processor": "clean_name", "derived_from": ["name"], "scaling": {"parallelism": 4}},
        {"name": "cleaned_skills", "processor": "clean_skills", "derived_from": "skills"},
        {"name": "profile_embedding", "type": "vector", "processor": "mock_embedding", "derived_from": ["cleaned_name", "cleaned_skills"]},
    ],
}


def raw_profiles(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", F.expr(_MESSY).alias("name"), F.expr(_SKILLS).alias("skills"))


def profiles(spark, sf_dir, columns: list[str] | None = None, rows: DataFrame | None = None) -> Engine:
    """The profiles workflow with all or some derived columns, its raw rows appended."""
    d = PROFILES | {"columns": [c for c in PROFILES["columns"] if "processor" not in c or columns is None or c["name"] in columns]}
    w = parse(d)
    t = stored(spark, "profiles", w.primary_key, raw_profiles(spark, sf_dir) if rows is None else rows, [w.primary_key])
    return Engine(w, t)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = profiles(spark, sf_dir)
    e.converge()
    return e.table.read()


@query(f"SELECT p_partkey, {_CLEAN.format(_MESSY)} AS cleaned_name FROM part")
def clean_name(spark, sf_dir):
    e = profiles(spark, sf_dir, ["cleaned_name"])
    e.converge()
    return e.table.read(["p_partkey", "cleaned_name"])


@query(f"SELECT p_partkey, {_CLEAN_SKILLS.format(_SKILLS)} AS cleaned_skills FROM part")
def clean_skills(spark, sf_dir):
    e = profiles(spark, sf_dir, ["cleaned_skills"])
    e.converge()
    return e.table.read(["p_partkey", "cleaned_skills"])


@query(f"SELECT p_partkey, {_SEED.format(f'concat({_MESSY}, {_SKILLS})')} AS seed FROM part")
def embedding_seed(spark, sf_dir):
    t = stored(spark, "profiles", "p_partkey", raw_profiles(spark, sf_dir))
    return t.read().select("p_partkey", text.embedding_seed(F.col("name"), F.col("skills")).alias("seed"))


@query()
def mock_embedding(spark, sf_dir):
    e = profiles(spark, sf_dir)
    e.converge()
    return e.table.read_to_collect(["p_partkey", "profile_embedding"], row_bytes=4 * text.DIMENSIONS + 48)


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def embedding_norm(spark, sf_dir):
    t = stored(spark, "vectors", "vec_id", load(spark, sf_dir, "embeddings"))
    return t.read().select("vec_id", F.round(text.norm(F.col("embedding")), 6).alias("norm"))


def encoded(spark, sf_dir, where: str | None = None) -> DataFrame:
    t = stored(spark, "vectors", "vec_id", load(spark, sf_dir, "embeddings"))
    whole = F.transform("embedding", lambda x: F.floor(x * F.lit(1000).cast("float")).cast("long"))
    return t.read(where=where).select("vec_id", F.to_json(whole).alias("encoded"))


@query(
    "SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 1000) AS BIGINT) AS VARCHAR)), ',') || ']' AS encoded FROM embeddings WHERE vec_id % 10 = 0"
)
def json_encode_list(spark, sf_dir):
    return encoded(spark, sf_dir, "vec_id % 10 = 0")


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(floor(x * 1000) AS BIGINT) AS VARCHAR)), ',') || ']' AS encoded FROM embeddings")
def json_encode_list_whole(spark, sf_dir):
    """All vectors, where the SQL given for json_encode_list asks for a tenth of them."""
    return encoded(spark, sf_dir)


@query("SELECT c_custkey, 'Enriched ' || c_name || ' from ' || n_name AS summary, 'processed' AS status FROM customer JOIN nation ON c_nationkey = n_nationkey")
def enrich_template(spark, sf_dir):
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    users = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.col("c_name").alias("name"), F.col("n_name").alias("location"))
    return records.enriched(users).select("c_custkey", "summary", "status")


# lookups ------------------------------------------------------------------------------------------


def halves(spark, sf_dir, without: str = "s%") -> tuple[DataFrame, DataFrame]:
    part = load(spark, sf_dir, "part").select("p_partkey", "p_name")
    own = stored(spark, "own", "p_partkey", part.where("p_partkey % 2 = 1"), ["p_partkey"])
    ext = stored(spark, "ext", "p_partkey", part.where(f"p_partkey % 2 = 0 AND p_name NOT LIKE '{without}'"), ["p_partkey"])
    return own.read_version(own.version()), ext.read_version(ext.version())


_EXT = "x AS (SELECT lower(p_name) AS k, CAST(max_by(p_partkey, p_partkey) AS VARCHAR) AS id FROM part WHERE p_partkey % 2 = 0 AND p_name NOT LIKE 's%' GROUP BY 1)"


def matched(spark, sf_dir) -> DataFrame:
    own, ext = halves(spark, sf_dir)
    return lookups.lookup(own, "p_name", ext, ("p_name", "p_partkey"), SEQ, "found", fuzzy_match=False)


@query(f"WITH {_EXT} SELECT p_partkey, id AS found FROM part LEFT JOIN x ON k = lower(p_name) WHERE p_partkey % 2 = 1")
def lookup_exact(spark, sf_dir):
    return matched(spark, sf_dir).select("p_partkey", "found")


@query()
def lookup_fuzzy(spark, sf_dir):
    own, ext = halves(spark, sf_dir)
    return lookups.lookup(own, "p_name", ext, ("p_name", "p_partkey"), SEQ, "found").select("p_partkey", "p_name", "found")


@query(f"WITH {_EXT} SELECT count(id) AS matched, count(*) - count(id) AS unmatched FROM part LEFT JOIN x ON k = lower(p_name) WHERE p_partkey % 2 = 1")
def lookup_match_counts(spark, sf_dir):
    return matched(spark, sf_dir).agg(F.count_if(F.col("found").isNotNull()).alias("matched"), F.count_if(F.col("found").isNull()).alias("unmatched"))


# convergence --------------------------------------------------------------------------------------


@query(
    "SELECT 'quality' AS column_name, 'fill_nulls' AS mode, count(*) - count(quality) AS null_count, count(*) AS dirty_rows FROM documents LEFT JOIN labels USING (doc_id)"
    " UNION ALL SELECT 'cleaned', 'add_new', 0, count(*) FROM documents"
)
def diff_plan(spark, sf_dir):
    d = {
        "name": "docs", "dataset_path": "docs", "workflow_version": "1", "primary_key": "doc_id",
        "columns": [{"name": "doc_id"}, {"name": "lang"}, {"name": "source"}]
        + [{"name": n, "processor": "clean_name", "derived_from": ["lang"]} for n in ("quality", "cleaned")],
    }
    plan = Engine(parse(d), labelled(spark, sf_dir)).diff()
    rows = [(t.column.name, t.mode, t.null_count, plan.dirty_row_count) for t in plan.tasks]
    return spark.createDataFrame(rows, "column_name string, mode string, null_count bigint, dirty_rows bigint")


@query(
    "SELECT d.doc_id, CASE WHEN quality IS NULL THEN upper(lang[1]) || lower(lang[2:]) ELSE CAST(quality AS VARCHAR) END AS grade FROM documents d LEFT JOIN labels USING (doc_id)"
)
def fill_nulls(spark, sf_dir):
    d = {
        "name": "docs", "dataset_path": "docs", "workflow_version": "1", "primary_key": "doc_id",
        "columns": [{"name": "doc_id"}, {"name": "lang"}, {"name": "grade", "processor": "clean_name", "derived_from": ["lang"]}],
    }
    rows = labelled(spark, sf_dir).read().select("doc_id", "lang", F.col("quality").cast("string").alias("grade"))
    e = Engine(parse(d), stored(spark, "graded", "doc_id", rows))
    e.converge()
    return e.table.read(["doc_id", "grade"])


@query(
    f"WITH c AS (SELECT p_partkey, {_CLEAN.format(_MESSY)} AS cleaned_name, {_CLEAN_SKILLS.format(_SKILLS)} AS cleaned_skills FROM part)"
    " SELECT *, CAST(64 AS INT) AS dimensions FROM c"
)
def converge_two_levels(spark, sf_dir):
    return flagship(spark, sf_dir).select("p_partkey", "cleaned_name", "cleaned_skills", F.size("profile_embedding").alias("dimensions"))


@query(
    "WITH n AS (SELECT count(*) AS n, count(*) FILTER (p_partkey % 7 = 0) AS k FROM part)"
    " SELECT 'fresh' AS run, CAST(2 AS BIGINT) AS passes, n + k AS rows_processed, CAST(2 AS BIGINT) AS columns_computed FROM n"
    " UNION ALL SELECT 'again', 1, k, 1 FROM n"
)
def converge_counters(spark, sf_dir):
    """Every seventh name is NULL for good: computed with the rest, once more, then taken for stuck."""
    raw = raw_profiles(spark, sf_dir).withColumn("name", F.when(F.col("p_partkey") % 7 != 0, F.col("name")))
    e = profiles(spark, sf_dir, ["cleaned_name"], raw)
    rows = [(run, r.passes, r.rows_processed, len(r.columns_computed)) for run, r in (("fresh", e.converge()), ("again", e.converge()))]
    return spark.createDataFrame(rows, "run string, passes bigint, rows_processed bigint, columns_computed bigint")


def converged_repos(spark, sf_dir, where: str = "true") -> DataFrame:
    """Repos with some or all parts, matched against people with all parts."""
    part = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    common = {"workflow_version": "1", "primary_key": "p_partkey"}
    raw = [{"name": "p_partkey"}, {"name": "name"}, {"name": "cleaned_name", "processor": "clean_name", "derived_from": ["name"]}]
    look = {"workflow": "people", "on": "cleaned_name", "match_columns": ["cleaned_name", "p_partkey"]}
    match = {"name": "linkedin_match", "processor": "match_linkedin_profile", "derived_from": ["cleaned_name"], "lookup": look}
    ws = [parse(common | {"name": "repos", "dataset_path": "r", "columns": [*raw, match]}), parse(common | {"name": "people", "dataset_path": "p", "columns": raw})]
    tables = {"repos": stored(spark, "repos", "p_partkey", part.where(where), ["p_partkey"]), "people": stored(spark, "people", "p_partkey", part, ["p_partkey"])}
    rows = lambda n, path=None: tables[n].read_version(tables[n].version())
    order = list(converge_all({w.name: Engine(w, tables[w.name], rows) for w in ws}))
    return tables["repos"].read(["p_partkey", "cleaned_name", "linkedin_match"]).withColumn("run_order", F.lit(",".join(order)))


@query(
    f"WITH e AS (SELECT lower({_CLEAN.format('p_name')}) AS k, CAST(max(p_partkey) AS VARCHAR) AS id FROM part GROUP BY 1)"
    f" SELECT p_partkey, {_CLEAN.format('p_name')} AS cleaned_name, id AS linkedin_match, 'people,repos' AS run_order FROM part JOIN e ON k = lower({_CLEAN.format('p_name')}) WHERE p_partkey % 2 = 1"
)
def converge_all_order(spark, sf_dir):
    return converged_repos(spark, sf_dir, "p_partkey % 2 = 1")


@query(
    f"WITH e AS (SELECT lower({_CLEAN.format('p_name')}) AS k, CAST(max(p_partkey) AS VARCHAR) AS id FROM part GROUP BY 1)"
    f" SELECT p_partkey, {_CLEAN.format('p_name')} AS cleaned_name, id AS linkedin_match, 'people,repos' AS run_order FROM part JOIN e ON k = lower({_CLEAN.format('p_name')})"
)
def converge_all_order_whole(spark, sf_dir):
    """All parts in repos, where the SQL given for converge_all_order asks for every other one."""
    return converged_repos(spark, sf_dir)


@query("SELECT * FROM (VALUES (0, 'cleaned_name'), (0, 'cleaned_skills'), (1, 'profile_embedding')) AS t(level, column_name)")
def column_levels(spark, sf_dir):
    rows = [(k, c.name) for k, layer in enumerate(graph.column_levels(parse(PROFILES))) for c in layer]
    return spark.createDataFrame(rows, "level int, column_name string")


# leases, records, streams -------------------------------------------------------------------------


@query(
    "SELECT count(*) FILTER (c_custkey % 3 = 0) AS first_taken, count(*) FILTER (c_custkey % 2 = 0 AND c_custkey % 3 <> 0) AS second_taken,"
    " count(*) FILTER (c_custkey % 6 = 0) AS second_refused, count(*) FILTER (c_custkey % 3 = 0) AS released FROM customer"
)
def lease_counts(spark, sf_dir):
    ids = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    leases = Leases(spark, scratch.path(spark, "leases"))
    first, _ = leases.acquire("w", ids.where("id % 3 = 0"), "one")
    second, refused = leases.acquire("w", ids.where("id % 2 = 0"), "two")
    n = [first.count(), second.count(), refused.count(), leases.release("w", ids, "one")]
    return spark.createDataFrame([tuple(n)], "first_taken bigint, second_taken bigint, second_refused bigint, released bigint")


@query("SELECT CAST(p_partkey AS VARCHAR) AS member_id, p_name AS name, p_brand AS skills FROM part")
def protobuf_ingest(spark, sf_dir):
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("member_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("skills"))

    def pack(batches):
        import pyarrow as pa

        cls = records.message_class("ProfileBatch")
        for b in batches:
            body = cls(profiles=b.to_pylist()).SerializeToString()
            yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary())], names=["body"])

    t = scratch.table(spark, "members", "member_id")
    t.append(records.from_protobuf(part.mapInArrow(pack, "body binary"), "member_id"))
    return t.read()


@query("SELECT 'member_' || lpad(CAST(i AS VARCHAR), 6, '0') AS member_id, true AS spaced, true AS known FROM range(100, 400) AS t(i)")
def synthetic_profiles(spark, sf_dir):
    made = records.linkedin(spark, 300, 100)
    tokens = F.split(F.regexp_replace(F.lower("skills"), " ", ""), ",")
    known = F.size(F.array_except(tokens, F.array(*map(F.lit, records.SKILLS)))) == 0
    return made.select("member_id", F.col("name").rlike("^  [A-Z][a-z]+ [A-Z][a-z]+  $").alias("spaced"), (known & F.size(F.array_distinct(tokens)).between(2, 6)).alias("known"))


@query(
    "SELECT user_id AS member_id, max_by('  ' || event_type || ' ', event_id) AS name, max_by(coalesce(CAST(floor(value) AS INT), 0), event_id) AS skills,"
    f" {_CLEAN.format('max_by(event_type, event_id)')} AS cleaned_name FROM events GROUP BY user_id"
)
def stream_mapping_upsert(spark, sf_dir):
    """A stream with names of its own, renamed into the dataset, the last row of a key kept, converged."""
    events = load(spark, sf_dir, "events")
    made = events.select("event_id", "user_id", F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("full_name"), F.coalesce(F.floor("value").cast("int"), F.lit(0)).alias("raw_skills"))
    landing = scratch.path(spark, "landing")
    made.repartitionByRange(3, "event_id").write.parquet(landing)
    source = Source("stream_A", None, {"user_id": "member_id", "full_name": "name", "raw_skills": "skills"})
    d = {
        "name": "people", "dataset_path": "p", "workflow_version": "1",
        "columns": [{"name": "member_id", "type": "int64"}, {"name": "name"}, {"name": "skills"}, {"name": "cleaned_name", "processor": "clean_name", "derived_from": ["name"]}],
    }
    stream = streams.renamed(streams.files(spark, landing, made.schema), source)
    t = scratch.table(spark, "people", "member_id")
    t.append(spark.createDataFrame([], "member_id bigint, name string, skills int"))
    order = [F.col("event_id")]
    done = streams.start(stream, t, scratch.path(spark, "checkpoint"), order_by=order, engine=Engine(parse(d), t))
    done.awaitTermination()
    return t.read()
