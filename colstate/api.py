"""The facade: workflows by name, and what can be done with them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colstate.functions.text import table_name
from colstate.operators.locks import Leases
from colstate.plans import graph
from colstate.plans.engine import Engine, Result, converge_all
from colstate.plans.journal import Journal, open_runs
from colstate.plans.model import Workflow, load_dir
from colstate.sources import records
from colstate.sources.jdbc import JdbcTable
from colstate.sources.snapshots import SEQ, SnapshotTable

BATCH_ROWS = 500


class UnknownWorkflow(KeyError):
    pass


def dataset_uri(root: str, path: str) -> str:
    """Where a dataset lies: a relative ``dataset_path`` is one below the root."""
    return path if "://" in path or path.startswith("/") else f"{root.rstrip('/')}/{path}"


def backend_name() -> str:
    """``STORAGE_BACKEND``: "snapshot", or "jdbc" for a database at ``DATABASE_URL``."""
    backend = os.environ.get("STORAGE_BACKEND", "snapshot").lower()
    if backend not in ("snapshot", "jdbc"):
        raise ValueError(f"unknown storage backend: {backend}")
    return backend


def open_table(spark: SparkSession, workflow: Workflow, root: str) -> SnapshotTable:
    """The workflow's dataset: a snapshot table at its ``dataset_path``, or a table of a database named after the workflow."""
    if backend_name() == "jdbc":
        return JdbcTable(spark, os.environ["DATABASE_URL"], table_name(workflow.name), workflow.primary_key)
    return SnapshotTable(spark, dataset_uri(root, workflow.dataset_path), workflow.primary_key)


def descriptor(table: SnapshotTable | JdbcTable) -> dict:
    """What another process needs to open the same dataset."""
    if isinstance(table, JdbcTable):
        return {"backend": "jdbc", "url": table.url, "name": table.name, "primary_key": table.primary_key, "driver": table.driver}
    return {"backend": "snapshot", "path": table.path, "primary_key": table.primary_key}


def reopen(spark: SparkSession, d: dict) -> SnapshotTable | JdbcTable:
    if d["backend"] == "jdbc":
        return JdbcTable(spark, d["url"], d["name"], d["primary_key"], driver=d["driver"])
    return SnapshotTable(spark, d["path"], d["primary_key"])


def open_leases(spark: SparkSession) -> Leases | None:
    """Row leases in the folder that ``COLSTATE_LEASES`` names; None without it, or if it can't be reached."""
    path = os.environ.get("COLSTATE_LEASES")
    leases = Leases(spark, path) if path else None
    return leases if leases is not None and leases.ping() else None


class Colstate:
    def __init__(self, spark: SparkSession, workflows: dict[str, Workflow] | list[Workflow], root: str, *, default: str | None = None, leases: Leases | None = None, journal: str | None = None):
        found = workflows.values() if isinstance(workflows, dict) else workflows
        self.spark, self.root, self.default, self.leases, self.journal = spark, root, default, leases, journal
        self.definitions = {w.name: w for w in found}
        self.tables = {n: open_table(spark, w, root) for n, w in self.definitions.items()}
        log = Journal(spark, journal) if journal else None
        self.engines = {n: Engine(w, self.tables[n], self.rows_of, leases, journal=log) for n, w in self.definitions.items()}

    @classmethod
    def from_dir(cls, spark: SparkSession, folder: str, root: str, single: str | None = None, **options) -> Colstate:
        return cls(spark, load_dir(folder, single), root, **{"leases": open_leases(spark)} | options)

    def rows_of(self, name: str, path: str | None = None) -> DataFrame | None:
        """The rows of another workflow's dataset, or of that at a path, with their order of arrival; None if it isn't there."""
        table = self.tables.get(name)
        if table is None and path:
            table = SnapshotTable(self.spark, dataset_uri(self.root, path))
        version = table.version() if table else None
        return table.read_version(version) if version else None

    def _name(self, workflow: str | None) -> str:
        name = workflow or self.default
        if name not in self.definitions:
            raise UnknownWorkflow(f"unknown workflow: {name}")
        return name

    def _counted(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_at", F.monotonically_increasing_id())

    def workflows(self) -> dict:
        listed = [
            {"name": w.name, "dataset_path": self.tables[n].path, "primary_key": w.primary_key, "columns": [c.name for c in w.columns], "storage_backend": backend_name()}
            for n, w in self.definitions.items()
        ]
        return {"workflows": listed, "dependency_order": graph.workflow_order(list(self.definitions.values()))}

    def ingest(self, workflow: str | None = None, data: DataFrame | bytes | None = None, count: int = 500, order_by: list | None = None, seed: int = 1) -> dict:
        """Append records, a serialised batch of them, or ``count`` made-up ones; a fragment for each 500."""
        name = self._name(workflow)
        table, key = self.tables[name], self.definitions[name].primary_key
        if data is None:
            data, order_by = records.generate(self.spark, key, count, records.next_id(table), seed), [key]
        elif isinstance(data, (bytes, bytearray)):
            data = records.from_protobuf(self.spark.createDataFrame([(bytes(data),)], "body binary"), key)
        before = table.version()
        table.append(data, order_by, rows_per_fragment=BATCH_ROWS)
        new = table.read_version(table.version()).where(F.col(SEQ) >= (before.next_seq if before else 0))
        ends = records.id_range(new, key, F.col(SEQ)).first()
        n = table.count_rows() - (before.rows if before else 0)
        return {"action": "ingest", "workflow": name, "count": n, "id_range": [ends["first_id"], ends["last_id"]], "fragments": table.fragmentation()}

    def upsert(self, workflow: str | None = None, data: DataFrame | None = None, count: int = 100, updates: int = 50, on_update: str = "invalidate", order_by: list | None = None, seed: int = 5) -> dict:
        """Upsert records, or ``count`` made-up new ones and as many ``updates`` of existing ones. Leased rows are left out."""
        name = self._name(workflow)
        table, w = self.tables[name], self.definitions[name]
        key = w.primary_key
        if data is None:
            new = records.generate(self.spark, key, count, records.next_id(table), seed)
            old = table.read([key]).distinct().orderBy(key).limit(updates) if table.exists() else None
            changed = None
            if old is not None:
                fresh = records.generate(self.spark, key, updates, 0, seed + 100).drop(key)
                fresh = fresh.withColumn("name", F.concat(F.lit("  UPDATED "), F.trim("name"), F.lit("  ")))
                number = lambda df: self._counted(df.coalesce(1))  # noqa: E731  a batch of the size asked for
                changed = number(old).join(number(fresh), "_at").drop("_at")
            data, order_by = (new if changed is None else new.unionByName(changed)), [F.xxhash64(F.col(key), F.lit(seed))]
        if self.leases is not None:
            held = self.leases.locked(name, data.select(F.col(key).alias("id")))
            data = data.join(held.select(F.col("id").alias(key)), key, "left_anti")
        known = table.read([key]).distinct() if table.exists() else None
        updated = data.select(key).distinct().join(known, key, "left_semi").count() if known is not None else 0
        total = data.select(key).distinct().count()
        table.upsert(data, on_update, order_by)
        return {"action": "upsert", "workflow": name, "new": total - updated, "updates": updated, "total_records": table.count_rows(), "fragments": table.fragmentation()}

    def run(self, run: str | None = None) -> Journal:
        """The journal of a durable run, a new one without an id."""
        return Journal(self.spark, self.runs_path, run)

    @property
    def runs_path(self) -> str:
        """Beside the datasets if no other folder was named."""
        return self.journal or f"{self.root.rstrip('/')}/_runs"

    def take_up(self) -> dict:
        """Go on with all runs that were begun and haven't ended. Of two processes that go on with the same run, each computes only
        what is missing when it gets there, and commits only to the version that it has read."""
        out = {}
        for run in open_runs(self.spark, self.runs_path):
            log = self.run(run)
            mine = {n: self.engines[n] for n in log.plan() if n in self.engines}
            out[run] = {n: self._told(r) for n, r in converge_all(mine, log).items()}
        return {"runs": out}

    def match_report(self, workflow: str | None = None, column: str = "linkedin_match", matched: int = 5, unmatched: int = 3) -> dict:
        """How many rows have a value in a lookup's column, and the first ones with and without."""
        name = self._name(workflow)
        v = self.tables[name]._need()
        rows, hit = self.tables[name].read_version(v), F.col(column).isNotNull()
        n = rows.agg(F.count_if(hit).alias("n")).first()["n"]
        first = lambda which, k: [r.asDict(recursive=True) for r in rows.where(which).orderBy(SEQ).limit(k).drop(SEQ).collect()]
        return {"rows": v.rows, "matched": n, "unmatched": v.rows - n, "first_matched": first(hit, matched), "first_unmatched": first(~hit, unmatched)}

    def _begun(self, run: str | None, names: list[str]) -> Journal:
        log = self.run(run)
        if not log.plan():
            log.begin(names)
        return log

    def converge(self, workflow: str | None = None, durable: bool = False, run: str | None = None) -> dict:
        """Compute what is missing. A durable run has an id, by which it is taken up again after a crash."""
        name = self._name(workflow)
        log = self._begun(run, [name]) if durable or run else None
        out = {"workflow": name} | self._told(self.engines[name].converge(journal=log))
        return out | {"run_id": log.run} if log else out

    def converge_all(self, durable: bool = False, run: str | None = None) -> dict:
        log = self._begun(run, list(self.engines)) if durable or run else None
        results = converge_all(self.engines, log)
        out = {"dependency_order": list(results), "results": {n: self._told(r) for n, r in results.items()}}
        return out | {"run_id": log.run} if log else out

    @staticmethod
    def _told(r: Result) -> dict:
        return dict(vars(r))

    def status(self, workflow: str | None = None) -> dict:
        name = self._name(workflow)
        try:
            s = self.tables[name].stats()
        except Exception as e:  # noqa: BLE001  a damaged dataset is reported, not raised
            return {"workflow": name, "exists": False, "error": str(e)}
        return {"workflow": name, "exists": s["exists"], "rows": s["row_count"], "fragments": s["fragmentation"], "columns": s["columns"], "storage_backend": backend_name()}

    def sample(self, workflow: str | None = None, n: int = 5) -> dict:
        rows = [r.asDict(recursive=True) for r in self.tables[self._name(workflow)].sample(n).collect()]
        return {"count": len(rows), "rows": rows}

    def reset(self, workflow: str | None = None) -> dict:
        name = self._name(workflow)
        self.tables[name].drop()
        return {"message": f"dataset of {name} dropped"}

    def lifecycle(self, first: str, second: str, n: int = 500, m: int = 300) -> list[dict]:
        """Ingest both, converge the first, sample it, converge all."""
        return [self.ingest(first, count=n), self.converge(first), self.sample(first), self.ingest(second, count=m), self.converge_all()]
