"""Diff and converge: find derived columns that are missing or have NULLs, compute just these, repeat.

A pass goes through the column levels. All ready tasks of a level become one plan: native expressions are
one projection, pandas UDFs run in place on the rows that need them, lookups are joins by ``_seq``;
the level is one commit. Of a dataset whose columns all exist, just the fragments with NULLs in them are written anew.
If that plan fails, its columns are tried one by one, so that only the
faulty ones fail. Counters come from the diff and the commits, not from extra scans.

A run with a journal can be taken up again by its id: what its entries tell is counted in, and it goes on with the
pass after the last one that was finished; a run that had ended gives its result again.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column as Col
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colstate.operators import processors
from colstate.plans import graph
from colstate.plans.model import Column, Workflow
from colstate.sources.snapshots import SEQ, Conflict, SnapshotTable

ADD_NEW, FILL_NULLS = "add_new", "fill_nulls"


@dataclass(frozen=True)
class Task:
    column: Column
    mode: str
    null_count: int = 0


@dataclass
class Plan:
    tasks: list[Task] = field(default_factory=list)
    dirty_row_count: int = 0
    fragment_count: int = 0

    @property
    def empty(self) -> bool:
        return not self.tasks


@dataclass
class Result:
    columns_computed: list[str] = field(default_factory=list)
    columns_failed: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)  # of each failed column, why
    rows_processed: int = 0
    fragments_before: int = 0
    fragments_after: int = 0
    compaction_run: bool = False
    passes: int = 0
    duration_seconds: float = 0.0

    def as_row(self, spark: SparkSession) -> DataFrame:
        kind = (
            "columns_computed array<string>, columns_failed array<string>, rows_processed bigint, fragments_before bigint,"
            " fragments_after bigint, compaction_run boolean, passes bigint, duration_seconds double"
        )
        return spark.createDataFrame([tuple(v for k, v in vars(self).items() if k != "errors")], kind)


class Engine:
    """Of one workflow. ``catalogue``: the rows (with ``_seq``) of another dataset by its name and path, None if absent."""

    def __init__(
        self,
        workflow: Workflow,
        table: SnapshotTable,
        catalogue: Callable[..., DataFrame | None] = lambda name, path=None: None,
        leases=None,
        sleep: Callable[[float], None] = time.sleep,
        journal=None,
    ):
        self.workflow, self.table, self.catalogue, self.leases, self.sleep, self.journal = workflow, table, catalogue, leases, sleep, journal

    # diff -------------------------------------------------------------------------------------

    def diff(self) -> Plan:
        """One aggregate over all derived columns that exist; columns that don't are new."""
        v = self.table.version()
        if v is None:
            return Plan()
        have = [c for c in self.workflow.derived_columns if c.name in v.schema.names]
        nulls = self.table.null_counts([c.name for c in have])
        tasks = []
        for c in self.workflow.derived_columns:
            if c.name not in nulls:
                tasks.append(Task(c, ADD_NEW))
            elif nulls[c.name]:
                tasks.append(Task(c, FILL_NULLS, nulls[c.name]))
        return Plan(tasks, v.rows, len(v.fragments))

    # converge ---------------------------------------------------------------------------------

    def converge(self, plan: Plan | None = None, journal=None) -> Result:
        """Compute what is missing. ``journal``: that of a run, which is taken up again if it has entries."""
        run, journal = journal, journal if journal is not None else self.journal
        began, out = time.monotonic(), Result(fragments_before=self.table.fragmentation())
        before: dict[str, int] = {}  # NULLs that the last pass that filled a column has met
        first = 1
        if run is not None:
            if (ended := run.result(self.workflow.name)) is not None:
                return Result(**ended)
            for e in run.entries(self.workflow.name):
                if e["pass"] > first or not out.passes:  # of the last pass, what its columns had met when they were filled
                    before, first = {}, e["pass"]
                before |= {k: n for k, n in e["nulls"].items() if k in e["computed"]}
                out.columns_computed += e["computed"]
                out.columns_failed += e["failed"]
                out.errors |= e["errors"]
                out.rows_processed += e["rows"]
                out.passes = first
        plan = plan or self.diff()
        for number in range(first, self.workflow.max_passes + 1):
            # a column with as many NULLs as when it was last filled is stuck; the plan itself isn't changed
            todo = [t for t in plan.tasks if t.mode == ADD_NEW or before.get(t.column.name) != t.null_count]
            if not todo:
                break
            before |= {t.column.name: t.null_count for t in plan.tasks if t.mode == FILL_NULLS}
            out.passes = number
            self._pass(todo, out, number, journal, before)
            plan = self.diff()
            if plan.empty:
                break
        out.compaction_run = self.table.compact(self.workflow.compaction_threshold)
        out.fragments_after = self.table.fragmentation()
        out.duration_seconds = time.monotonic() - began
        if run is not None:
            run.finish(self.workflow.name, vars(out))
        return out

    def _pass(self, tasks: list[Task], out: Result, number: int, journal=None, nulls: dict[str, int] | None = None) -> None:
        by_name = {t.column.name: t for t in tasks}
        for k, layer in enumerate(graph.column_levels(self.workflow)):
            have = set(self.table.columns())
            ready = [by_name[c.name] for c in layer if c.name in by_name and set(c.derived_from) <= have]
            if not ready:
                continue
            done, failed, rows = self._level(ready)
            out.columns_computed += done
            out.columns_failed += list(failed)
            out.errors |= failed
            out.rows_processed += rows
            if journal is not None:
                journal.record(self.workflow.name, number, k, done, failed, rows, self.table.version().number, nulls or {})

    def _level(self, tasks: list[Task]) -> tuple[list[str], dict[str, str], int]:
        """Columns computed, columns failed and why, rows processed: counted when committed."""
        if len(tasks) > 1:
            try:
                rows = self._commit(tasks)
                return [t.column.name for t in tasks], {}, rows
            except Exception:  # noqa: BLE001  one of them fails: see which
                pass
        done, failed, rows = [], {}, 0
        for t in tasks:
            got = self._with_retry(t)
            if isinstance(got, str):
                failed[t.column.name] = got
            else:
                done.append(t.column.name)
                rows += got
        return done, failed, rows

    def _with_retry(self, task: Task) -> int | str:
        """The rows computed, or why the last attempt failed."""
        why = ""
        for attempt in range(self.workflow.max_retries + 1):
            try:
                return self._commit([task])
            except Exception as e:  # noqa: BLE001  a processor may raise anything
                why = f"{type(e).__name__}: {e}"[:2000]
                if attempt < self.workflow.max_retries:
                    self.sleep(min(2**attempt, 10))
        return why

    def _commit(self, tasks: list[Task]) -> int:
        """Compute the tasks on the newest version and commit; on a lost race, once more on the next version."""
        for _ in range(10):
            base = self.table.version()
            owner = taken = None
            if self.leases is not None:
                owner = f"converge-{id(self)}-{time.time_ns()}"
                ids = self.table.read_version(base).select(F.col(self.workflow.primary_key).alias("id"))
                taken, _ = self.leases.acquire(self.workflow.name, ids, owner)
                taken = taken.withColumnRenamed("id", "_id").withColumn("_mine", F.lit(True))
            settings = self._batches(tasks)
            try:
                touched, rest = self._touched(base, tasks)
                rows, schema, count = self.computed(base, tasks, taken, touched)
                self.table.replace_all(base, rows, schema, rest)
                return count
            except Conflict:
                continue
            finally:
                self._restore(settings)
                if self.leases is not None:
                    self.leases.release(self.workflow.name, ids, owner)
        raise Conflict(f"{self.table.path} changes faster than its columns are computed")

    _BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def _batches(self, tasks: list[Task]) -> str | None:
        """Set the smallest batch that a column of the level asks for; what was set before."""
        asked = [t.column.scaling.batch_size for t in tasks if t.column.scaling.batch_size > 0]
        before = self.table.spark.conf.get(self._BATCH, None)
        if asked:
            self.table.spark.conf.set(self._BATCH, str(min(asked)))
        return before

    def _restore(self, before: str | None) -> None:
        if before is None:
            self.table.spark.conf.unset(self._BATCH)
        else:
            self.table.spark.conf.set(self._BATCH, before)

    def _touched(self, base, tasks: list[Task]) -> tuple[list[dict] | None, list[dict]]:
        """The fragments with NULLs to fill, and those that can stay; a new column is for all of them."""
        if any(t.mode == ADD_NEW and t.column.name not in base.schema.names for t in tasks):
            return None, []
        null = reduce(Col.__or__, [F.col(t.column.name).isNull() for t in tasks])
        return self.table.holding(base, null)

    def computed(self, base, tasks: list[Task], taken: DataFrame | None = None, fragments: list[dict] | None = None) -> tuple[DataFrame, T.StructType, int]:
        """The rows of a version (or some of its fragments) with the tasks' columns, their schema, and the values computed."""
        rows = self.table.read_version(base, fragments)
        mine = F.lit(True)
        if taken is not None:
            rows = rows.join(taken, F.col(self.workflow.primary_key).cast("string") == F.col("_id"), "left").drop("_id")
            mine = F.col("_mine").isNotNull()
        fields, native, deltas, count = list(base.schema.fields), {}, [], 0
        names = [f.name for f in fields]
        for t in tasks:
            c, p = t.column, processors.get(t.column.processor)
            count += base.rows if t.mode == ADD_NEW else t.null_count
            if c.name not in names:
                fields.append(T.StructField(c.name, p.type))
                names.append(c.name)
                rows = rows.withColumn(c.name, F.lit(None).cast(p.type))
            inputs = [F.col(d) for d in c.derived_from]
            need = F.col(c.name).isNull() & mine
            if p.kind == "expression":
                native[c.name] = F.when(need, p.run(*inputs)).otherwise(F.col(c.name))
                continue
            if p.kind == "vectorised":
                # in place, as what a join by _seq would bring back is many times its files' size, by which Spark decides to broadcast it
                if c.scaling.parallelism > 1:
                    rows = rows.repartition(c.scaling.parallelism)
                if taken is None and c.name not in base.schema.names:
                    native[c.name] = p.run(*inputs).cast(p.type)
                    continue
                # just the rows that need it go to Python
                rows = rows.where(need).withColumn(f"_new_{c.name}", p.run(*inputs)).unionByName(rows.where(~need), allowMissingColumns=True)
                native[c.name] = F.when(need, F.col(f"_new_{c.name}")).otherwise(F.col(c.name))
                continue
            # a relation sees only the rows that need it, which come back by _seq
            dirty = self.table.read_version(base, fragments)
            if t.mode == FILL_NULLS:
                dirty = dirty.where(F.col(c.name).isNull())
            dirty = dirty.select(SEQ, *dict.fromkeys(c.derived_from))
            if c.scaling.parallelism > 1:
                dirty = dirty.repartition(c.scaling.parallelism)
            delta = p.run(dirty, c, self.catalogue, SEQ).select(SEQ, F.col(c.name).alias("_value"))
            delta = delta.withColumnRenamed("_value", f"_new_{c.name}")
            deltas.append(delta)
            native[c.name] = F.when(need, F.col(f"_new_{c.name}")).otherwise(F.col(c.name))
        for delta in deltas:
            rows = rows.join(delta, SEQ, "left")
        rows = rows.withColumns(native)
        return rows.select(*names, SEQ), T.StructType(fields), count


def converge_all(engines: dict[str, Engine], journal=None) -> dict[str, Result]:
    """Each workflow after those it looks up; with the journal of a run, those that had ended give their results again."""
    order = graph.workflow_order([e.workflow for e in engines.values()])
    return {name: engines[name].converge(journal=journal) for name in order}
