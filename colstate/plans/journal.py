"""Run journal: a JSON file for each finished (pass, level), so that a run can be followed and resumed.

The data is the state: converging computes only what is still missing. The journal tells what a run had done, which
version holds it and what it had met, so that a run of the same id goes on where it was cut off, counts what it
had counted before, and gives its result again when it had ended.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import SparkSession

from colstate.plans.model import Column, Lookup, Scaling


def column_to_json(c: Column) -> str:
    """A column task's input as text, lookup included."""
    return json.dumps(asdict(c), sort_keys=True)


def column_from_json(text: str) -> Column:
    d = json.loads(text)
    lookup = d.pop("lookup")
    d["derived_from"] = tuple(d["derived_from"])
    d["scaling"] = Scaling(**d["scaling"])
    if lookup:
        lookup = Lookup(**lookup | {"match_columns": tuple(lookup["match_columns"])})
    return Column(**d, lookup=lookup)


class Journal:
    def __init__(self, spark: SparkSession, path: str, run: str | None = None):
        self.spark, self.run = spark, run or uuid.uuid4().hex
        self.path = f"{path.rstrip('/')}/{self.run}"
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _put(self, name: str, body: dict) -> None:
        """Under a temporary name first: an entry is there as a whole or not at all."""
        target, temp = self._jvm_path(f"{self.path}/{name}"), self._jvm_path(f"{self.path}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, True)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        self._fs.delete(target, False)
        self._fs.rename(temp, target)

    def _get(self, path) -> dict:
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def record(self, workflow: str, number: int, level: int, done: list[str], failed: dict[str, str], rows: int, version: int, nulls: dict[str, int]) -> None:
        body = {"workflow": workflow, "pass": number, "level": level, "computed": done, "failed": list(failed), "errors": failed, "rows": rows, "version": version, "nulls": nulls}
        n = len(self.entries(workflow))  # a pass that is taken up again adds to what it had done
        self._put(f"{workflow}-{number:03d}-{level:03d}-{n:04d}.json", body)

    def begin(self, workflows: list[str]) -> None:
        """What the run is about, so that another process can take it up."""
        self._put("run.plan", {"workflows": workflows})

    def plan(self) -> list[str]:
        path = self._jvm_path(f"{self.path}/run.plan")
        return self._get(path)["workflows"] if self._fs.exists(path) else []

    def open(self) -> bool:
        """Whether a workflow of the run hasn't ended."""
        return any(self.result(w) is None for w in self.plan())

    def finish(self, workflow: str, result: dict) -> None:
        self._put(f"{workflow}.result", result)

    def result(self, workflow: str) -> dict | None:
        """What a run that has ended had found."""
        path = self._jvm_path(f"{self.path}/{workflow}.result")
        return self._get(path) if self._fs.exists(path) else None

    def entries(self, workflow: str | None = None) -> list[dict]:
        if not self._fs.exists(self._jvm_path(self.path)):
            return []
        paths = sorted((s.getPath() for s in self._fs.listStatus(self._jvm_path(self.path))), key=lambda p: p.getName())
        found = [self._get(p) for p in paths if p.getName().endswith(".json")]
        found = [e for e in found if workflow in (None, e["workflow"])]
        return sorted(found, key=lambda e: (e["workflow"], e["pass"], e["level"]))


def open_runs(spark: SparkSession, path: str) -> list[str]:
    """Ids of the runs that were begun and haven't ended."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(n for n in names if Journal(spark, path, n).open())
