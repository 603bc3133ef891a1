"""Workflow definitions: what a dataset's columns are and where they come from."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import types as T

#: Type labels of a definition; others mean string.
LABELS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "vector": T.ArrayType(T.FloatType()),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def spark_type(label: str) -> T.DataType:
    return LABELS.get(label, T.StringType())


@dataclass(frozen=True)
class Scaling:
    parallelism: int = 1
    num_cpus: int = 1
    num_gpus: int = 0
    batch_size: int = 0


@dataclass(frozen=True)
class Lookup:
    """A join into another dataset: ``on`` is this side's column (by default the first that the derived one comes from),
    ``match_columns`` the other's (name, id), ``dataset_path`` where it lies if its workflow isn't known here."""

    workflow: str
    on: str | None
    match_columns: tuple[str, ...]
    dataset_path: str | None = None


@dataclass(frozen=True)
class Column:
    name: str
    type: str = "string"
    source: str | None = None
    processor: str | None = None
    derived_from: tuple[str, ...] = ()
    scaling: Scaling = Scaling()
    lookup: Lookup | None = None

    @property
    def derived(self) -> bool:
        return self.processor is not None


@dataclass(frozen=True)
class Source:
    """A stream: its topic and how its columns are renamed into the dataset's."""

    name: str
    topic: str | None = None
    mapping: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Workflow:
    name: str
    dataset_path: str
    workflow_version: str
    columns: tuple[Column, ...]
    sources: tuple[Source, ...] = ()
    execution: dict = field(default_factory=dict)
    primary_key: str = "member_id"

    @property
    def raw_columns(self) -> list[Column]:
        return [c for c in self.columns if not c.derived]

    @property
    def derived_columns(self) -> list[Column]:
        return [c for c in self.columns if c.derived]

    def column(self, name: str) -> Column:
        return next(c for c in self.columns if c.name == name)

    def raw_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in self.raw_columns])

    @property
    def max_passes(self) -> int:
        return int(self.execution.get("max_convergence_passes", 3))

    @property
    def max_retries(self) -> int:
        return int(self.execution.get("max_retries", 2))

    @property
    def compaction_threshold(self) -> int:
        return int(self.execution.get("compaction_fragment_threshold", 20))


def _column(d: dict) -> Column:
    deps, scaling, lookup = d.get("derived_from") or [], d.get("scaling") or {}, d.get("lookup")
    deps = [deps] if isinstance(deps, str) else deps
    return Column(
        name=d["name"],
        type=d.get("type", "string"),
        source=d.get("source"),
        processor=d.get("processor"),
        derived_from=tuple(deps),
        scaling=Scaling(**{k: int(scaling[k]) for k in ("parallelism", "num_cpus", "num_gpus", "batch_size") if k in scaling}),
        lookup=lookup and Lookup(lookup["workflow"], lookup.get("on"), tuple(lookup["match_columns"]), lookup.get("dataset_path")),
    )


def parse(definition: dict) -> Workflow:
    """A workflow from a parsed definition; a missing required key is a KeyError."""
    d = definition
    sources = d.get("sources") or []
    if isinstance(sources, dict):
        sources = [{"name": k} | (v or {}) for k, v in sources.items()]
    return Workflow(
        name=d["name"],
        dataset_path=d["dataset_path"],
        workflow_version=str(d["workflow_version"]),
        columns=tuple(map(_column, d["columns"])),
        sources=tuple(Source(s.get("name", f"source_{i}"), s.get("topic"), dict(s.get("mapping") or {})) for i, s in enumerate(sources)),
        execution=dict(d.get("execution_config") or {}),
        primary_key=d.get("primary_key", "member_id"),
    )


def load(path: str | Path) -> Workflow:
    with open(path, encoding="utf-8") as f:
        return parse(yaml.safe_load(f))


def load_dir(folder: str | Path, single: str | Path | None = None) -> dict[str, Workflow]:
    """All definitions of a folder, by name, in the order of file names; ``single`` if it has none."""
    found = sorted(Path(folder).glob("*.yaml")) if Path(folder).is_dir() else []
    if not found and single is not None:
        found = [Path(single)]
    return {w.name: w for w in map(load, found)}
