"""Processors by name. Three kinds, which the engine plans differently:

* ``expression``  columns -> column, native: fused with others of its level into one projection;
* ``vectorised``  columns -> column by a pandas UDF: run on the rows that need it only;
* ``relation``    (rows, column definition, catalogue) -> rows with the column: a join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

from colstate.functions import text
from colstate.operators import lookup as lookups
from colstate.plans.model import Column


@dataclass(frozen=True)
class Processor:
    name: str
    kind: str
    run: Callable
    type: T.DataType


REGISTRY: dict[str, Processor] = {}


def register(name: str, kind: str = "expression", type: T.DataType | None = None):
    """Decorator; a later registration of a name replaces the earlier."""
    if kind not in ("expression", "vectorised", "relation"):
        raise ValueError(f"unknown kind of processor: {kind}")

    def put(run: Callable) -> Callable:
        REGISTRY[name] = Processor(name, kind, run, type or T.StringType())
        return run

    return put


def get(name: str) -> Processor:
    """KeyError for unknown names, when a column is computed."""
    return REGISTRY[name]


@register("clean_name")
def clean_name(*columns):
    return text.clean_name(columns[0])


@register("clean_name_strict", "vectorised")
def clean_name_strict(*columns):
    return text.clean_name_strict(columns[0])


@register("clean_skills")
def clean_skills(*columns):
    return text.clean_skills(columns[0])


@register("mock_embedding", "vectorised", text.VECTOR)
def mock_embedding(*columns):
    return text.mock_embedding(*columns)


@register("match_linkedin_profile", "relation")
def match_profile(rows, column: Column, catalogue, seq: str):
    """The id of the looked-up dataset's row with the same or the most similar name."""
    if column.lookup is None:
        return rows.withColumn(column.name, F.lit(None).cast("string"))
    names = tuple(column.lookup.match_columns)
    name, id_ = names if len(names) == 2 else (names[0], names[-1])
    ext = catalogue(column.lookup.workflow, column.lookup.dataset_path)
    return lookups.lookup(rows, column.lookup.on or column.derived_from[0], ext, (name, id_), seq, column.name)
