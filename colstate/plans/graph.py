"""Orders of columns and of datasets. Ties keep the order of the definition, so plans are stable."""

from __future__ import annotations

from collections.abc import Hashable, Mapping, Sequence

from colstate.plans.model import Column, Workflow


def levels(nodes: Sequence[Hashable], needs: Mapping[Hashable, Sequence[Hashable]]) -> list[list[Hashable]]:
    """Layers in which each node comes after all it needs; needs outside ``nodes`` are met already."""
    known, done, left, out = set(nodes), set(), list(nodes), []
    while left:
        ready = [n for n in left if all(d in done or d not in known for d in needs.get(n, ()))]
        if not ready:
            raise ValueError(f"dependency cycle among: {', '.join(map(str, left))}")
        out.append(ready)
        done.update(ready)
        left = [n for n in left if n not in done]
    return out


def column_levels(workflow: Workflow) -> list[list[Column]]:
    """Derived columns by level; raw columns are there from the start."""
    derived = {c.name: c for c in workflow.derived_columns}
    return [[derived[n] for n in layer] for layer in levels(list(derived), {c.name: c.derived_from for c in derived.values()})]


def columns_in_order(workflow: Workflow) -> list[Column]:
    return [c for layer in column_levels(workflow) for c in layer]


def workflow_order(workflows: Sequence[Workflow]) -> list[str]:
    """Datasets after those that they look up; lookups of unknown datasets don't count, one of itself is a cycle."""
    needs = {w.name: [c.lookup.workflow for c in w.columns if c.lookup] for w in workflows}
    return [n for layer in levels([w.name for w in workflows], needs) for n in layer]
