"""Edits folded in a fixed order into a prompt state, and the styles that render it."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edits apply by type, inserted nodes by kind, then by ordinal and id.
TYPE_ORDER = {"set_format": 0, "set_table_format": 1, "input_transform": 2, "insert_node": 3, "update_node": 4, "add_example": 5}
NODE_ORDER = {"section": 0, "group": 1, "rule": 2, "input_field": 3, "output_field": 4}
LAST = 99


@dataclass(frozen=True)
class Node:
    node_id: str
    node_type: str
    parent_id: str
    payload: dict[str, Any]


@dataclass(frozen=True)
class PromptState:
    instruction: str = ""
    style: str = "plain"
    table_format: str = "markdown"
    transforms: tuple[str, ...] = ()
    nodes: tuple[Node, ...] = ()
    examples: tuple[dict, ...] = ()
    disabled: frozenset[str] = field(default_factory=frozenset)

    def children(self, parent: str = "__root__", kind: str | None = None) -> list[Node]:
        return [n for n in self.nodes if n.parent_id == parent and n.node_id not in self.disabled and kind in (None, n.node_type)]

    def without(self, *node_ids: str) -> PromptState:
        """Nodes switched off, with all below them."""
        gone, queue = set(self.disabled), list(node_ids)
        while queue:
            at = queue.pop()
            gone.add(at)
            queue += [n.node_id for n in self.nodes if n.parent_id == at]
        return replace(self, disabled=frozenset(gone))

    def fields(self, kind: str) -> list[dict]:
        return [n.payload for n in self.nodes if n.node_type == kind and n.node_id not in self.disabled]


def sort_key(func: dict) -> tuple:
    params = func.get("params") or {}
    return (TYPE_ORDER.get(func["func_type"], LAST), NODE_ORDER.get(params.get("node_type", ""), LAST), (params.get("payload") or {}).get("ordinal", 0) or 0, func["func_id"])


def order_columns(func_type: Column, params: Column) -> list[Column]:
    """The same order as sort keys of a func table."""
    rank = lambda c, table: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(LAST))
    path = lambda p: F.get_json_object(params, p)
    return [rank(func_type, TYPE_ORDER), rank(F.coalesce(path("$.node_type"), F.lit("")), NODE_ORDER), F.coalesce(path("$.payload.ordinal").try_cast("int"), F.lit(0))]


def ordered_funcs(funcs: DataFrame) -> DataFrame:
    """A func table with the place of each edit in the fold."""
    from pyspark.sql import Window

    keys = order_columns(F.col("func_type"), F.col("params"))
    return funcs.withColumn("place", F.row_number().over(Window.orderBy(*keys, "func_id")))


def fold(funcs: list[dict], start: PromptState | None = None) -> PromptState:
    """Apply edits in order; an update changes an inserted node's payload, and one of an unknown node nothing."""
    state = start or PromptState()
    for f in sorted(funcs, key=sort_key):
        params, kind = f.get("params") or {}, f["func_type"]
        if kind == "insert_node":
            state = replace(state, nodes=(*state.nodes, Node(f["func_id"], params.get("node_type", "rule"), params.get("parent_id", "__root__"), dict(params.get("payload") or {}))))
        elif kind == "update_node":
            state = replace(state, nodes=tuple(replace(n, payload={**n.payload, **(params.get("payload") or {})}) if n.node_id == params.get("node_id") else n for n in state.nodes))
        elif kind == "set_format":
            state = replace(state, style=params.get("style", state.style))
        elif kind == "set_table_format":
            state = replace(state, table_format=params.get("format", state.table_format))
        elif kind == "input_transform":
            state = replace(state, transforms=(*state.transforms, params["name"]))
        elif kind == "add_example":
            state = replace(state, examples=(*state.examples, dict(params)))
        else:
            raise ValueError(f"unknown edit {kind!r}")
    return state


def fold_modules(funcs: list[dict], main: str = "main") -> dict[str, PromptState]:
    """One state for each module that edits aim at."""
    by: dict[str, list[dict]] = {}
    for f in funcs:
        by.setdefault((f.get("params") or {}).get("target_module") or main, []).append(f)
    return {m: fold(fs) for m, fs in sorted(by.items())}


def _rule_lines(state: PromptState, parent: str, depth: int = 0) -> list[str]:
    out = []
    for i, node in enumerate(state.children(parent), 1):
        if node.node_type in ("section", "group"):
            out.append(f"{'#' * (depth + 2)} {node.payload.get('title', '')}".rstrip())
            out += _rule_lines(state, node.node_id, depth + 1)
        elif node.node_type == "rule":
            out.append(f"{i}. {node.payload.get('content', '')}")
    return out


STYLES = ("plain", "markdown", "yaml", "json", "code_block")


def system_text(state: PromptState) -> str:
    if state.style not in STYLES:
        raise ValueError(f"unknown style {state.style!r}")
    fields = state.fields("output_field") or [{"name": "answer", "description": ""}]
    rules = "\n".join(_rule_lines(state, "__root__"))
    names = [f["name"] for f in fields]
    want = {
        "plain": "\n".join(f"{n}: ..." for n in names),
        "markdown": "\n".join(f"**{n}**: ..." for n in names),
        "yaml": "\n".join(f"{n}: |\n  ..." for n in names),
        "json": json.dumps(dict.fromkeys(names, "...")),
        "code_block": "\n".join(f"```{n}\n...\n```" for n in names),
    }[state.style]
    return "\n\n".join(x for x in (state.instruction, rules, "Answer as:\n" + want) if x)


def user_text(state: PromptState, record: dict[str, Any]) -> str:
    wanted = [f["name"] for f in state.fields("input_field")] or sorted(record)
    return "\n".join(f"{n}: {record.get(n, '')}" for n in wanted)


def messages(state: PromptState, record: dict[str, Any]) -> list[dict[str, str]]:
    out = [{"role": "system", "content": system_text(state)}]
    for e in state.examples:
        out += [{"role": "user", "content": str(e.get("input", ""))}, {"role": "assistant", "content": str(e.get("output", ""))}]
    return [*out, {"role": "user", "content": user_text(state, record)}]


def render_prompts(state: PromptState, records: DataFrame) -> DataFrame:
    """The prompt of every record, on the executors; the state is small and travels with the task."""
    import pandas as pd

    names = records.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema)

    def run(batches):
        for frame in batches:
            frame = frame.copy()
            frame["system_prompt"] = system_text(state)
            frame["user_content"] = [user_text(state, r) for r in frame[names].to_dict("records")] if len(frame) else pd.Series(dtype=str)
            yield frame

    return records.mapInPandas(run, f"{fields}, system_prompt string, user_content string")
