"""Schemas of the cube tables, and content-addressed identities."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _D, _TS = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType()
_A = T.ArrayType(T.StringType())

TABLES: dict[str, T.StructType] = {
    name: T.StructType([T.StructField(c, t) for c, t in fields.items()])
    for name, fields in {
        "func": {"func_id": _S, "func_type": _S, "params": _S, "meta": _S},
        "query": {"query_id": _S, "dataset": _S, "content": _S, "meta": _S},
        "config": {"config_id": _L, "func_ids": _A, "meta": _S},
        "execution": {
            "execution_id": _L, "config_id": _L, "query_id": _S, "model": _S, "system_prompt": _S, "user_content": _S, "raw_response": _S, "prediction": _S,
            "latency_ms": _D, "prompt_tokens": _L, "completion_tokens": _L, "error": _S, "phase_ids": _A, "created_at": _TS, "meta": _S,
        },
        "evaluation": {"eval_id": _L, "execution_id": _L, "scorer": _S, "score": _D, "metrics": _S, "created_at": _TS},
        "predicate": {"query_id": _S, "name": _S, "value": _S},
        "feature": {"feature_id": _S, "canonical_id": _S, "task": _S, "requires": _A, "conflicts": _A, "primitive_spec": _S, "semantic_labels": _S, "scope": _S, "rationale": _S, "source_path": _S, "synced_at": _TS},
        "config_feature": {"config_id": _L, "feature_id": _S, "role": _S},
        "feature_label": {"label_id": _S, "description": _S, "created_at": _TS},
        "feature_label_membership": {"feature_id": _S, "label_id": _S, "role": _S, "created_at": _TS},
    }.items()
}

#: The columns that identify a row; an execution is also the key of the call cache.
KEYS: dict[str, tuple[str, ...]] = {
    "func": ("func_id",), "query": ("query_id",), "config": ("config_id",), "execution": ("config_id", "query_id", "model"), "evaluation": ("execution_id", "scorer"),
    "predicate": ("query_id", "name"), "feature": ("feature_id",), "config_feature": ("config_id", "feature_id"), "feature_label": ("label_id",), "feature_label_membership": ("feature_id", "label_id", "role"),
}
VERSION = 9


def query_key(dataset: Column, context: Column, content: Column) -> Column:
    """Content-addressed id of a benchmark item."""
    return F.substring(F.sha2(F.concat_ws(":", dataset, context, F.trim(content)), 256), 1, 16)


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True)


def func_key(func_type: str, params: dict) -> str:
    """Content-addressed id of a prompt edit; the params' JSON is made on the driver, where key order is fixed."""
    return hashlib.sha256(f"{func_type}:{canonical_json(normal_params(func_type, params))}".encode()).hexdigest()[:12]


def normal_params(func_type: str, params: dict) -> dict:
    """Params with an inserted node's defaults filled in and its text trimmed."""
    if func_type != "insert_node":
        return params
    out = {"parent_id": "__root__", **params}
    payload = dict(out.get("payload") or {})
    if isinstance(payload.get("content"), str):
        payload["content"] = payload["content"].strip()
    return {**out, "payload": payload}


def targeted_key(base: str, module: str | None, main: str = "main") -> str:
    """Id of an edit aimed at a module; the main module keeps the plain id."""
    return base if module in (None, "", main) else hashlib.sha256(f"{base}:{module}".encode()).hexdigest()[:12]


def feature_key(edits: list[dict]) -> str:
    """Id of a bundle of edits: order, name and rationale do not matter."""
    keys = sorted(targeted_key(func_key(e["func_type"], e.get("params", {})), e.get("target_module")) for e in edits)
    return hashlib.sha256(canonical_json(keys).encode()).hexdigest()[:12]


def config_key(func_ids: Column) -> Column:
    """Configurations are equal when their sorted func ids are; duplicates count."""
    return F.to_json(F.array_sort(func_ids))
