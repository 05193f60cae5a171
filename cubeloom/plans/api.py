"""The explorer's requests as functions: a path and arguments in, JSON-ready rows out."""

from __future__ import annotations

from typing import Any

from ..operators import inventory
from . import explorer as X
from .cube import Cube

GET = {
    "summary": lambda c, a: {k: rows(v) for k, v in inventory.summary(c).items()},
    "configs": lambda c, a: rows(X.list_configs_detailed(c, a["scorer"])),
    "predicates": lambda c, a: rows(X.predicate_fields(c)),
    "meta-fields": lambda c, a: rows(X.meta_fields(c.query.select(X.compact_meta(X.F.col("meta")).alias("meta")), "meta")),
    "artifact": lambda c, a: rows(X.execution_artifact(c, int(a["execution_id"]))),
}
POST = {
    "slices": lambda c, a: rows(X.slice_scores(c, a["model"], a["scorer"], a["group_by"], [tuple(f) for f in a.get("filters", [])], a.get("config_ids"), a.get("base"), a.get("limit", 500))),
    "examples": lambda c, a: rows(X.examples(c, a["model"], a["scorer"], [tuple(f) for f in a.get("filters", [])], a.get("ascending", True), a.get("limit", 50))),
    "compare": lambda c, a: rows(X.compare_configs(c, a["base"], a["target"], a["model"], a["scorer"]).groupBy("direction").count()),
    "compare-examples": lambda c, a: rows(X.comparison_examples(c, a["base"], a["target"], a["model"], a["scorer"], a["direction"], a.get("limit", 50))),
    "diagnostics": lambda c, a: rows(X.diagnostics(c, a["model"], a["scorer"], a.get("config_id"))),
    "feature-labels": lambda c, a: rows(X.label_analysis(c, a["model"], a["scorer"], a["base"])),
    "plan-delete-preview": lambda c, a: rows(X.plan_delete_preview(c, a.get("models", []), a.get("config_ids", []), [tuple(f) for f in a.get("filters", [])], a.get("limit", 20))),
    "plan-delete": lambda c, a: rows(X.plan_delete(c, a.get("models", []), a.get("config_ids", []), [tuple(f) for f in a.get("filters", [])])),
}


def rows(df) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def handle(cube: Cube, method: str, path: str, arguments: dict[str, Any]) -> dict[str, Any]:
    """{"ok": true, "data": ...} or {"ok": false, "error": ...}."""
    table = {"GET": GET, "POST": POST}.get(method, {})
    name = path.strip("/").removeprefix("api/")
    if name not in table:
        return {"ok": False, "error": f"no such request: {method} {path}"}
    try:
        return {"ok": True, "data": table[name](cube, arguments)}
    except KeyError as e:
        return {"ok": False, "error": f"missing argument {e.args[0]}"}
    except ValueError as e:
        return {"ok": False, "error": str(e)}
