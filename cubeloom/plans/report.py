"""Reports of ranked effects as Markdown, text or a static HTML page."""

from __future__ import annotations

import html as escape

COLUMNS = ("canonical_id", "predicate_name", "predicate_value", "lift", "did", "n_target", "n_base", "ci_lo", "ci_hi", "p_gt_zero")


def number(x) -> str:
    return "–" if x is None else f"{x:+.3f}" if isinstance(x, float) else str(x)


def interpret(row: dict) -> str:
    """One sentence on a row."""
    lift = row.get("lift")
    if lift is None:
        return f"{row['canonical_id']}: no effect could be measured where {row['predicate_name']} is {row['predicate_value']}."
    way = "raises" if lift > 0 else "lowers" if lift < 0 else "does not move"
    sure = ""
    if row.get("ci_lo") is not None:
        sure = " (the interval excludes zero)" if row["ci_lo"] > 0 or row["ci_hi"] < 0 else " (the interval includes zero)"
    return f"{row['canonical_id']} {way} the score by {abs(lift):.3f} where {row['predicate_name']} is {row['predicate_value']}{sure}."


def caveats(rows: list[dict], least: int = 30) -> list[str]:
    out = []
    small = sum(1 for r in rows if min(r.get("n_target") or 0, r.get("n_base") or 0) < least)
    if small:
        out.append(f"{small} of {len(rows)} rows rest on fewer than {least} scores.")
    if any(r.get("did") is None for r in rows):
        out.append("Some predicates have no reference value, so no difference in differences.")
    return out


def render(rows: list[dict], fmt: str = "markdown"):
    if fmt == "both":
        return {"markdown": render(rows, "markdown"), "html": render(rows, "html")}
    columns = [c for c in COLUMNS if rows and c in rows[0]]
    cells = [[number(r[c]) for c in columns] for r in rows]
    if fmt == "markdown":
        head = [f"| {' | '.join(columns)} |", f"|{'|'.join('---' for _ in columns)}|"] if rows else ["No rows."]
        return "\n".join([*head, *(f"| {' | '.join(c)} |" for c in cells), "", *(f"- {interpret(r)}" for r in rows), *(f"- Caveat: {c}" for c in caveats(rows))])
    if fmt == "text":
        return "\n".join([*(interpret(r) for r in rows), *caveats(rows)])
    if fmt == "html":
        body = "".join("<tr>" + "".join(f"<td>{escape.escape(x)}</td>" for x in c) + "</tr>" for c in cells)
        return f"<!doctype html><table><tr>{''.join(f'<th>{c}</th>' for c in columns)}</tr>{body}</table>"
    raise ValueError(f"unknown format {fmt!r}")
