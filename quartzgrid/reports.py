"""Results as JSON, Markdown and plain text. Each takes rows that are few: a report is read by a person."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from datetime import date
from typing import Any

from pyspark.sql import Row


def json_safe(value: Any) -> Any:
    """Numbers that JSON doesn't have become null, dates ISO text, rows objects."""
    if isinstance(value, Row):
        return {k: json_safe(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [json_safe(v) for v in value]
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, date):
        return value.isoformat()
    return value if value is None or isinstance(value, (str, bool, int)) else str(value)


def as_json(rows: Iterable[Row]) -> str:
    return json.dumps([json_safe(r) for r in rows], ensure_ascii=False, indent=2)


def as_markdown(rows: list[Row], title: str = "") -> str:
    lines = [f"## {title}", ""] if title else []
    if not rows:
        return "\n".join([*lines, "(nothing)"])
    names = rows[0].__fields__
    cell = lambda v: "" if json_safe(v) is None else str(json_safe(v)).replace("|", "\\|").replace("\n", " ")
    lines += ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows])


def changes(rows: list[Row], counts: list[Row]) -> str:
    """A comparison of two versions: numbers by sheet and kind, then the changes shown."""
    lines = [f"{r.sheet}: {r.n} {r.change}" for r in counts]
    for r in rows:
        lines.append(f"- {r.sheet}!{r.a1} {r.change}: {r.before if r.before is not None else '(nothing)'} → {r.after if r.after is not None else '(nothing)'}")
    return "\n".join(lines) if lines else "no changes"


def calculation(rows: list[Row]) -> str:
    """What-if results: value, where it came from, and what was saved where that differs."""
    lines = []
    for r in rows:
        shown = r.str if r.str is not None else "" if r.num is None else format(r.num, ".12g")
        saved = r.saved_str if r.saved_str is not None else "" if r.saved_num is None else format(r.saved_num, ".12g")
        lines.append(f"{r.sheet}!{r.a1} = {shown} ({r.status}" + (f"; saved {saved}" if saved and saved != shown else "") + (f"; {r.reason}" if r.reason else "") + ")")
    return "\n".join(lines) if lines else "nothing is affected"


def check(summary: list[Row], reasons: list[Row], different: list[Row]) -> str:
    """Recalculation against saved values, and why cells stayed unknown, most frequent first."""
    lines = [f"{r.workbook_id}: {r.n_formulas} formulas, {r.n_equal} equal, {r.n_different} different, {r.n_unknown} unknown" for r in summary]
    lines += [f"  {r.n} unknown: {r.reason}" for r in reasons]
    return "\n".join(lines + [f"  differs: {r.sheet}!{r.a1} {r.formula}" for r in different])
