"""Query results and summaries as text or JSON."""

from __future__ import annotations

import json
import re

from logweave.operators.model import QueryResult

_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")
SAMPLE = 50
TAINT_ORDER = ("code", "parser_location", "source_token", "message")


def clean(text: object) -> str:
    """Without control characters, which a terminal would obey."""
    return _CONTROL.sub("�", str(text))


def render_text(result: QueryResult, verbose: bool = False, limit: int | None = None) -> str:
    out = [f"UDM field: {clean(result.udm_field)}", f"Status: {result.status}", ""]
    if result.output_anchors:
        out.append("Output anchors: " + ", ".join(clean(a) for a in dict.fromkeys(a.anchor for a in result.output_anchors)))
    out += ["Candidate parser fields checked:", *(f"  - {clean(c)}" for c in result.normalized_candidates), ""]
    shown = result.mappings if limit is None else result.mappings[:limit]
    if shown:
        out.append("Mappings:")
    for k, m in enumerate(shown, 1):
        out.append(f"  [{k}] status={m.status}")
        out.append(f"      expression: {clean(m.expression)}")
        if m.sources:
            out.append("      sources:")
        for s in m.sources:
            out.append(f"        - {clean(s.label())}")
            out += [f"          {name}: {clean(v)}" for name, v in (("source_token", s.source_token), ("capture_name", s.capture_name), ("pattern", s.pattern)) if v and s.kind != "constant"]
        for name, values in (("conditions", m.conditions), ("transformations", m.transformations), *((("parser_locations", m.parser_locations), ("notes", m.notes)) if verbose else ())):
            if values:
                out += [f"      {name}:", *(f"        - {clean(v)}" for v in values)]
        if verbose and m.taints:
            ordered = sorted(m.taints, key=lambda t: tuple(str(getattr(t, a) or "") for a in TAINT_ORDER))
            out += ["      taints:", *(f"        - {t.code}: {clean(t.message)}" for t in ordered[: limit or len(ordered)])]
    if len(shown) < len(result.mappings):
        out.append(f"  ... {len(result.mappings) - len(shown)} more")
    for name, values in (("Unsupported", result.unsupported), ("Warnings", result.warnings)):
        if values:
            out += ["", f"{name}:", *(f"  - {clean(v)}" for v in values[: limit or len(values)])]
    return "\n".join(out) + "\n"


def lifted(data: dict) -> dict:
    """A field without assignment carries a hint."""
    if not data["mappings"]:
        data["hint"] = {"code": "query_no_match", "message": f"no assignment found for {data['udm_field']!r}"}
    return data


def render_json(result: QueryResult, compact: bool = False, pattern_bodies: bool = False) -> str:
    data = lifted(result.to_json(SAMPLE if compact else None))
    if not pattern_bodies:
        for m in data["mappings"]:
            for s in m["sources"]:
                if s.get("details"):
                    held = {k: v for k, v in json.loads(s["details"]).items() if k != "resolved_pattern_body"}
                    s["details"] = json.dumps(held, sort_keys=True) if held else None
    return json.dumps(data, indent=None if compact else 2, sort_keys=False, default=str)


def audit_markdown(rows: list[dict]) -> str:
    """The totals of a corpus audit as a table."""
    out = ["| dialect | kind | code | parsers | n |", "|-|-|-|-|-|"]
    out += [f"| {r['dialect']} | {r['kind']} | {r['code']} | {r['parsers']} | {r['n']} |" for r in sorted(rows, key=lambda r: (r["dialect"], r["kind"], -r["n"], r["code"]))]
    return "\n".join(out) + "\n"
