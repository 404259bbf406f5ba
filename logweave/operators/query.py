"""Questions about one analyzed parser."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import asdict, replace

from logweave.operators.analysis import Analyzer
from logweave.operators.model import STATUSES, Anchor, Diagnostic, Lineage, QueryResult, sampled, unique
from logweave.operators.registry import CLASS_OF

UDM = "idm.read_only_udm."
UDM_TOKEN = re.compile(r"(?:event\d*\.)?idm\.read_only_udm\.")
SAMPLE = 50
MAX_ANCHORED = 50_000


def candidates(field: str, anchors: list[str]) -> list[str]:
    """The tokens that a field name may mean: itself, below ``event`` and below each output anchor."""
    out = [field]
    bare = re.sub(r"^event\.", "", field)
    for root in ["event", *anchors]:
        suffix = bare[len(root) + 1 :] if bare.startswith(root + ".") else bare
        out.append(f"{root}.{suffix}")
        if not suffix.startswith("idm."):
            out.append(f"{root}.{UDM}{suffix}")
    if not field.startswith("idm.") and not field.startswith("event."):
        out.append(UDM + field)
    return list(dict.fromkeys(out))


def prefixes(token: str) -> list[str]:
    parts = token.split(".")
    return [".".join(parts[: k + 1]) for k in range(len(parts))]


def template_regex(token: str) -> str:
    """A destination with references as a pattern over concrete names."""
    parts = re.split(r"%\{[^}]*\}", token)
    return "^" + ".+".join(re.escape(p) for p in parts) + "$"


class ParserLineage:
    """The lineage of one parser source."""

    def __init__(self, code: str, **options) -> None:
        self.analyzer = Analyzer(code, **options)
        self.state = None

    def analyze(self):
        if self.state is None:
            self.state = self.analyzer.run()
        return self.state

    @property
    def diagnostics(self) -> list[Diagnostic]:
        self.analyze()
        return list(self.analyzer.shared.diagnostics.found)

    def anchors(self) -> list[Anchor]:
        held: dict[tuple, list[str]] = {}
        for a in self.analyze().anchors:
            held.setdefault((a.anchor, a.conditions), []).extend(a.parser_locations)
        return [Anchor(name, conditions, unique(places)) for (name, conditions), places in held.items()]

    def query(self, field: str, compact: bool = False, sample_limit: int = SAMPLE) -> QueryResult:
        """What populates a field. A compact result has at most sample_limit (0 to 50) of its rows in to_json, with totals
        beside them; its status and flags are those of all rows."""
        if not isinstance(field, str):
            raise TypeError("the field must be a string")
        state, field = self.analyze(), field.strip()
        anchors = self.anchors()
        names = candidates(field, list(dict.fromkeys(a.anchor for a in anchors)))
        named: dict[str, list[Anchor]] = {}
        for a in anchors:
            named.setdefault(a.anchor, []).append(a)
        reached = {p for n in names for p in prefixes(n)}
        rows: dict[Lineage, None] = {}
        diagnostics = list(self.diagnostics)
        templates = []
        for t in state.tokens():
            if "%{" in t:
                try:
                    templates.append((t, re.compile(template_regex(t))))
                except (re.error, OverflowError) as e:
                    diagnostics.append(Diagnostic("dynamic_template_regex", "warning", f"destination {t!r} cannot be matched: {e}", None, t))
        for name in names:
            found = list(state.get(name))
            for token, pattern in templates:
                if token != name and pattern.match(name):
                    note = f"matched dynamic destination {token}"
                    found += [replace(r, status="dynamic").noted(note) for r in state.get(token)]
            own = [a for p in prefixes(name) for a in named.get(p, ())]
            if len(own) * len(found) > MAX_ANCHORED:
                diagnostics.append(Diagnostic("anchor_conditioned_fanout", "warning", f"{name}: {len(own) * len(found)} anchored mappings; sampled", None, name))
                found, own = found[:SAMPLE], own[:SAMPLE]
            for r in found:
                for a in own or [None]:
                    rows[r.under(a.conditions) if a else r] = None
        for odd in {r.status for r in rows} - set(STATUSES):
            diagnostics.append(Diagnostic("invalid_lineage_status", "warning", f"unknown status {odd!r}", None, field))
        if not rows:
            diagnostics.append(Diagnostic("no_assignment", "warning", f"no assignment found for {field!r}", None, field))
        return QueryResult(
            field, names, list(rows), [a for a in anchors if a.anchor in reached],
            [d.message for d in diagnostics if d.kind == "unsupported"], [d.message for d in diagnostics if d.kind == "warning"], diagnostics, max(0, min(int(sample_limit), SAMPLE)) if compact else None,
        )

    def list_udm_fields(self) -> list[str]:
        state = self.analyze()
        roots = {a.anchor for a in state.anchors} - {"event"}
        found = set()
        for t in state.tokens():
            if UDM_TOKEN.match(t):
                found.add(t)
            root, _, rest = t.partition(".")
            if root in roots and rest.startswith(UDM):
                found |= {t, f"event.{rest}"}
        return sorted(found)

    def analysis_summary(self, compact: bool = False) -> dict:
        state = self.analyze()
        of = lambda kind: [d for d in self.diagnostics if d.kind == kind]
        full = {
            "udm_fields": self.list_udm_fields(), "token_count": len(state.tokens()), "output_anchors": [asdict(a) for a in self.anchors()],
            "extraction_hints": [{"kind": h.kind, "source_token": h.source_token, "conditions": list(h.conditions), "source_resolved": h.source_resolved} for h in state.hints],
            "failure_tag_routes": [dict(zip(("plugin", "tag", "conditions", "parser_locations"), r, strict=True)) for r in state.routes],
            "unsupported": [d.message for d in of("unsupported")], "warnings": [d.message for d in of("warning")], "structured_warnings": [asdict(d) for d in of("warning")],
            "warning_counts": dict(Counter(d.code for d in of("warning"))), "taints": [asdict(d) for d in of("taint")], "taint_counts": dict(Counter(d.code for d in of("taint"))),
            "diagnostics": [asdict(d) for d in self.diagnostics], "diagnostic_counts": dict(Counter(d.code for d in self.diagnostics)),
        }
        return sampled(full, SAMPLE) if compact else full

    def compat_report(self, compact: bool = False) -> dict:
        state = self.analyze()
        statuses = Counter(r.status for t in state.tokens() for r in state.get(t))
        tainted = Counter(t for t in state.tokens() if UDM_TOKEN.match(t) for r in state.get(t) if r.taints or r.status in ("dynamic", "unresolved"))
        named = lambda code: Counter(d.message.rsplit(" ", 1)[-1] for d in self.diagnostics if d.code == code and d.kind != "taint")
        out = {
            "dialect": self.analyzer.dialect, "unsupported_plugins": dict(named("unsupported_plugin")), "unsupported_mutate_operations": dict(named("unsupported_mutate_operation")),
            "dialect_disabled": sum(d.code == "plugin_dialect_disabled" for d in self.diagnostics), "dynamic_or_symbolic": statuses["dynamic"] + statuses["unresolved"],
            "affected_fields": [{"field": f, "count": n} for f, n in sorted(tainted.items(), key=lambda kv: (-kv[1], kv[0]))],
            "status_counts": dict(sorted(statuses.items())), "diagnostic_counts": dict(sorted(Counter(d.code for d in self.diagnostics).items())),
            "registry_classes": dict(sorted(Counter(CLASS_OF.values()).items())),
        }
        return sampled(out, SAMPLE) if compact else out


def is_strict_failure(diagnostics: list[Diagnostic], status: str | None = None) -> bool:
    """Whether strict mode fails: unsupported parts, warnings or taints that count, or a field that is not settled."""
    return any(d.strict for d in diagnostics) or status in ("unresolved", "partial", "dynamic")
