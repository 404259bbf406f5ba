"""Values of the lineage analysis: sources, assignments, diagnostics, and results of queries."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, replace

STATUSES = ("exact", "exact_capture", "conditional", "derived", "constant", "repeated", "dynamic", "removed", "unresolved")
LIVE = frozenset(STATUSES) - {"removed", "unresolved"}
PROMOTED = frozenset({"exact", "exact_capture", "constant", "derived", "repeated"})
MAX_TRANSFORMATIONS = MAX_LOCATIONS = 128


def unique(items) -> tuple:
    """First occurrences in order; empty strings are left out."""
    return tuple(dict.fromkeys(x for x in items if x != ""))


@dataclass(frozen=True)
class Source:
    kind: str
    source_token: str | None = None
    path: str | None = None
    capture_name: str | None = None
    column: int | None = None
    pattern: str | None = None
    expression: str | None = None
    details: tuple = ()

    def label(self) -> str:
        parts = [self.kind, self.source_token, self.path or self.capture_name]
        if self.kind == "constant":
            return f"constant:{self.expression!r}"
        return ":".join(str(p) for p in [*parts, self.column] if p is not None)

    def row(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "details"} | {"details": json.dumps(dict(self.details), sort_keys=True, default=str) if self.details else None}


@dataclass(frozen=True)
class Taint:
    code: str
    message: str
    parser_location: str | None = None
    source_token: str | None = None


@dataclass(frozen=True)
class Lineage:
    """One way in which a token gets its value."""

    status: str
    sources: tuple[Source, ...] = ()
    expression: str = ""
    transformations: tuple[str, ...] = ()
    conditions: tuple[str, ...] = ()
    parser_locations: tuple[str, ...] = ()
    notes: tuple[str, ...] = ()
    taints: tuple[Taint, ...] = ()
    value_type: str = "unknown"

    def __hash__(self) -> int:
        """Computed once: rows are kept in sets of thousands."""
        held = self.__dict__.get("_hash")
        if held is None:
            held = hash((self.status, self.sources, self.expression, self.transformations, self.conditions, self.parser_locations, self.notes, self.value_type))
            object.__setattr__(self, "_hash", held)
        return held

    def under(self, conditions: tuple[str, ...]) -> Lineage:
        """The same assignment under more conditions, which makes a plain status conditional."""
        if not conditions:
            return self
        status = "conditional" if self.status in PROMOTED else self.status
        return replace(self, conditions=unique(self.conditions + conditions), status=status)

    def transformed(self, label: str, value_type: str | None = None) -> Lineage:
        status = "derived" if self.status in ("exact", "exact_capture", "constant") else self.status
        return replace(self, status=status, transformations=(self.transformations + (label,))[:MAX_TRANSFORMATIONS], value_type=value_type or self.value_type)

    def at(self, location: str) -> Lineage:
        return replace(self, parser_locations=unique(self.parser_locations + (location,))[:MAX_LOCATIONS])

    def noted(self, *notes: str) -> Lineage:
        return replace(self, notes=unique(self.notes + notes))

    def tainted(self, taint: Taint) -> Lineage:
        return replace(self, taints=tuple(dict.fromkeys((*self.taints, taint))))

    def row(self) -> dict:
        out = asdict(self)
        return out | {"sources": [s.row() for s in self.sources], "taints": [asdict(t) for t in self.taints]}


@dataclass(frozen=True)
class Anchor:
    anchor: str
    conditions: tuple[str, ...] = ()
    parser_locations: tuple[str, ...] = ()


@dataclass(frozen=True)
class IoAnchor:
    kind: str
    plugin: str
    conditions: tuple[str, ...]
    parser_locations: tuple[str, ...]
    config_summary: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Hint:
    kind: str
    source_token: str
    details: tuple
    conditions: tuple[str, ...]
    parser_locations: tuple[str, ...]
    source_resolved: bool
    sources: tuple[Lineage, ...] = ()

    def detail(self, key: str, default=None):
        return dict(self.details).get(key, default)


@dataclass(frozen=True)
class Diagnostic:
    code: str
    kind: str  # warning, unsupported, taint, parse
    message: str
    parser_location: str | None = None
    source_token: str | None = None
    strict: bool = True


@dataclass
class Diagnostics:
    """Append-only; equal ones are kept once."""

    found: dict[Diagnostic, None] = field(default_factory=dict)

    def add(self, code: str, kind: str, message: str, location: str | None = None, token: str | None = None, strict: bool = True) -> None:
        self.found.setdefault(Diagnostic(code, kind, message, location, token, strict))

    def of(self, kind: str) -> list[Diagnostic]:
        return [d for d in self.found if d.kind == kind]


_REPEATING = re.compile(r"\b(?:merge|add_tag|add_field)\b")


#: How the set of a field's row statuses becomes one: (test, status, result), the first that holds. "only" means no other
#: status, "has" any row, "mixed" a row beside other statuses.
PRECEDENCE = (
    ("only", "unresolved", "unresolved"), ("has", "unresolved", "partial"), ("mixed", "removed", "partial"), ("has", "dynamic", "dynamic"),
    ("has", "removed", "removed"), ("has", "conditional", "conditional"),
)


def collapse(mappings: list[Lineage]) -> str:
    """The status of a field with these mappings."""
    held = {m.status for m in mappings}
    if not held or not held <= set(STATUSES):
        return "partial" if held & LIVE else "unresolved"
    for test, status, result in PRECEDENCE:
        if status in held and (test == "has" or (test == "only") == (len(held) == 1)):
            return result
    if len(mappings) == 1:
        return mappings[0].status
    words = (w for m in mappings for w in (*m.transformations, *m.parser_locations))
    return "repeated" if "repeated" in held or any(map(_REPEATING.search, words)) else "derived"


def union_type(types) -> str:
    known = {t for t in types if t != "unknown"}
    return "unknown" if not known else known.pop() if len(known) == 1 else "mixed"


@dataclass
class QueryResult:
    udm_field: str
    normalized_candidates: list[str]
    mappings: list[Lineage]
    output_anchors: list[Anchor]
    unsupported: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    #: Of a compact result, the rows of a list that to_json gives.
    sample_limit: int | None = None

    @property
    def status(self) -> str:
        return collapse(self.mappings)

    @property
    def is_conditional(self) -> bool:
        return any(m.conditions for m in self.mappings)

    @property
    def has_dynamic(self) -> bool:
        return any(m.status == "dynamic" for m in self.mappings)

    @property
    def has_unresolved(self) -> bool:
        return any(m.status == "unresolved" for m in self.mappings) or not self.mappings

    @property
    def has_taints(self) -> bool:
        return any(m.taints for m in self.mappings)

    def to_json(self, sample_limit: int | None = None) -> dict:
        """A stable set of keys; with a limit, lists are sampled and totals are given."""
        sample_limit = self.sample_limit if sample_limit is None else sample_limit
        full = {
            "udm_field": self.udm_field, "status": self.status, "is_conditional": self.is_conditional, "has_dynamic": self.has_dynamic,
            "has_unresolved": self.has_unresolved, "has_taints": self.has_taints, "normalized_candidates": self.normalized_candidates,
            "mappings": [m.row() for m in self.mappings], "output_anchors": [asdict(a) for a in self.output_anchors], "unsupported": self.unsupported,
            "warnings": self.warnings, "structured_warnings": [asdict(d) for d in self.diagnostics if d.kind == "warning"], "diagnostics": [asdict(d) for d in self.diagnostics],
        }
        return full if sample_limit is None else sampled(full, sample_limit)


def sampled(full: dict, limit: int) -> dict:
    """Lists cut to the limit, with ``<key>_total`` and ``<key>_omitted`` where something was left out."""
    out: dict = {}
    for k, v in full.items():
        out[k] = v
        if isinstance(v, list) and len(v) > limit:
            out |= {k: v[:limit], f"{k}_total": len(v), f"{k}_omitted": len(v) - limit}
        elif isinstance(v, dict):
            out[k] = sampled(v, limit)
    return out
