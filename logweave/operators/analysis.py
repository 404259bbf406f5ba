"""Symbolic execution of a parser: every way in which a token can get its value, with its conditions.

Nothing is evaluated. All paths are followed; a branch is left out only where its conditions contradict
each other for certain. Each plugin reads and writes lineages, and branches are merged behind each block.
"""

from __future__ import annotations

import re
from dataclasses import replace
from itertools import product

from logweave.functions import grok
from logweave.functions.transforms import FACILITIES, SEVERITIES
from logweave.operators import registry as R
from logweave.operators.facts import compatible
from logweave.operators.model import Anchor, Hint, IoAnchor, Lineage, Source, Taint, unique
from logweave.operators.state import Branch, Shared, State, Tags, merge
from logweave.plans.syntax import REFERENCE, For, If, Io, Pairs, Plugin, Program, Unknown, field_name, parse

EVENT_TIME = "event.idm.read_only_udm.metadata.event_timestamp"
_BACK_REFERENCE = re.compile(r"\\[0-9k]")
_ENUM = re.compile(r"[A-Z][A-Z0-9_]*\Z")
_PLAIN = re.compile(r"[A-Za-z0-9_.:@-]+\Z")
_SECRET = re.compile(r"pass|token|secret|key|credential|auth", re.I)
_IO_KEYS = frozenset("path topics topic bootstrap_servers hosts index port host codec type group_id queue exchange bucket region url table id tags".split())


def strings(value) -> list[str]:
    if value is None or isinstance(value, bool):
        return []
    if isinstance(value, Pairs):
        return [k for k, _ in value]
    return [str(x) for x in value if not isinstance(x, (list, bool))] if isinstance(value, list) else [str(value)]


class Analyzer:
    def __init__(self, code: str, dialect: str = "secops", patterns: dict[str, str] | None = None, signatures: dict[str, R.Signature] | None = None, canonical_order: bool | None = None, max_bytes: int = R.MAX_PARSER_BYTES) -> None:
        if not isinstance(code, str):
            raise TypeError("the parser source must be a string")
        if dialect not in R.DIALECTS:
            raise ValueError(f"dialect must be one of {R.DIALECTS}, got {dialect!r}")
        if len(code.encode("utf-8", "surrogatepass")) > max_bytes:
            raise ValueError(f"the parser source is larger than {max_bytes} bytes")
        self.dialect, self.signatures = dialect, signatures or {}
        self.canonical = canonical_order if canonical_order is not None else dialect == "logstash"
        self.library = grok.LIBRARY | (patterns or {})
        self.program: Program = parse(code)
        self.shared = Shared()
        self.state = State(self.shared)
        self.state.set("message", [Lineage("exact", (Source("raw_message", "message"),), "message", value_type="string")])
        self.done = False

    # Diagnostics

    def warn(self, code: str, location: str, text: str, token: str | None = None, strict: bool = True) -> None:
        self.shared.diagnostics.add(code, "warning", f"{location}: {text}", location, token, strict)

    def taint(self, code: str, location: str, text: str, token: str | None = None) -> Taint:
        self.shared.diagnostics.add(code, "taint", f"{location}: {text}", location, token)
        return Taint(code, text, location, token)

    def unsupported(self, code: str, location: str, text: str) -> None:
        self.shared.diagnostics.add(code, "unsupported", f"{location}: {text}", location)

    def run(self) -> State:
        if not self.done:
            self.done = True
            for d in self.program.diagnostics:
                self.warn("parse_recovery", f"line {d.line}", f"parse recovery at column {d.column}: {d.message}")
            self.statements(self.program.statements, self.state, (), 0)
        return self.state

    # Statements

    def statements(self, body: list, state: State, conditions: tuple[str, ...], depth: int) -> None:
        if depth > R.MAX_NESTING:
            self.warn("analysis_nesting_depth", "parser", f"nesting is deeper than {R.MAX_NESTING}; inner statements are not analyzed")
            return
        for s in body:
            if state.dropped:
                return
            active = unique(conditions + state.path_conditions)
            if isinstance(s, If):
                self.conditional(s, state, active, depth)
            elif isinstance(s, For):
                self.loop(s, state, active, depth)
            elif isinstance(s, Io):
                self.io(s.kind, s.body, state, active)
            elif isinstance(s, Unknown):
                self.unsupported("parse_recovery", f"line {s.line}", f"unparsed statement: {s.text[:80]}")
            else:
                self.plugin(s, state, active, depth)

    def io(self, kind: str, body: list, state: State, conditions: tuple[str, ...]) -> None:
        """Input and output blocks are not run; each plugin in them is an anchor."""
        for s in body:
            if isinstance(s, If):
                prior: tuple[str, ...] = ()
                for arm in s.arms:
                    self.io(kind, arm.body, state, unique(conditions + prior + (arm.condition,)))
                    prior += (f"NOT({arm.condition})",)
                self.io(kind, s.otherwise or [], state, unique(conditions + prior))
            elif isinstance(s, For):
                self.io(kind, s.body, state, unique((*conditions, f"for {s.header}")))
            elif isinstance(s, Plugin):
                shown = tuple((k, str(v)[: R.MAX_IO_VALUE]) for k, v in s.config if k in _IO_KEYS and not _SECRET.search(k.replace("id", "")) and not isinstance(v, (list, bool)))
                state.io_anchors.append(IoAnchor(kind, s.name, conditions, (f"line {s.line}: {kind} {s.name}",), shown))

    def conditional(self, s: If, state: State, conditions: tuple[str, ...], depth: int) -> None:
        location = f"line {s.line}: if"
        if len(s.arms) - 1 > R.MAX_ELIF_CHAIN:
            self.warn("long_elif_chain", f"line {s.line}", f"if/else-if chain has {len(s.arms) - 1} elif clauses (threshold {R.MAX_ELIF_CHAIN})")
        branches: list[Branch] = []
        negated: list[str] = []
        implied = tuple(c for cs in state.implicit.values() for c in cs)
        for arm in s.arms:
            prior = tuple(negated) if len(negated) <= R.MAX_PRIOR_NEGATIONS else (f"NOT(any of {len(negated)} prior if/else-if conditions matched)",)
            self.advise(arm.condition, f"line {arm.line}: if", state)
            negated.append(f"NOT({arm.condition})")
            verdict = self.tag_check(arm.condition, state)
            if verdict is False or not compatible((*conditions, *prior, arm.condition, *implied)):
                self.warn("unreachable_branch", f"line {arm.line}: if", f"condition {arm.condition!r} contradicts prior literal branch facts; branch skipped")
                self.taint("unreachable_branch", f"line {arm.line}: if", f"branch {arm.condition!r} is unreachable")
                continue
            branch = self.forked(state)
            own = unique(conditions + prior + (arm.condition,))
            self.statements(arm.body, branch, own, depth + 1)
            branches.append(Branch(branch, unique(prior + (arm.condition,))))
        rest = tuple(negated) if len(negated) <= R.MAX_PRIOR_NEGATIONS else (f"NOT(any of {len(negated)} prior if/else-if conditions matched)",)
        if compatible((*conditions, *rest, *implied)) and not any(self.tag_check(a.condition, state) is True for a in s.arms):
            branch = self.forked(state)
            if s.otherwise is not None:
                self.statements(s.otherwise, branch, unique(conditions + rest), depth + 1)
            branches.append(Branch(branch, rest, s.otherwise is None))
        elif s.otherwise is not None:
            self.warn("unreachable_branch", location, "the else branch contradicts prior literal branch facts; branch skipped")
        if branches:
            # A path's conditions include those that lead to the block.
            merge(state, [Branch(b.state, unique(conditions + b.conditions), b.idle, b.conditions) for b in branches], location)

    def forked(self, state: State) -> State:
        branch = state.fork()
        branch.path_conditions = ()
        return branch

    def advise(self, condition: str, location: str, state: State) -> None:
        if "%{" in condition or "=~" in condition and not re.fullmatch(r"\s*\[[^\]]+\](?:\[[^\]]+\])*\s*=~\s*/\^[\w@ :,;%&='\"<>!#~-]*\$/\s*", condition):
            self.warn("runtime_condition", location, f"condition {condition!r} contains runtime interpolation or dynamic regex; branch lineage is symbolic")
            self.taint("runtime_condition", location, "the condition depends on run-time values")
        for m in re.finditer(r"[\"'][^\"']*[\"']\s+in\s+\[([\w@.\]\[-]+)\]", condition):
            name = m[1].replace("][", ".")
            if name != "tags" and any(x.value_type == "string" for x in state.get(name)):
                self.warn("string_in_check", location, f"'in [{name}]' on a string tests for a substring, not for membership", name, False)
        for m in re.finditer(r"[=!]~\s*/((?:\\.|[^/\\])*)/", condition):
            if e := re.search(r"\\\\[dwsbDWSB]", m[1]):
                self.warn("regex_over_escape", location, f"regex literal {m[1]!r} contains {e[0]!r} which matches a literal backslash followed by {e[0][-1]!r}, not the metacharacter", strict=False)

    def tag_check(self, condition: str, state: State) -> bool | None:
        """Whether a test of one tag is decided; None if it is not, or if the condition is none."""
        m = re.fullmatch(r"(!?\s*\(?\s*)[\"']([^\"']+)[\"']\s+(not\s+)?in\s+\[tags\]\s*\)?", condition.strip())
        if not m:
            return None
        held = state.tags.holds(m[2])
        if held is False and state.tags == Tags() and not state.has("tags"):
            return None  # nothing is known about tags on this path
        if held is None:
            self.warn("conditional_tag_check", "tags", f"tag {m[2]!r} is possible but not definite", "tags", False)
            return None
        if state.has("tags") and any(x.status == "dynamic" for x in state.get("tags")):
            return None
        return held != (("!" in m[1]) != bool(m[3]))

    def loop(self, s: For, state: State, conditions: tuple[str, ...], depth: int) -> None:
        location = f"line {s.line}: for"
        if len(s.variables) > 2:
            self.warn("loop_variables", location, f"loop declares {len(s.variables)} variables; treating variables after the first as symbolic loop items")
        if s.iterable.startswith("[") and re.match(r"\[\s*([\"'\d]|\])", s.iterable):
            self.static_loop(s, state, conditions, depth, location)
            return
        source = field_name(s.iterable)
        rows = self.resolve(source, state, location)
        if "%{" in s.iterable:
            self.warn("dynamic_loop_iterable", location, f"loop iterable {s.iterable!r} is dynamic; loop items are symbolic")
            self.taint("dynamic_loop_iterable", location, "the loop's iterable is known at run time only")
        self.shared.loops += len(rows)
        if self.shared.loops > R.MAX_LOOP_FANOUT:
            self.warn("loop_fanout", location, f"loops have more than {R.MAX_LOOP_FANOUT} iterable alternatives; summarized as dynamic")
            rows = (Lineage("dynamic", (Source("dynamic_reference", source),), source, taints=(self.taint("loop_fanout", location, "loop alternatives are summarized"),)),)
        branches = []
        entering = (f"for {s.header}",)
        for row in rows:
            branch = self.forked(state)
            self.bind(s, source, row, branch, location)
            self.statements(s.body, branch, unique(conditions + entering), depth + 1)
            self.unbind(s, branch)
            branches.append(Branch(branch, unique(conditions + entering)))
        branches.append(Branch(self.forked(state), unique((*conditions, f"NOT(for {s.header})")), True))
        merge(state, branches, location)

    def bind(self, s: For, source: str, row: Lineage, branch: State, location: str) -> None:
        path = self.path_of(row, source)

        def put(name: str, kind: str, suffix: str) -> None:
            status = "derived" if row.status in ("exact", "exact_capture", "constant") else "dynamic" if row.status == "unresolved" else row.status
            branch.set(name, [replace(row, status=status, sources=(Source(kind, source, path + suffix),), expression=name, value_type="unknown").at(location)])

        names = s.variables
        if s.is_map:
            put(names[0], "map_key", ".*")
            if len(names) > 1:
                put(names[1], "map_value", ".*")
        elif len(names) > 1:
            put(names[0], "loop_index", "[*]")
            for n in names[1:]:
                put(n, "loop_item", "[*]")
        else:
            put(names[0], "loop_item", "[*]")

    @staticmethod
    def path_of(row: Lineage, token: str) -> str:
        return next((s.path for s in row.sources if s.path), None) or token

    def unbind(self, s: For, branch: State) -> None:
        """The variables and what lies below them end with the loop."""
        for name in s.variables:
            for t in [name, *branch.under(name)]:
                branch.own.pop(t, None)

    def static_loop(self, s: For, state: State, conditions: tuple[str, ...], depth: int, location: str) -> None:
        items = re.findall(r"\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'|([^\s,\[\]]+)", s.iterable)
        values = [a or b or c for a, b, c in items]
        if len(values) * max(1, len(s.body)) > R.MAX_STATIC_LOOP:
            self.warn("static_loop_fanout", location, f"loop over {len(values)} literals is summarized after limit {R.MAX_STATIC_LOOP}")
            self.taint("static_loop_fanout", location, "a literal loop is summarized")
            values = values[:1]
        saved = {n: {t: dict(state.get(t)) for t in [n, *state.under(n)]} for n in s.variables}
        for k, v in enumerate(values):
            constant = lambda text: Lineage("constant", (Source("constant", expression=text),), text, parser_locations=(location,), value_type="string")
            names = s.variables
            if len(names) > 1:
                state.set(names[0], [constant(str(k))])
            state.set(names[-1] if len(names) > 1 else names[0], [constant(v)])
            self.statements(s.body, state, conditions, depth + 1)
        for n, old in saved.items():
            for t in [n, *state.under(n)]:
                state.own[t] = old.get(t, {})

    # Reading

    def resolve(self, token: str, state: State, location: str) -> tuple[Lineage, ...]:
        """The rows of a token: what was written, else what an extractor may give, else an unresolved row."""
        rows = self.find(token, state)
        if rows:
            return rows
        taint = self.taint("unresolved_token", location, f"token {token!r} was not resolved", token)
        return (Lineage("unresolved", (Source("unknown", token),), token, parser_locations=(location,), taints=(taint,)),)

    def find(self, token: str, state: State) -> tuple[Lineage, ...]:
        return tuple(state.get(token)) or self.infer(token, state)

    def infer(self, token: str, state: State) -> tuple[Lineage, ...]:
        found: list[Lineage] = []
        at = token.rfind(".")
        while at > 0 and not found:  # a member of a loop item, of a map or of a JSON field
            parent, rest = token[:at], token[at + 1 :]
            for row in state.get(parent):
                kinds = {s.kind for s in row.sources}
                if kinds & {"loop_item", "map_value", "json_path"} and row.status != "removed":
                    sources = tuple(replace(s, path=f"{s.path or s.source_token}.{rest}") for s in row.sources)
                    found.append(replace(row, sources=sources, expression=token))
            at = token.rfind(".", 0, at)
        if len(found) > R.MAX_MEMBER_ALTERNATIVES:
            self.warn("member_inference_fanout", "member", f"{token!r} has {len(found)} inferred alternatives; summarized after limit {R.MAX_MEMBER_ALTERNATIVES}", token)
            taint = self.taint("member_inference_fanout", "member", f"{token!r} has too many inferred alternatives", token)
            return (Lineage("dynamic", found[0].sources, token, taints=(taint,)),)
        if found:
            return tuple(found)
        untargeted = 0
        for h in state.hints:
            name, target = token, h.detail("target")
            if target:
                if h.kind == "kv":
                    if token != target:
                        continue
                elif token.startswith(target + "."):
                    name = token[len(target) + 1 :]
                elif h.detail("split") and (m := re.fullmatch(re.escape(target) + r"_(\d+)", token)):
                    name = f"[{int(m[1]) - 1}]"
                else:
                    continue
            if h.kind == "csv":
                if m := re.fullmatch(r"column(\d+)", name):
                    found.append(self.from_hint(h, token, Source("csv_column", h.source_token, column=int(m[1]))))
                continue
            if not _PLAIN.match(name.replace("[", "").replace("]", "")) or name.startswith(("event.", "@")) or name == "event" or name in ("true", "false", "null", "tags"):
                continue
            if h.kind == "json":
                untargeted += not target
                if untargeted > R.MAX_HINTS:
                    taint = self.taint("extractor_hint_fanout", "json", f"{token!r} can come from more than {R.MAX_HINTS} json extractors", token)
                    return (Lineage("dynamic", (Source("json_path", h.source_token, name),), token, taints=(taint,)),)
                found.append(self.from_hint(h, token, Source("json_path", h.source_token, name)))
            elif h.kind == "kv":
                leaf = name.rsplit(".", 1)[-1]
                if h.detail("include") and leaf not in h.detail("include") or leaf in (h.detail("exclude") or ()):
                    continue
                found.append(self.from_hint(h, token, Source("kv_key", h.source_token, name)))
        return tuple(dict.fromkeys(found))

    def from_hint(self, h: Hint, token: str, source: Source) -> Lineage:
        status = "exact" if h.source_resolved else "dynamic"
        return Lineage(status, (source,), token, parser_locations=h.parser_locations).under(h.conditions)

    def expression(self, text, state: State, conditions: tuple[str, ...], location: str, bare_token: bool = False) -> tuple[Lineage, ...]:
        """The rows of a configuration value: a constant, one reference, or a template over several."""
        if isinstance(text, bool):
            text = "true" if text else "false"
        text = str(text)
        references = REFERENCE.findall(text)
        if "%{" in text and re.search(r"%\{[^}]*%\{", text):
            taint = self.taint("nested_interpolation", location, f"nested interpolation {text!r} is dynamic")
            return (Lineage("dynamic", (Source("dynamic_reference", expression=text),), text, parser_locations=(location,), taints=(taint,)).under(conditions),)
        if not references:
            token = field_name(text)
            if bare_token and _PLAIN.match(token) and not (_ENUM.match(token) and not state.has(token)):
                rows = self.find(token, state)
                if rows or text.startswith("["):
                    rows = rows or self.resolve(token, state, location)
                    return tuple(r.at(location).under(conditions) for r in rows)
                if not state.under(token):
                    self.warn("unresolved_bare_token", location, f"bare token {token!r} was not resolved; treating it as unresolved instead of a literal constant", token)
                    taint = self.taint("unresolved_bare_token", location, f"bare token {token!r} was not resolved", token)
                    return (Lineage("unresolved", (Source("unknown", token),), token, conditions=conditions, parser_locations=(location,), taints=(taint,)),)
                return ()
            return (Lineage("constant", (Source("constant", expression=text),), text, parser_locations=(location,), value_type="string").under(conditions),)
        options = [self.resolve(field_name(r), state, location) for r in references]
        if len(references) == 1 and text == "%{" + references[0] + "}":
            return tuple(r.at(location).under(conditions) for r in options[0])
        total = 1
        for o in options:
            total *= len(o)
        if total > R.MAX_TEMPLATE_COMBINATIONS:
            self.warn("template_fanout", location, f"template interpolation has {total} possible combinations; summarized as dynamic after limit {R.MAX_TEMPLATE_COMBINATIONS}")
            taint = self.taint("template_fanout", location, "template combinations are summarized")
            return (Lineage("dynamic", unique(s for o in options for r in o[:8] for s in r.sources), text, ("template_interpolation",), conditions, (location,), taints=(taint,)),)
        out = []
        for combo in product(*options):
            held = unique(c for r in combo for c in r.conditions)
            if not compatible(unique(conditions + held)):
                continue
            if all(r.status == "constant" or r.status == "conditional" and r.sources and all(s.kind == "constant" for s in r.sources) for r in combo):
                values = iter([r.expression for r in combo])
                made = REFERENCE.sub(lambda m, v=values: next(v), text)
                row = Lineage("constant", (Source("constant", expression=made),), made, value_type="string")
            else:
                status = "unresolved" if any(r.status in ("unresolved", "removed") for r in combo) else "dynamic" if any(r.status == "dynamic" for r in combo) else "derived"
                row = Lineage(status, unique(s for r in combo for s in r.sources), text, value_type="string")
            row = replace(row, transformations=unique(t for r in combo for t in (*r.transformations, "template_interpolation"))[: 128], parser_locations=unique((*(p for r in combo for p in r.parser_locations), location)), notes=unique(n for r in combo for n in r.notes), taints=tuple(dict.fromkeys(t for r in combo for t in r.taints)))
            out.append(row.under(unique(held + conditions)))
        if not out:  # no combination of the references can happen on this path
            taint = self.taint("unresolved_expression", location, f"expression {text!r} could not be resolved")
            out.append(Lineage("unresolved", (Source("unknown", expression=text),), text, conditions=conditions, parser_locations=(location,), taints=(taint,)))
        return tuple(dict.fromkeys(out))

    def value(self, value, state: State, conditions: tuple[str, ...], location: str, bare_token: bool = False) -> tuple[Lineage, ...]:
        if isinstance(value, Pairs):
            return (Lineage("constant", (Source("object_literal", expression="object"),), "object", parser_locations=(location,), value_type="object").under(conditions),)
        if isinstance(value, list):
            if not value:
                return (Lineage("constant", (Source("constant", expression="[]"),), "[]", parser_locations=(location,), value_type="array").under(conditions),)
            if len(value) > R.MAX_LITERAL_COLLECTION:
                self.warn("literal_collection_fanout", location, f"collection has {len(value)} values; summarized after limit {R.MAX_LITERAL_COLLECTION}")
                taint = self.taint("literal_collection_fanout", location, "a literal collection is summarized")
                return (Lineage("dynamic", (Source("constant", expression=f"{len(value)} values"),), f"{len(value)} values", parser_locations=(location,), taints=(taint,), value_type="array").under(conditions),)
            return tuple(replace(r, value_type="array") for v in value for r in self.value(v, state, conditions, location, bare_token))
        return self.expression(value, state, conditions, location, bare_token)

    # Writing

    def store(self, dest: str, rows, state: State, location: str, append: bool = False) -> None:
        """Assign rows to a destination, whose name may itself contain references."""
        dest = field_name(str(dest)) if not REFERENCE.search(str(dest)) else str(dest)
        rows = tuple(rows)
        if not dest.strip():
            self.warn("empty_destination", location, "empty destination field name ignored")
            self.taint("empty_destination", location, "empty destination")
            return
        references = REFERENCE.findall(dest)
        if not references:
            self.assign(dest, rows, state, append)
            return
        options = [state.get(field_name(r)) for r in references]
        fixed = [[r for r in o if r.sources and all(s.kind == "constant" for s in r.sources) and r.status in ("constant", "conditional")] for o in options]
        total = 1
        for f in fixed:
            total *= len(f)
        if total > R.MAX_TEMPLATE_COMBINATIONS:
            self.warn("static_destination_total_fanout", location, f"destination {dest!r} has {total} names; kept as dynamic")
            total = 0
        if total:
            for combo in product(*fixed):
                values = iter([r.expression for r in combo])
                name = REFERENCE.sub(lambda m, v=values: next(v), dest)
                held = unique(c for r in combo for c in r.conditions)
                self.assign(name, [r.under(held) for r in rows], state, append or total > 1)
        if not total or any(len(f) < len(o) or not o for f, o in zip(fixed, options, strict=True)):
            self.warn("dynamic_destination", location, f"dynamic destination field name {dest!r} cannot be resolved to concrete UDM paths without a raw event", dest)
            taint = self.taint("dynamic_destination", location, f"destination {dest!r} is known at run time only", dest)
            self.assign(dest, [replace(r, status="dynamic").tainted(taint) for r in rows], state, True)

    def assign(self, dest: str, rows, state: State, append: bool) -> None:
        old = state.get(dest)
        if append and old and not all(r.status == "removed" for r in old):
            state.append(dest, rows)
            return
        if not append:
            for t in state.under(dest):
                state.forget(t)
        state.set(dest, rows)

    def written(self, dest: str, state: State) -> None:
        state.unbind(field_name(dest))
        self.shared.mutated.add(dest)

    # Plugins

    def plugin(self, p: Plugin, state: State, conditions: tuple[str, ...], depth: int) -> None:
        location = f"line {p.line}: {p.name}"
        if p.name == "drop":
            if str(p.config.first("percentage", "100")).strip() not in ("", "100"):
                self.warn("drop_probabilistic", location, "drop has a percentage; events may pass")
                return
            self.warn("drop", location, "parser may drop events on this path", strict=False)
            state.dropped = True
            return
        if p.name == "statedump":
            self.warn("statedump", location, "statedump is a debugging aid", strict=False)
            return
        if p.name not in R.CLASS_OF:
            self.unknown(p, state, conditions, location)
            return
        if not R.allowed(p.name, self.dialect):
            self.warn("plugin_dialect_disabled", location, f"plugin {p.name} is not available in dialect {self.dialect}")
            return
        if p.diagnostics:
            d = p.diagnostics[0]
            self.warn("malformed_config", f"line {p.line}", f"{p.name} config parse failure at line {d.line}, column {d.column}: {d.message}")
            self.taint("malformed_config", location, "the configuration could not be parsed")
            return
        if p.name != "mutate":
            if isinstance(p.config.first("on_error"), Pairs):
                self.warn("non_canonical_on_error_placement", location, "on_error appears as a config-map key; nested configs are not interpreted as fallback bodies")
            for key in {k for k, _ in p.config}:
                values = p.config.all(key)
                if len(values) > 1 and key not in ("match", "mapping", *R.DECORATORS):
                    self.warn("duplicate_config_key", location, f"duplicate singleton config key {key!r} appears {len(values)} times; using the first value")
        for _, v in p.config:
            if isinstance(v, list) and len(v) > R.MAX_ARRAY_LITERAL:
                self.warn("large_array_literal", f"line {p.line}", f"array literal has {len(v)} elements (threshold {R.MAX_ARRAY_LITERAL}); large literals slow lineage analysis")
        wrong, odd = R.problems(p.name, p.config)
        for text in wrong:
            self.warn("config_validation", f"line {p.line}", f"{p.name} config validation failure: {text}")
            self.taint("invalid_config", location, text)
        for key in odd:
            self.warn("unknown_config_key", location, f"unknown config key {key!r} ignored by static analyzer", strict=False)
        if p.name == "on_error":
            self.on_error_block(p, state, conditions, depth, location)
            return
        handler = getattr(self, f"do_{p.name}", None)
        if handler is not None:
            handler(p, state, conditions, location)
        elif p.name in R.GENERIC_TRANSFORMS:
            self.generic(p, state, conditions, location)
        elif p.name in R.EXTERNAL:
            self.external(p, state, conditions, location)
        if p.name not in ("mutate", "clone", "cidr"):
            self.decorate(p, state, conditions, location)
        self.failure(p, state, conditions, location)

    def decorate(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        for op in R.DECORATORS:
            for v in p.config.all(op):
                getattr(self, f"mutate_{op}")(v, state, conditions, f"{location}.{op}")

    def failure(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        """Tags that a failure may leave, and the on_error flag."""
        tags = [t for k in ("tag_on_failure", "tag_on_timeout") for v in p.config.all(k) for t in strings(v)]
        if self.dialect == "logstash" and p.config.first("tag_on_failure") is None and p.name in R.FAILURE_TAGS:
            tags += [R.FAILURE_TAGS[p.name], *([R.TIMEOUT_TAGS[p.name]] if p.name in R.TIMEOUT_TAGS else [])]
        if tags:
            state.tags = state.tags.maybe(tags)
            for t in tags:
                state.routes.append((p.name, t, unique((*conditions, f"{p.name} failure")), (location,)))
        flag = p.config.first("on_error")
        if isinstance(flag, str) and p.name != "mutate":
            self.flag(flag, state, conditions, location)

    def flag(self, name: str, state: State, conditions: tuple[str, ...], location: str) -> None:
        row = Lineage("derived", (Source("error_flag", name, expression=location),), name, parser_locations=(location,), value_type="string").under(conditions)
        self.store(name, [row], state, location, True)
        self.shared.mutated.add(field_name(name))

    def on_error_block(self, p: Plugin, state: State, conditions: tuple[str, ...], depth: int, location: str) -> None:
        for s in p.fallback or []:
            if isinstance(s, Unknown):
                self.warn("on_error_parse", location, f"could not parse fallback body at line {s.line}: {s.text[:80]}")
        branch = self.forked(state)
        self.statements(p.fallback or [], branch, unique((*conditions, "on_error")), depth + 1)
        merge(state, [Branch(branch, unique((*conditions, "on_error"))), Branch(self.forked(state), unique((*conditions, "NOT(on_error)")), True)], location)

    def unknown(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        sig = self.signatures.get(p.name)
        if sig is None:
            self.unsupported("unsupported_plugin", location, f"unsupported plugin {p.name}")
            taint = self.taint("unsupported_plugin", location, f"plugin {p.name} is not known")
            for key in R.DEST_KEYS:
                for dest in strings(p.config.first(key)):
                    self.store(dest, [Lineage("unresolved", (Source("unsupported_plugin", expression=p.name),), dest, conditions=conditions, parser_locations=(location,), taints=(taint,))], state, location, True)
            return
        sources = [s for k in sig.source_keys for v in p.config.all(k) for t in strings(v) for r in self.find(field_name(t), state) for s in r.sources]
        taints = (self.taint(f"signature_dispatched_{sig.taint_hint}", location, f"plugin {p.name} is known by its signature only"),)
        for key in sig.dest_keys:
            for v in p.config.all(key):
                for dest in strings(v):
                    row = Lineage(sig.lineage_status, unique((Source("signature_dispatched", expression=p.name), *sources)), dest, (p.name,), (), (location,), taints=taints)
                    self.store(dest, [row.under(conditions)], state, location, True)
        self.decorate(p, state, conditions, location)

    def opaque(self, state: State, conditions: tuple[str, ...], location: str, write) -> None:
        """A plugin that may do its work or leave the event alone."""
        changed = self.forked(state)
        write(changed)
        merge(state, [Branch(changed, conditions), Branch(self.forked(state), conditions)], location)

    # Extractors

    def source_of(self, p: Plugin, state: State, location: str, key: str = "source") -> tuple[str, bool, tuple[Lineage, ...]]:
        raw = str(p.config.first(key, "message"))
        token = field_name(raw)
        if REFERENCE.search(token):
            self.warn("dynamic_extractor_source", location, f"source {raw!r} is known at run time only")
            self.taint("dynamic_extractor_source", location, "the extractor's source is dynamic")
        rows = self.find(token, state)
        if not rows:
            self.warn("unresolved_extractor_source", location, "source token was not resolved; fields from this extractor are not inferred as exact raw paths", token)
            self.taint("unresolved_extractor_source", location, f"source {token!r} was not resolved", token)
        return token, bool(rows), rows

    def extracted(self, dest: str, rows, state: State, location: str) -> None:
        """An extractor overwrites what extractors wrote, and adds to anything else."""
        kinds = {"grok_capture", "regex_capture", "dissect_field", "csv_column", "xml_xpath", "json_path", "kv_key"}
        old = state.get(field_name(dest))
        mixed = any(not r.sources or any(s.kind not in kinds for s in r.sources) for r in old if r.status != "removed")
        state.unbind(field_name(dest))
        self.store(dest, rows, state, location, mixed)

    def inherit(self, upstream: tuple[Lineage, ...], row: Lineage, conditions: tuple[str, ...]) -> tuple[Lineage, ...]:
        """The row once for each alternative of the source, with what happened to that before."""
        if not upstream:
            return (row.under(conditions),)
        out = []
        for u in upstream:
            status = row.status if u.status in ("exact", "exact_capture", "constant", "conditional", "derived", "repeated") else u.status
            made = replace(row, status=status, transformations=u.transformations + row.transformations, conditions=u.conditions, parser_locations=unique(u.parser_locations + row.parser_locations), notes=unique(u.notes + row.notes), taints=tuple(dict.fromkeys(u.taints + row.taints)))
            out.append(made.under(u.conditions).under(conditions))
        return tuple(dict.fromkeys(out))

    def do_grok(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        own = {}
        for name, body in p.config.first("pattern_definitions", Pairs()) if isinstance(p.config.first("pattern_definitions"), Pairs) else []:
            own[name] = str(body)
            if grok.expand(name, self.library | own) is None:
                self.warn("grok_pattern_definitions", location, f"pattern {name!r} cannot be expanded")
                self.taint("grok_pattern_definitions", location, f"pattern {name!r} cannot be expanded")
        library = self.library | own
        matches = [m for m in p.config.all("match")]
        pairs = [kv for m in matches for kv in (m if isinstance(m, Pairs) else zip(m[::2], m[1::2], strict=False) if isinstance(m, list) else [])]
        if not pairs:
            self.warn("missing_grok_match", location, "no match mappings discovered")
            return
        for source, patterns in pairs:
            token = field_name(str(source))
            upstream = self.find(token, state)
            if not upstream:
                self.warn("unresolved_extractor_source", location, "source token was not resolved; fields from this extractor are not inferred as exact raw paths", token)
                self.taint("unresolved_extractor_source", location, f"source {token!r} was not resolved", token)
            found: dict[str, list[Lineage]] = {}
            shapes: dict[str, list[str]] = {}
            for pattern in patterns if isinstance(patterns, list) else [patterns]:
                for c in grok.captures(str(pattern), library):
                    m = re.match(r"%\{(\w+)", c.pattern)
                    body = grok.expand(m[1], library) if m else None
                    details = (("resolved_pattern_body", body), ("resolved_pattern_name", m[1])) if body else ()
                    row = Lineage("exact_capture", (Source("grok_capture" if m else "regex_capture", token, capture_name=c.token, pattern=c.pattern, details=details),), c.token, parser_locations=(location,), value_type="string")
                    found.setdefault(c.token, []).extend(self.inherit(upstream, row, conditions))
                    if body and m[1] not in ("DATA", "GREEDYDATA", "NOTSPACE", "SPACE") and len(body) <= 512:
                        shapes.setdefault(c.token, []).append(f"[{field_name(c.token)}] =~ /^(?:{body})$/")
                    else:
                        shapes.setdefault(c.token, []).append("")
            for dest, rows in found.items():
                fresh = not state.has(field_name(dest))
                self.extracted(dest, rows, state, location)
                if fresh and len(shapes[dest]) == 1 and shapes[dest][0]:
                    state.implicit[field_name(dest)] = (shapes[dest][0],)

    def hint(self, kind: str, p: Plugin, state: State, conditions: tuple[str, ...], location: str, **details) -> None:
        token, resolved, _ = self.source_of(p, state, location)
        h = Hint(kind, token, tuple((k, v) for k, v in details.items() if v), conditions, (location,), resolved)
        if h not in state.hints:
            state.hints.append(h)

    def do_json(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        target = p.config.first("target")
        if target is not None and not isinstance(target, str):
            self.warn("json_target", location, f"json target must be a scalar token name; ignoring unsupported target={target!r}")
            target = None
        function = p.config.first("array_function")
        if function is not None and function != "split_columns":
            self.warn("json_array_function", location, f"array_function {function!r} is not modeled")
            self.taint("json_array_function", location, f"array_function {function!r} is not modeled")
        self.hint("json", p, state, conditions, location, target=field_name(target) if target else None, split=function == "split_columns")

    def do_kv(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        target = p.config.first("target")
        self.hint("kv", p, state, conditions, location, target=field_name(target) if isinstance(target, str) else None, include=tuple(strings(p.config.first("include_keys"))), exclude=tuple(strings(p.config.first("exclude_keys"))), prefix=p.config.first("prefix"))

    def do_csv(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        token, _, upstream = self.source_of(p, state, location)
        for k, name in enumerate(strings(p.config.first("columns")), 1):
            row = Lineage("exact", (Source("csv_column", token, column=k),), name, parser_locations=(location,), value_type="string")
            self.extracted(name, self.inherit(upstream, row, conditions), state, location)
        self.hint("csv", p, state, conditions, location)

    def do_xml(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        token, _, upstream = self.source_of(p, state, location)
        taints: tuple[Taint, ...] = ()
        if p.config.first("namespaces"):
            self.warn("xml_namespaces", location, "xml namespaces is not fully modeled statically; lineage is symbolic")
            taints = (self.taint("xml_namespaces", location, "namespaces are not modeled"),)
        paths = p.config.first("xpath")
        if not paths:
            self.warn("missing_xpath_mappings", location, "no xpath mappings discovered")
            return
        for path, dest in paths if isinstance(paths, Pairs) else zip(paths[::2], paths[1::2], strict=False):
            shown, own = REFERENCE.sub("*", str(path)), taints
            if "(" in shown:
                self.warn("complex_xpath", location, f"xpath {path!r} is not fully modeled statically; lineage is symbolic")
                own += (self.taint("complex_xpath", location, f"xpath {path!r} is complex"),)
            row = Lineage("exact", (Source("xml_xpath", token, shown),), str(dest), parser_locations=(location,), taints=own, value_type="string")
            for d in strings(dest):
                self.extracted(d, self.inherit(upstream, row, conditions), state, location)

    def do_dissect(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        mapping = p.config.first("mapping", p.config.first("match"))
        pairs = list(mapping) if isinstance(mapping, Pairs) else list(zip(mapping[::2], mapping[1::2], strict=False)) if isinstance(mapping, list) else []
        if not pairs:
            self.warn("missing_dissect_mapping", location, "no mapping/match pairs discovered")
            return
        for source, text in pairs:
            token = field_name(str(source))
            upstream = self.find(token, state)
            groups: dict[str, list[tuple[str, bool]]] = {}
            for key in re.findall(r"%\{([^}]*)\}", str(text)):
                name = re.sub(r"(->)?(:\w+)?$", "", key)
                if not name or name.startswith("?"):
                    continue
                if name.startswith("&"):
                    self.warn("dissect_indirect", location, f"dissect indirect field &{{{name[1:]}}} is runtime-named; no literal token was created")
                    self.taint("dissect_indirect", location, f"field {name!r} is named at run time")
                    continue
                groups.setdefault(re.sub(r"/\d+$", "", name.lstrip("+")), []).append((key, name.startswith("+")))
            for name, keys in groups.items():
                row = Lineage("exact", tuple(Source("dissect_field", token, capture_name=name, pattern="%{" + k + "}") for k, _ in keys), name, parser_locations=(location,), value_type="string")
                if any(appended for _, appended in keys):
                    row = row.transformed("dissect_append")
                self.extracted(name, self.inherit(upstream, row, conditions), state, location)

    # Mutate

    def do_mutate(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        config = list(p.config)
        rank = {op: k for k, op in enumerate(R.CANONICAL_ORDER)}
        ordered = sorted(config, key=lambda kv: rank.get(kv[0], len(rank)))
        if [k for k, _ in ordered] != [k for k, _ in config] and not self.canonical:
            self.warn("mutate_ordering_drift", location, "operations are not in the order in which Logstash runs them", strict=False)
        for op, value in ordered if self.canonical else config:
            if op in ("replace", "update", "add_field", "copy", "rename", "convert", "merge") and isinstance(value, Pairs):
                keys = [k for k, _ in value]
                for k in dict.fromkeys(keys):
                    if keys.count(k) > 1 if len(keys) < 200 else False:
                        self.warn("duplicate_mutate_map_key", f"line {p.line}: mutate.{op}", f"duplicate map key {k!r} appears {keys.count(k)} times; keeping the last value (replace/update/add_field/copy/rename/convert) or appending all values (merge)", strict=False)
            if op == "on_error":
                if isinstance(value, str):
                    self.flag(value, state, conditions, location)
            elif op in R.MUTATE_OPS:
                getattr(self, f"mutate_{op}")(value, state, conditions, f"line {p.line}: mutate.{op}")
            elif op not in ("id", "enable_metric", "periodic_flush", "tag_on_failure"):
                self.unsupported("unsupported_mutate_operation", f"line {p.line}: mutate", f"unsupported mutate operation {op}")
                self.taint("unsupported_mutate_operation", f"line {p.line}: mutate", f"operation {op} is not known")

    def pairs(self, value) -> list[tuple]:
        if isinstance(value, Pairs):
            return list(value)
        return list(zip(value[::2], value[1::2], strict=False)) if isinstance(value, list) else []

    def mutate_replace(self, value, state: State, conditions: tuple[str, ...], location: str, append: bool = False) -> None:
        for dest, text in self.pairs(value):
            rows = self.value(text, state, conditions, location)
            self.written(dest, state)
            self.store(dest, rows, state, location, append)
            if isinstance(text, Pairs):
                self.object_fields(dest, text, state, conditions, location)

    def object_fields(self, dest: str, value: Pairs, state: State, conditions: tuple[str, ...], location: str) -> None:
        for k, v in value:
            name = f"{dest}.{field_name(k)}"
            self.store(name, self.value(v, state, conditions, location), state, location)
            if isinstance(v, Pairs):
                self.object_fields(name, v, state, conditions, location)

    def mutate_update(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        there = Pairs([(d, t) for d, t in self.pairs(value) if state.has(field_name(str(d))) or state.under(field_name(str(d)))])
        self.mutate_replace(there, state, conditions, location)

    def mutate_add_field(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.mutate_replace(value, state, conditions, location, True)

    def mutate_rename(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        for source, dest in self.pairs(value):
            self.move(field_name(str(source)), str(dest), state, conditions, location, "rename")

    def mutate_copy(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        for source, dest in self.pairs(value):
            self.move(field_name(str(source)), str(dest), state, conditions, location, "copy")

    def move(self, source: str, dest: str, state: State, conditions: tuple[str, ...], location: str, op: str) -> None:
        below = [(t, state.get(t)) for t in state.under(source)]
        rows = self.find(source, state)
        if not rows and not below:
            rows = self.resolve(source, state, location)
        facts = state.implicit.get(source, ())
        if op == "rename":
            for t in [source, *(t for t, _ in below)]:
                state.forget(t)
            state.unbind(source)
        self.written(dest, state)
        if not rows:  # an object that is known by its members only
            rows = (Lineage("derived", unique(s for _, old in below for r in old for s in r.sources), source, value_type="object"),)
        self.store(dest, [r.transformed(op).at(location).under(conditions) for r in rows], state, location)
        if op == "rename" and facts:
            state.implicit[field_name(dest)] = tuple(f.replace(f"[{source}]", f"[{field_name(dest)}]", 1) for f in facts)
        for t, old in below:
            self.store(dest + t[len(source) :], [r.transformed(op).at(location).under(conditions) for r in old], state, location)

    def mutate_merge(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        for dest, sources in self.pairs(value):
            if dest == "@output":
                for s in [sources] if not isinstance(sources, list) else sources:
                    self.anchor(str(s), state, conditions, location)
                continue
            name, there = field_name(str(dest)), False
            items = sources if isinstance(sources, list) and not isinstance(sources, Pairs) else [sources]
            for item in items:
                there = state.has(name)
                token = field_name(str(item)) if isinstance(item, str) else ""
                if token == name:
                    self.warn("self_referential_merge", location, f"merge of {name!r} into itself")
                    self.taint("self_referential_merge", location, f"{name!r} is merged into itself", name)
                below = [(t, state.get(t)) for t in state.under(token)] if token else []
                rows = self.value(item, state, conditions, location, True)
                made = []
                for r in rows:
                    r = replace(r.transformed("merge"), value_type="array")
                    if there and r.status not in ("conditional", "unresolved", "dynamic", "removed"):
                        r = replace(r, status="repeated")
                    made.append(r)
                self.written(str(dest), state)
                if made:
                    self.store(str(dest), made, state, location, True)
                for t, old in below:
                    self.store(f"{dest}{t[len(token) :]}", [r.transformed(f"merge_object({token})").at(location).under(conditions) for r in old], state, location, True)

    def anchor(self, name: str, state: State, conditions: tuple[str, ...], location: str) -> None:
        if "%{" in name and not (m := re.fullmatch(r"%\{([^{}]+)\}", name)):
            self.warn("dynamic_output_anchor", location, f"dynamic @output anchor {name!r} cannot be resolved to concrete output events without a raw event")
            self.taint("dynamic_output_anchor", location, f"anchor {name!r} is dynamic")
        state.anchors.append(Anchor(field_name(name), conditions, (location,)))

    def change(self, tokens: list[str], label: str, state: State, conditions: tuple[str, ...], location: str, value_type: str | None = None) -> None:
        for t in map(field_name, tokens):
            rows = [r.transformed(label, value_type).at(location).under(conditions) for r in self.resolve(t, state, location)]
            self.written(t, state)
            state.set(t, rows)

    def mutate_convert(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        for token, kind in self.pairs(value):
            self.change([str(token)], f"convert({kind})", state, conditions, location, "string")

    def mutate_lowercase(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.change(strings(value), "lowercase", state, conditions, location)

    def mutate_uppercase(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.change(strings(value), "uppercase", state, conditions, location)

    def mutate_strip(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.change(strings(value), "strip", state, conditions, location)

    def mutate_gsub(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        items = list(value) if isinstance(value, list) else []
        if len(items) % 3:
            self.warn("malformed_gsub", location, f"malformed gsub array has {len(items)} element(s); expected triples")
            self.taint("malformed_gsub", location, "the gsub array is malformed")
        for k in range(0, len(items) - 2, 3):
            token, pattern, new = map(str, items[k : k + 3])
            if k // 3 * max(1, len(state.get(field_name(token)))) > R.MAX_GSUB_PRODUCTS:
                self.warn("gsub_transform_fanout", location, f"gsub has more than {R.MAX_GSUB_PRODUCTS} products; the rest is summarized")
                break
            if _BACK_REFERENCE.search(new):
                self.warn("gsub_backreference", location, f"gsub replacement {new!r} has a back-reference", strict=False)
                taint = self.taint("gsub_backreference", location, f"replacement {new!r} has a back-reference")
                state.set(field_name(token), [r.tainted(taint) for r in self.resolve(field_name(token), state, location)])
            self.change([token], f"gsub(pattern={pattern!r}, replacement={new!r})", state, conditions, location)

    def mutate_split(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        for token, sep in self.pairs(value):
            self.change([str(token)], f"split(separator={str(sep)!r})", state, conditions, location, "array")

    def mutate_join(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        for token, sep in self.pairs(value):
            self.change([str(token)], f"join(separator={str(sep)!r})", state, conditions, location, "string")

    def mutate_remove_field(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        for token in strings(value):
            if REFERENCE.search(token):
                self.warn("dynamic_field_removal", location, "dynamic field removal not resolved statically")
                self.taint("dynamic_field_removal", location, f"removal of {token!r} is dynamic")
                continue
            name = field_name(token)
            gone = [t for t in [name, *state.under(name)] if state.has(t)]
            if not gone:
                self.warn("noop_remove_field", location, f"remove_field target {name!r} was never written; nothing to remove", name, False)
            for t in gone:
                held = dict.fromkeys(unique(r.conditions + conditions) for r in state.get(t))
                state.set(t, [Lineage("removed", (), t, ("remove_field",), c, (location,)) for c in held])
            state.unbind(name)

    def mutate_add_tag(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.tagged("add_tag", strings(value), state, conditions, location)

    def mutate_remove_tag(self, value, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.tagged("remove_tag", strings(value), state, conditions, location)

    def tagged(self, op: str, tags: list[str], state: State, conditions: tuple[str, ...], location: str) -> None:
        fixed = [t for t in tags if "%{" not in t]
        state.tags = state.tags.add(fixed) if op == "add_tag" else state.tags.remove(fixed)
        if len(fixed) < len(tags):
            state.tags = replace(state.tags, dynamic=True)
        rows = [Lineage("derived", (Source("constant", expression=t),), t, (op,), (), (location,), value_type="array").under(conditions) for t in tags]
        state.append("tags", rows)

    # Transforms

    def do_date(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        match = strings(p.config.first("match"))
        if not match:
            self.warn("missing_match_array", location, "no match array discovered")
            return
        target, zone, locale = p.config.first("target", EVENT_TIME), p.config.first("timezone"), p.config.first("locale")
        label = f"date({', '.join(match[1:])})" + (f" timezone({zone})" if zone else "") + (f" locale({locale})" if locale else "")
        taints = []
        if "%{" in str(target):
            self.warn("dynamic_date_target", location, f"date target {target!r} is dynamic")
            taints.append(self.taint("dynamic_date_target", location, "the target is dynamic"))
        if zone and "%{" in str(zone):
            self.warn("dynamic_date_timezone", location, f"date timezone {zone!r} is dynamic")
            taints.append(self.taint("dynamic_date_timezone", location, "the time zone is dynamic"))
        rows = [r.transformed(label).at(location).under(conditions) for r in self.resolve(field_name(match[0]), state, location)]
        self.written(str(target), state)
        self.store(str(target), [replace(r, taints=(*r.taints, *taints)) for r in rows], state, location)

    def sources(self, p: Plugin, keys=R.SOURCE_KEYS) -> list[str]:
        return [t for k in keys for v in p.config.all(k) for t in strings(v)]

    def moved(self, p: Plugin, label: str, state: State, conditions: tuple[str, ...], location: str) -> None:
        names = self.sources(p)
        target = next((str(p.config.first(k)) for k in R.DEST_KEYS if isinstance(p.config.first(k), str)), None)
        if not names:
            self.warn("missing_source_field", location, "no source/field discovered")
        for n in names:
            rows = [r.transformed(label).at(location).under(conditions) for r in self.resolve(field_name(n), state, location)]
            self.written(target or n, state)
            self.store(target or n, rows, state, location, bool(target) and len(names) > 1)

    def do_base64(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        if p.config.first("field") is not None and p.config.first("fields") is not None:
            self.warn("base64_conflicting_fields", location, "both field and fields are given")
        coded = next((v for x in p.config.all("fields") if isinstance(x, Pairs) for _, v in x), p.config.first("encoding", "Standard"))
        self.moved(p, f"base64_decode(encoding={coded})", state, conditions, location)

    def do_url_decode(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.moved(p, "url_decode", state, conditions, location)

    def do_syslog_pri(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        source = field_name(str(p.config.first("source", p.config.first("syslog_pri_field_name", "syslog_pri"))))
        rows = self.resolve(source, state, location)
        for kind, default, size in (("severity", SEVERITIES, 8), ("facility", FACILITIES, 24)):
            labels = strings(p.config.first(f"{kind}_labels")) or default
            if len(labels) != size:
                self.warn("syslog_pri_label_count_mismatch", location, f"{kind}_labels has {len(labels)} labels; expected {size}")
                labels = default
            made = []
            for r in rows:
                if r.expression.isdigit() and int(r.expression) < 192 and all(s.kind == "constant" for s in r.sources) and len(rows) <= R.MAX_SYSLOG_LITERALS:
                    n = int(r.expression)
                    text = labels[n & 7 if kind == "severity" else n >> 3]
                    made.append(replace(r, sources=(Source("constant", expression=text),), expression=text))
                else:
                    made.append(replace(r, sources=(Source("syslog_pri", source, kind), *r.sources)).transformed(f"syslog_pri({kind})", "string"))
            self.store(f"{source}_{kind}", [m.at(location).under(conditions) for m in made], state, location)

    def generic(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        names = self.sources(p)
        dests = [d for k in R.DEST_KEYS for d in strings(p.config.first(k))]
        calc = p.config.first("calculate")
        if calc is not None:
            rows = calc if calc and isinstance(calc[0], list) else [calc]
            names += [str(r[1]) for r in rows if len(r) > 2]
            dests += [str(r[-1]) for r in rows if len(r) > 2]
        for value in p.config.all("coalesce") if p.name == "alter" else []:
            items = strings(value)
            rows = [r for x in items[1:] for r in self.expression(x, state, conditions, location) if r.status != "unresolved"]
            self.store(items[0], [r.transformed("alter") for r in rows], state, location, True)
            names += items[:1]
        if not names:
            self.warn("missing_source_field", location, "no source/field discovered")
            return

        def write(branch: State) -> None:
            for k, n in enumerate(names):
                dest = dests[k] if k < len(dests) else dests[0] if dests else n
                found = self.resolve(field_name(n), state, location)
                rows = [replace(r, sources=(Source(p.name, n), *r.sources)).transformed(p.name).at(location).under(conditions) for r in found]
                self.written(dest, branch)
                self.store(dest, rows, branch, location)

        self.opaque(state, conditions, location, write)

    def do_translate(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        source = str(p.config.first("field", p.config.first("source", "")))
        dest = str(p.config.first("destination", source))
        table, fallback = p.config.first("dictionary"), p.config.first("fallback")
        dynamic = p.config.first("dictionary_path") is not None or p.config.first("regex") in (True, "true")
        taints: tuple[Taint, ...] = ()
        if dynamic:
            self.warn("dynamic_translate_dictionary", location, "translate dictionary is not fully modeled statically; lineage is symbolic", strict=False)
            taints = (self.taint("dynamic_translate_dictionary", location, "the dictionary is dynamic"),)
        rows = []
        for r in self.resolve(field_name(source), state, location):
            made = replace(r, sources=(Source("translate", field_name(source)), *r.sources), taints=(*r.taints, *taints)).transformed("translate")
            rows.append(replace(made, status="dynamic" if dynamic else "derived" if made.status != "unresolved" else made.status).at(location).under(conditions))
        if fallback is not None:
            rows += [r.transformed("translate_fallback") for r in self.expression(fallback, state, conditions, location)]
        self.store(dest, rows, state, location, True)
        for _, v in table if isinstance(table, Pairs) else []:
            if isinstance(v, Pairs):
                for k, inner in v:
                    self.store(f"{dest}.{k}", [r.transformed("translate") for r in self.value(inner, state, conditions, location)], state, location, True)

    def script(self, kind: str, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        """Code is searched for reads and writes of the event."""
        code = " ".join(str(v) for k in ("code", "init", "map_action", "timeout_code") for v in p.config.all(k))
        name = field_name
        reads = [name(m) for m in re.findall(r"event\.get\(\s*[\"']([^\"']+)[\"']\s*\)", code)]
        sources = [Source(f"{kind}_get", t) for t in reads] + [s for t in reads for r in self.find(t, state) for s in r.sources]
        if "event.to_hash" in code:
            sources.append(Source(f"{kind}_event_hash"))
        sources = sources or [Source(f"{kind}_block", expression=code[:80])]
        for dest in re.findall(r"event\.set\(\s*[\"']([^\"']+)[\"']", code) + re.findall(r"event\[[\"']([^\"']+)[\"']\]\s*=(?!=)", code):
            row = Lineage("dynamic", unique(sources), dest, (f"{kind}_set",), (), (location,))
            self.store(name(dest), [row.under(conditions)], state, location, True)
        for dest in re.findall(r"event\.remove\(\s*[\"']([^\"']+)[\"']", code):
            self.mutate_remove_field([name(dest)], state, conditions, location)
        if "event.cancel" in code:
            self.warn(f"{kind}_event_cancel", location, f"{kind} block may cancel the event")
            self.taint(f"{kind}_event_cancel", location, "the event may be cancelled")
        if re.search(r"\byield\b|event\.clone|new_event_block", code):
            self.warn(f"{kind}_event_split", location, f"{kind} block contains yield or event.clone, splitting one input event into multiple output events")
        if m := re.search(r"@@\w+|(?<![\w\"'])\$[a-z]\w*", code):
            self.warn("ruby_concurrency_risk", location, f"ruby block uses global/class variable {m[0]!r}; this poses a concurrency risk in multi-worker environments")
            self.taint("ruby_concurrency_risk", location, f"variable {m[0]!r} is shared between workers")
        if kind == "aggregate":
            for key in dict.fromkeys(re.findall(r"map\[[\"':]?(\w+)[\"']?\]\s*(?:[|&+-]{0,2}=)(?!=)", code)):
                self.store(f"@metadata.aggregate.{key}", [Lineage("dynamic", unique([Source("aggregate_map", path=key), *sources]), key, ("aggregate_map",), (), (location,)).under(conditions)], state, location, True)

    def do_ruby(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.script("ruby", p, state, conditions, location)

    def do_aggregate(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.warn("aggregate_state", location, "aggregate keeps state between events; lineage is symbolic")
        self.taint("aggregate_state", location, "the state spans events")
        self.script("aggregate", p, state, conditions, location)
        state.tags = state.tags.maybe(strings(p.config.first("timeout_tags")))

    def do_clone(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        types = strings(p.config.first("clones"))
        if len(types) > R.MAX_CLONES:
            self.warn("clone_fanout", location, f"clone has {len(types)} types; summarized after limit {R.MAX_CLONES}")
            self.taint("clone_fanout", location, "clone types are summarized")
            types = types[: R.MAX_CLONES]
        branches = [Branch(self.forked(state), conditions)]
        for t in types:
            branch = self.forked(state)
            self.store("type", [Lineage("constant", (Source("constant", expression=t),), t, ("clone",), (), (location,), value_type="string").under(conditions)], branch, location)
            self.decorate(p, branch, conditions, location)
            branches.append(Branch(branch, conditions))
        merge(state, branches, location)

    def do_split(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        source = str(p.config.first("field", "message"))
        dest = str(p.config.first("target", source))

        def write(branch: State) -> None:
            rows = [replace(r, status="dynamic", sources=(Source("split", field_name(source)), *r.sources)).transformed("split").at(location).under(conditions) for r in self.resolve(field_name(source), state, location)]
            self.store(dest, rows, branch, location)

        self.opaque(state, conditions, location, write)

    def do_prune(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.warn("dynamic_prune", location, "prune may remove any field")
        taint = self.taint("prune_risk", location, "prune may remove this field")
        self.opaque(state, conditions, location, lambda branch: [branch.set(t, [r.tainted(taint) for r in branch.get(t)]) for t in branch.tokens()])

    def enrich(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        source = field_name(str(p.config.first("source", "message")))
        target, prefix = p.config.first("target"), str(p.config.first("prefix", ""))
        base = str(target) if isinstance(target, str) else prefix or p.name
        sources = unique((Source(p.name, source), *(s for r in self.find(source, state) for s in r.sources)))

        def write(branch: State) -> None:
            for name in [base, *(f"{base}.{f}" if isinstance(target, str) or not prefix else prefix + f for f in strings(p.config.first("fields")))]:
                self.store(name, [Lineage("dynamic", sources, name, (p.name,), (), (location,)).under(conditions)], branch, location, True)

        self.opaque(state, conditions, location, write)

    do_geoip = do_useragent = enrich

    def do_cidr(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        self.opaque(state, conditions, location, lambda branch: self.decorate(p, branch, conditions, location))

    def do_dns(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        names = self.sources(p, ("resolve", "reverse"))

        def write(branch: State) -> None:
            for n in map(field_name, names):
                rows = [replace(r, status="dynamic", sources=(Source("dns", n), *r.sources)).transformed("dns").at(location).under(conditions) for r in self.resolve(n, state, location)]
                self.store(n, rows, branch, location, p.config.first("action") != "replace")

        self.opaque(state, conditions, location, write)

    def external(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        used = [field_name(r) for k in ("query", "statement", "url", "parameters", "key", "source") for v in p.config.all(k) for t in strings(v) for r in REFERENCE.findall(t)]
        sources = unique((Source(p.name, used[0] if used else None), *(s for t in used for r in self.find(t, state) for s in r.sources)))
        dests = [str(p.config.first("target", p.name))]
        for key in ("get", "fields"):
            v = p.config.first(key)
            dests += [str(d) for _, d in v] if isinstance(v, Pairs) else strings(v)
        self.opaque(state, conditions, location, lambda branch: [self.store(d, [Lineage("dynamic", sources, d, (p.name,), (), (location,)).under(conditions)], branch, location, True) for d in dests])

    def do_elapsed(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        row = Lineage("dynamic", (Source("elapsed", str(p.config.first("unique_id_field", "")) or None),), "elapsed.time", ("elapsed",), (), (location,)).under(conditions)
        self.opaque(state, conditions, location, lambda branch: self.store("elapsed.time", [row], branch, location))

    def do_uuid(self, p: Plugin, state: State, conditions: tuple[str, ...], location: str) -> None:
        target = str(p.config.first("target", "uuid"))
        self.opaque(state, conditions, location, lambda branch: self.store(target, [Lineage("dynamic", (Source("uuid"),), target, (), (), (location,)).under(conditions)], branch, location))

