"""A parser compiled to DataFrame operations: each statement becomes projections, filters, explodes or joins.

Fields are columns of the same (dotted) name. A statement inside a branch runs under a guard, a boolean
column that is computed once for each arm; what it assigns is CASE WHEN guard THEN new ELSE old. Nothing is
collected and nothing leaves the JVM, so a compiled parser runs unchanged on batch and streaming frames.
Schemaless extractors (json, kv) keep their source, and only fields that are read later are taken from it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweave.functions import grok, transforms
from logweave.operators.lookups import lookup_join, range_lookup
from logweave.plans.predicate import parse_condition, to_column
from logweave.plans.syntax import REFERENCE, For, If, Io, Pairs, Plugin, Regex, Unknown, field_name, parse

LOGSTASH_ONLY = frozenset("elasticsearch memcached jdbc_streaming http rest acme_threat_lookup".split())
EVENT_TIME = "event.idm.read_only_udm.metadata.event_timestamp"


class UnsupportedPlugin(ValueError):
    """A plugin that has no meaning at run time and no registered function."""


@dataclass
class Hint:
    """An extractor whose fields are taken when they are read."""

    kind: str
    column: str
    target: str = ""
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    #: Of a kv hint: what stands before and behind a key, what is trimmed from values, what wraps them, and the prefix of names.
    shape: tuple[str, ...] = ()
    #: Values of keys that are absent.
    defaults: tuple[tuple[str, str], ...] = ()


@dataclass
class Runtime:
    """What a parser needs besides its events."""

    dialect: str = "secops"
    patterns: dict[str, str] = field(default_factory=dict)
    #: Tables for translate (dictionary_path), geoip, useragent, dns and the external lookups, by plugin or path.
    lookups: dict[str, DataFrame] = field(default_factory=dict)
    #: Functions for plugins that users declare: (frame, configuration, guard) -> frame.
    plugins: dict[str, Callable[[DataFrame, Pairs, Column | None], DataFrame]] = field(default_factory=dict)
    #: Key of the cipher and anonymize plugins where the configuration names none; there is no default.
    key: str | None = None
    skip_unsupported: bool = False


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def strings(value) -> list[str]:
    """A configuration value as a list of strings."""
    if value is None or value is True:
        return []
    if isinstance(value, Pairs):
        return [x for k, v in value for x in (k, *strings(v))]
    return [str(x) for x in value] if isinstance(value, list) else [str(value)]


class Compiler:
    def __init__(self, df: DataFrame, runtime: Runtime) -> None:
        self._df, self.runtime = df, runtime
        #: Assigned columns that are not yet part of the frame: assignments that do not read each other become one projection.
        self.pending: dict[str, Column] = {}
        self.kinds: dict[str, str] = {n: "array" if t.startswith("array") else "map" if t.startswith("map") else t for n, t in df.dtypes}
        self.hints: list[Hint] = []
        self.hidden: list[str] = []
        self.guard: Column | None = None
        self.library = grok.LIBRARY | runtime.patterns
        self.aliases: dict[str, str] = {}
        #: on_error flags since the last on_error block, and inside a folded loop what its variables and fields are.
        self.flags: list[str] = []
        self.local: dict[str, tuple[Column, str]] | None = None

    # Reading and writing fields

    @property
    def df(self) -> DataFrame:
        if self.pending:
            self._df, self.pending = self._df.withColumns(self.pending), {}
        return self._df

    @df.setter
    def df(self, frame: DataFrame) -> None:
        self._df = frame

    def col(self, name: str) -> Column:
        """A column as it is now; what was assigned to it is put in place first."""
        if name in self.pending:
            self.df  # noqa: B018
        return q(name)

    def temp(self, stem: str, value: Column) -> str:
        name = f"__{stem}_{len(self.hidden)}"
        self.hidden.append(name)
        self.df = self.df.withColumn(name, value)
        return name

    def read(self, token: str) -> tuple[Column, str]:
        if self.local is not None and token in self.local:
            return self.local[token]
        token = self.aliases.get(token, token)
        if token in self.kinds:
            return self.col(token), self.kinds[token]
        head, _, rest = token.partition(".")
        if rest and head in self.aliases:
            return self.read(f"{self.aliases[head]}.{rest}")
        for parent in sorted((k for k in self.kinds if token.startswith(k + ".")), key=len, reverse=True):
            path = token[len(parent) + 1 :]
            if self.kinds[parent] == "map":
                return F.element_at(self.col(parent), F.lit(path)), "string"
            if self.kinds[parent] == "array" and path.isdigit():
                return F.get(self.col(parent), F.lit(int(path))), "string"
            if self.kinds[parent] == "string" and parent in self.aliases.values():
                return F.get_json_object(self.col(parent), json_path(path)), "string"
        found = [c for h in reversed(self.hints) if (c := self.inferred(h, token)) is not None]
        if not found:
            return F.lit(None).cast("string"), "string"
        return (F.coalesce(*found) if len(found) > 1 else found[0]), "string"

    def inferred(self, hint: Hint, token: str) -> Column | None:
        if hint.target:
            if not token.startswith(hint.target + "."):
                return None
            token = token[len(hint.target) + 1 :]
        if hint.kind == "json":
            return F.get_json_object(self.col(hint.column), json_path(token))
        leaf = token.rsplit(".", 1)[-1]
        if hint.include and leaf not in hint.include or leaf in hint.exclude:
            return None
        if hint.kind == "csv":
            m = re.fullmatch(r"column(\d+)", token)
            return F.get(self.col(hint.column), F.lit(int(m[1]) - 1)) if m else None
        before, behind, trim, wraps, prefix = hint.shape
        if not token.startswith(prefix):
            return None
        key = re.sub(r"([^\w ])", r"\\\1", token[len(prefix) :])
        value = F.regexp_extract(self.col(hint.column), f"{before}{key}{behind}", 1)
        value = F.regexp_replace(value, wraps, "$1$2$3$4$5")
        value = F.nullif(F.regexp_replace(value, trim, "") if trim else value, F.lit(""))
        default = dict(hint.defaults).get(token[len(prefix) :])
        return F.coalesce(value, F.when(self.col(hint.column).isNotNull(), F.lit(default))) if default is not None else value

    def text(self, token: str) -> Column:
        column, kind = self.read(token)
        return column if kind == "string" else F.array_join(column, ",") if kind == "array" else column.cast("string")

    def guarded(self, value: Column, old: Column | None) -> Column:
        if self.guard is None:
            return value
        return F.when(self.guard, value).otherwise(old) if old is not None else F.when(self.guard, value)

    def write(self, token: str, value: Column, kind: str = "string") -> None:
        """Assign, keeping the old value where the guard does not hold."""
        old = None
        if token in self.kinds:
            old = self.col(token)
            if self.kinds[token] != kind and self.guard is not None:
                if kind == "array":
                    old = F.when(old.isNotNull(), F.array(old.cast("string")))
                elif self.kinds[token] == "array":
                    value, kind = F.array(value.cast("string")), "array"
                else:
                    old, value, kind = old.cast("string"), value.cast("string"), "string"
        elif self.guard is not None and self.hints:
            inferred, _ = self.read(token)
            old = inferred if kind == "string" else None
        new = self.guarded(value, old)
        if token in self.pending:
            self.df  # noqa: B018
        self.pending[token] = new
        self.kinds[token] = kind

    def forget(self, token: str) -> None:
        """Remove a field and all below it."""
        for name in [k for k in self.kinds if k == token or k.startswith(token + ".")]:
            own = self.col(name)
            self.pending[name] = F.when(F.lit(False) if self.guard is None else ~self.guard, own)

    def template(self, text) -> tuple[Column, str]:
        """A string with %{references}. A reference that has no value stands for nothing, as an empty string;
        one that is the whole text passes its value, null included."""
        if isinstance(text, bool):
            return F.lit("true" if text else "false"), "string"
        text = str(text)
        if m := re.fullmatch(r"%\{([^{}]+)\}", text):
            return self.read(field_name(m[1]))
        parts, at = [], 0
        for m in REFERENCE.finditer(text):
            if m.start() > at:
                parts.append(F.lit(text[at : m.start()]))
            parts.append(F.coalesce(self.text(field_name(m[1])), F.lit("")))
            at = m.end()
        if not parts:
            return F.lit(text), "string"
        if at < len(text):
            parts.append(F.lit(text[at:]))
        return F.concat(*parts), "string"

    # Statements

    def run(self, statements: list) -> None:
        for s in statements:
            if isinstance(s, If):
                self.branch(s)
            elif isinstance(s, For):
                self.loop(s)
            elif isinstance(s, Plugin):
                self.plugin(s)
            elif isinstance(s, (Io, Unknown)):
                continue

    def branch(self, s: If) -> None:
        outer, prior = self.guard, None
        for arm in s.arms:
            cond = to_column(parse_condition(arm.condition), self.read)
            parts = [x for x in (outer, ~prior if prior is not None else None, cond) if x is not None]
            held = parts[0]
            for p in parts[1:]:
                held = held & p
            self.guard = self.col(self.temp("arm", held))
            prior = self.guard if prior is None else prior | self.guard
            self.run(arm.body)
        if s.otherwise is not None:
            rest = ~prior if outer is None else outer & ~prior
            self.guard = self.col(self.temp("arm", rest))
            self.run(s.otherwise)
        self.guard = outer

    def loop(self, s: For) -> None:
        """A loop over literals is unrolled. One over an array that merges is folded and keeps one row for each event;
        any other one gives a row for each element (or one row if there is none)."""
        if s.iterable.startswith("[") and re.match(r"\[\s*[\"'\d\]]", s.iterable):
            items = parse_condition(f"[x] in {s.iterable}").right.value
            for k, item in enumerate(items):
                names = s.variables if len(s.variables) == 1 else s.variables[1:]
                saved = {n: self.kinds.pop(n) for n in s.variables if n in self.kinds}
                if len(s.variables) == 2:
                    self.bind(s.variables[0], F.lit(str(k)))
                self.bind(names[0], F.lit(item))
                self.run(s.body)
                self.unbind(s.variables)
                self.kinds |= saved
            return
        source = field_name(s.iterable)
        column, kind = self.read(source)
        guard = self.guard if self.guard is not None else F.lit(True)
        if s.is_map:
            entries = column if kind == "map" else F.from_json(self.text(source), "map<string,string>")
            names = [f"__key_{len(self.hidden)}", f"__item_{len(self.hidden)}"]
            self.df = self.df.select("*", F.explode_outer(F.when(guard, entries)).alias(*names))
        else:
            array = column if kind == "array" else F.from_json(self.text(source), "array<string>")
            if foldable(s.body):
                self.fold(s, F.when(guard, array))
                return
            names = [f"__at_{len(self.hidden)}", f"__item_{len(self.hidden)}"]
            self.df = self.df.select("*", F.posexplode_outer(F.when(guard, array)).alias(*names))
        self.hidden += names
        wanted = s.variables if len(s.variables) == 2 else [None, s.variables[0]]
        for name, column_name in zip(wanted, names, strict=True):
            if name:
                self.kinds[column_name] = "string" if not column_name.startswith("__at") else "int"
                self.aliases[name] = column_name
        outer = self.guard
        there = self.col(names[1]).isNotNull()
        self.guard = there if outer is None else outer & there
        self.run(s.body)
        self.guard = outer
        for name in s.variables:
            if (held := self.aliases.pop(name, None)) is not None:
                self.kinds.pop(held, None)

    def fold(self, s: For, array: Column) -> None:
        """The body over all elements in one expression: what it merges is appended in order, and of what it replaces
        the last element's value stays. A name that an iteration reads has the value from before the loop or from
        the same iteration."""
        merged: list[str] = []
        replaced: list[str] = []

        def step(element: Column, at: Column) -> Column:
            index, value = s.variables if len(s.variables) == 2 else (None, s.variables[0])
            self.local = {value: (element, "string")} | ({index: (at.cast("string"), "string")} if index else {})
            values: list[Column] = []

            def go(body: list, held: Column | None) -> None:
                only = lambda c, old=None: c if held is None else F.when(held, c) if old is None else F.when(held, c).otherwise(old)
                for x in body:
                    if isinstance(x, If):
                        prior = None
                        for arm in x.arms:
                            cond = to_column(parse_condition(arm.condition), self.read)
                            now = cond if prior is None else cond & ~prior
                            go(arm.body, now if held is None else held & now)
                            prior = cond if prior is None else prior | cond
                        if x.otherwise is not None:
                            go(x.otherwise, ~prior if held is None else held & ~prior)
                        continue
                    for op, config in x.config:
                        for dest, text in self.pairs(config):
                            name = self.name(dest)
                            if op == "replace":
                                self.local[name] = (only(self.template(text)[0].cast("string"), self.text(name)), "string")
                                replaced.extend([name] if name not in replaced else [])
                                continue
                            for source in strings(text):
                                token = field_name(source)
                                below = [k for k in self.local if k.startswith(token + ".")]
                                if token in self.local or token in self.kinds or token in self.aliases or (self.hints and not below):
                                    found = [(name, self.text(token))]
                                else:
                                    found = [(name + k[len(token) :], self.local[k][0]) for k in below] or [(name, F.lit(source))]
                                for to, column in found:
                                    merged.append(to)
                                    values.append(only(column))

            go(s.body, None)
            finals = [self.local[n][0].alias(f"w{k}") for k, n in enumerate(replaced)]
            self.local = None
            return F.struct(*[v.alias(f"a{k}") for k, v in enumerate(values)], *finals)

        held = self.col(self.temp("fold", F.transform(array, step)))
        for name in dict.fromkeys(merged):
            every = F.flatten(F.transform(held, picked([f"a{k}" for k, n in enumerate(merged) if n == name])))
            self.append(name, F.filter(every, lambda v: v.isNotNull()), "array")
        for k, name in enumerate(replaced):
            last = F.when(F.size(held) > 0, F.element_at(held, -1)[f"w{k}"])
            self.write(name, F.when(F.size(held) > 0, last).otherwise(self.text(name)))

    def bind(self, name: str, value: Column) -> None:
        held = self.temp("var", value)
        self.kinds[held] = "string"
        self.aliases[name] = held

    def unbind(self, names: list[str]) -> None:
        for n in names:
            if (held := self.aliases.pop(n, None)) is not None:
                self.kinds.pop(held, None)

    def plugin(self, p: Plugin) -> None:
        name, config = p.name, p.config
        if name in LOGSTASH_ONLY and self.runtime.dialect != "logstash":
            return
        handler = getattr(self, f"do_{name}", None)
        failed = None
        if handler is not None:
            failed = handler(p)
        elif name in self.runtime.plugins:
            self.df = self.runtime.plugins[name](self.df, config, self.guard)
            self.kinds |= {n: "array" if t.startswith("array") else "string" if t == "string" else t for n, t in self.df.dtypes if n not in self.kinds and not n.startswith("__")}
        elif name in EXTERNAL:
            self.external(name, config)
        elif not self.runtime.skip_unsupported:
            raise UnsupportedPlugin(f"line {p.line}: no run-time meaning for plugin {name!r}")
        if name != "mutate":
            decorators = Pairs([(k, v) for k, v in config if k in ("add_tag", "remove_tag", "add_field", "remove_field")])
            if decorators:
                outer = self.guard
                if failed is not None:
                    ok = ~failed
                    self.guard = ok if outer is None else outer & ok
                self.mutate(decorators)
                self.guard = outer
        if failed is not None:
            self.on_failure(p, failed)

    def on_failure(self, p: Plugin, failed: Column) -> None:
        """A tag for each failure tag, and the on_error flag, a string of true or false."""
        default = f"_{p.name}parsefailure" if p.name != "dissect" else "_dissectfailure"
        tags = strings(p.config.first("tag_on_failure")) or ([default] if self.runtime.dialect == "logstash" else [])
        flag = p.config.first("on_error")
        if tags:
            self.tag(tags, failed)
        if isinstance(flag, str):
            self.write(flag, F.when(failed, "true").otherwise("false"))
            self.flags.append(flag)

    def tag(self, tags: list[str], when: Column | None = None) -> None:
        old = self.tags()
        new = F.array_union(old, F.array(*[self.template(t)[0] for t in tags]))
        self.write("tags", new if when is None else F.when(when, new).otherwise(old), "array")

    def tags(self) -> Column:
        return F.coalesce(self.col("tags"), F.array().cast("array<string>")) if "tags" in self.kinds else F.array().cast("array<string>")

    def fallback_source(self, config: Pairs) -> str:
        return field_name(str(config.first("source", "message")))

    # Extractors

    def do_grok(self, p: Plugin) -> Column | None:
        own = {k: v for k, v in p.config.first("pattern_definitions", Pairs()) if isinstance(v, str)}
        match = p.config.first("match")
        pairs = list(match) if isinstance(match, Pairs) else list(zip(match[::2], match[1::2], strict=False)) if isinstance(match, list) else []
        failed = None
        for source, patterns in pairs:
            text = self.text(field_name(source))
            options = []
            for x in strings(patterns):
                try:
                    options.append(grok.compile_pattern(x, self.library | own))
                except grok.UnknownPattern:  # such a pattern matches nothing, so the failure tags tell
                    options.append(("(?!)", []))
            hits = [self.col(self.temp("grok", F.coalesce(text.rlike(regex), F.lit(False)))) for regex, _ in options]
            values: dict[str, list] = {}
            for (regex, found), hit in zip(options, hits, strict=True):
                same: dict[str, list] = {}
                for c in found:
                    same.setdefault(field_name(c.token), []).append(c)
                for token, group in same.items():
                    kind = {"int": "bigint", "float": "double"}.get(group[0].kind, "string")
                    value = [F.regexp_extract(text, regex, c.group) for c in group]
                    if kind != "string":
                        value = F.coalesce(*[v.try_cast(kind) for v in value])
                    else:  # of a name's groups, such as those of alternatives, the first that took something
                        value = value[0] if len(value) == 1 else F.coalesce(*[F.nullif(v, F.lit("")) for v in value], F.lit(""))
                    values.setdefault(token, []).append((hit, value, kind))
            taken = None
            exclusive = []
            for hit in hits:  # the first pattern that matches is the one that counts
                exclusive.append(hit if taken is None else hit & ~taken)
                taken = hit if taken is None else taken | hit
            position = {id(h): e for h, e in zip(hits, exclusive, strict=True)}
            for token, found in values.items():
                kind = found[0][2]
                old = self.col(token) if token in self.kinds and self.kinds[token] == kind else F.lit(None).cast(kind)
                for hit, value, _ in reversed(found):
                    old = F.when(position[id(hit)], value).otherwise(old)
                self.write(token, old, kind)
            if taken is not None:
                failed = ~taken if failed is None else failed & ~taken
        return failed

    def do_json(self, p: Plugin) -> Column:
        text = self.text(self.fallback_source(p.config))
        valid = F.try_parse_json(text).isNotNull()
        held = self.temp("json", F.when(valid, self.guarded(text, None)))
        target = p.config.first("target")
        self.hints.append(Hint("json", held, field_name(target) if isinstance(target, str) else ""))
        return ~F.coalesce(valid, F.lit(False))

    def do_kv(self, p: Plugin) -> Column:
        """Nothing is split: each field that is read later is one regex over the source, which finds its last
        pair. Empty values count as absent."""
        c = p.config
        one_of = lambda key, default: re.sub(r"([\[\]\\^&-])", r"\\\1", str(c.first(key, default)))
        own_split = c.first("field_split_pattern")
        chars = one_of("field_split", " ")
        fields, body = (f"(?:{own_split})", f"(?:(?!{own_split}).)*+") if own_split is not None else (f"[{chars}]", f"[^{chars}]*")
        marks = ['"([^"]*)"', "'([^']*)'"] + ([r"\(([^)]*)\)", r"\[([^\]]*)\]", "<([^>]*)>"] if c.first("include_brackets") not in (False, "false") else [])
        wrapped, ends = "|".join(m.replace("(", "", 1).replace(")", "", 1) if m[0] != "\\" else m.replace("([", "[").replace("*)", "*") for m in marks), f"(?={fields}|$)" if own_split is None else ""
        values = f"(?:{c.first('value_split_pattern')})" if c.first("value_split_pattern") is not None else f"[{one_of('value_split', '=')}]"
        around = f"[{one_of('trim_key', '')}]*" if isinstance(c.first("trim_key"), str) else ""
        trim = f"^[{one_of('trim_value', '')}]+|[{one_of('trim_value', '')}]+$" if isinstance(c.first("trim_value"), str) else ""
        text = self.text(self.fallback_source(c))
        held = self.temp("kv", self.guarded(F.trim(text), None))
        target = c.first("target")
        shape = (f"(?s)^(?:.*{fields})?{around}", f"{around}{values}((?:{wrapped}){ends}|{body})", trim, "(?s)^(?:" + "|".join(marks) + ")$", str(c.first("prefix", "")))
        given = c.first("default_keys")
        defaults = tuple(zip(given[::2], given[1::2], strict=False)) if isinstance(given, list) and not isinstance(given, Pairs) else tuple(given or ())
        self.hints.append(Hint("kv", held, field_name(target) if isinstance(target, str) else "", tuple(strings(c.first("include_keys"))), tuple(strings(c.first("exclude_keys"))), shape, tuple((str(k), str(v)) for k, v in defaults)))
        return ~F.coalesce(F.rlike(text, F.lit(values)), F.lit(False))

    def do_csv(self, p: Plugin) -> Column:
        """A row of any width: every field is a match behind a separator. Empty fields are null, quoted empty ones empty."""
        c = p.config
        text, sep = self.text(self.fallback_source(c)), str(c.first("separator", ","))
        mark = re.escape(str(c.first("quote_char", '"')))
        names = [field_name(x) for x in strings(c.first("columns"))]
        plain = f"[^{re.escape(sep)}]*" if len(sep) == 1 else f"(?:(?!{re.escape(sep)}).)*+"
        pattern = f"(?s){re.escape(sep)}({mark}(?:[^{mark}]++|{mark}{mark})*+{mark}(?={re.escape(sep)}|$)|{plain})"
        found = F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(pattern), F.lit(1))
        inner = lambda x: F.regexp_replace(F.regexp_extract(x, f"(?s)^{mark}(.*){mark}$", 1), mark + mark, str(c.first("quote_char", '"')))
        parts = self.col(self.temp("csv", F.transform(found, lambda x: F.when(x.rlike(f"(?s)^{mark}.*{mark}$"), inner(x)).otherwise(F.nullif(x, F.lit(""))))))
        if names and c.first("skip_header") in (True, "true"):
            header = parts == F.array(*map(F.lit, names))
            self.df = self.df.where(~F.coalesce(header if self.guard is None else self.guard & header, F.lit(False)))
        for i, n in enumerate(names):
            self.write(n, F.get(parts, i))
        self.hints.append(Hint("csv", self.temp("csv", self.guarded(parts, None))))
        if isinstance(c.first("convert"), Pairs):
            self.mutate_convert(c.first("convert"))
        return text.isNull()

    def do_xml(self, p: Plugin) -> Column:
        text = self.text(self.fallback_source(p.config))
        ok = F.coalesce(text.rlike(r"(?s)^\s*<.*>\s*$"), F.lit(False))
        for path, token in p.config.first("xpath", Pairs()):
            for t in strings(token):
                if re.search(r"(?:/text\(\)|/@[\w:.-]+)$", path):  # nodes that are texts: a list of all of them
                    self.write(field_name(t), F.when(ok, F.xpath(text, F.lit(path))), "array")
                else:
                    self.write(field_name(t), F.when(ok, F.xpath_string(text, F.lit(path))))
        return ~ok

    def do_dissect(self, p: Plugin) -> Column | None:
        failed = None
        sep = str(p.config.first("append_separator", " "))
        for source, mapping in p.config.first("mapping", p.config.first("match", Pairs())):
            text = self.text(field_name(source))
            regex, fields = transforms.dissect_regex(str(mapping))
            hit = self.col(self.temp("dissect", F.coalesce(text.rlike(regex), F.lit(False))))
            parts: dict[str, list[Column]] = {}
            for kind, name, group in fields:
                if kind != "indirect":
                    parts.setdefault(field_name(name), []).append(F.regexp_extract(text, regex, group))
            for token, found in parts.items():
                old = self.read(token)[0]
                self.write(token, F.when(hit, F.concat_ws(sep, *found)).otherwise(old))
            failed = ~hit if failed is None else failed | ~hit
        for token, kind in p.config.first("convert_datatype", Pairs()):
            if field_name(token) in self.kinds:
                name = {"int": "bigint", "float": "double"}.get(str(kind), "string")
                self.write(field_name(token), self.col(field_name(token)).try_cast(name), name)
        return failed

    # Mutate

    def do_mutate(self, p: Plugin) -> None:
        config = p.config
        if self.runtime.dialect == "logstash":
            order = "rename update replace convert gsub uppercase lowercase strip remove_field split join merge add_field add_tag remove_tag copy".split()
            config = Pairs(sorted(config, key=lambda kv: order.index(kv[0]) if kv[0] in order else len(order)))
        self.mutate(config)

    def mutate(self, config: Pairs) -> None:
        for op, value in config:
            handler = getattr(self, f"mutate_{op}", None)
            if handler is not None:
                handler(value)

    def mutate_replace(self, value) -> None:
        for dest, text in self.pairs(value):
            if isinstance(text, list) and not isinstance(text, Pairs):
                self.write(self.name(dest), F.array(*[self.template(x)[0] for x in text]), "array")
            elif isinstance(text, Pairs):
                for k, v in text:
                    self.write(f"{self.name(dest)}.{field_name(k)}", *self.template(v))
            else:
                self.write(self.name(dest), *self.template(text))

    def mutate_update(self, value) -> None:
        for dest, text in self.pairs(value):
            name = self.name(dest)
            if name in self.kinds:
                new, kind = self.template(text)
                self.write(name, F.when(self.col(name).isNotNull(), new), kind)

    def mutate_add_field(self, value) -> None:
        for dest, text in self.pairs(value):
            name, (new, _) = self.name(dest), self.template(text)
            if name not in self.kinds:
                self.write(name, new)
            else:
                old = self.col(name) if self.kinds[name] == "array" else F.when(self.col(name).isNotNull(), F.array(self.col(name).cast("string")))
                self.write(name, F.array_append(F.coalesce(old, F.array().cast("array<string>")), new), "array")

    def mutate_rename(self, value) -> None:
        for source, dest in self.pairs(value):
            self.moved(self.name(source), field_name(str(dest)), True)

    def mutate_copy(self, value) -> None:
        for source, dest in self.pairs(value):
            self.moved(self.name(source), field_name(str(dest)), False)

    def moved(self, source: str, dest: str, away: bool) -> None:
        below = [k for k in self.kinds if k.startswith(source + ".")]
        there = source in self.kinds
        column, kind = self.read(source)
        if there or not below:
            old = self.read(dest)[0] if dest in self.kinds else None
            present = column.isNotNull()
            self.write(dest, F.when(present, column).otherwise(old) if old is not None and self.kinds.get(dest) == kind else column, kind)
        for name in below:
            self.write(dest + name[len(source) :], self.col(name), self.kinds[name])
        if away:
            self.forget(source)

    def mutate_convert(self, value) -> None:
        kinds = {"integer": "bigint", "int": "bigint", "uinteger": "bigint", "float": "double", "boolean": "boolean", "string": "string"}
        for source, wanted in self.pairs(value):
            token, kind = self.name(source), kinds.get(str(wanted), "string")
            text = self.text(token)
            if kind == "bigint":
                new = F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
            elif kind == "boolean":
                new = F.when(F.lower(text).isin("true", "t", "yes", "y", "1"), True).when(F.lower(text).isin("false", "f", "no", "n", "0"), False)
            else:
                new = text.try_cast(kind)
            self.write(token, new, kind)

    def each(self, value, change: Callable[[Column], Column]) -> None:
        for token in map(self.name, strings(value)):
            column, kind = self.read(token)
            if kind == "array":
                self.write(token, F.transform(column, change), "array")
            else:
                self.write(token, change(column.cast("string")))

    def mutate_lowercase(self, value) -> None:
        self.each(value, F.lower)

    def mutate_uppercase(self, value) -> None:
        self.each(value, F.upper)

    def mutate_strip(self, value) -> None:
        self.each(value, lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))

    def mutate_capitalize(self, value) -> None:
        self.each(value, F.initcap)

    def mutate_gsub(self, value) -> None:
        items = list(value) if isinstance(value, list) else []
        for k in range(0, len(items) - 2, 3):
            token, pattern, replacement = items[k : k + 3]
            self.each([token], partial(transforms.gsub, pattern=str(pattern), replacement=str(replacement)))

    def mutate_split(self, value) -> None:
        for source, sep in self.pairs(value):
            token = self.name(source)
            self.write(token, F.split(self.text(token), re.escape(str(sep))), "array")

    def mutate_join(self, value) -> None:
        for source, sep in self.pairs(value):
            token = self.name(source)
            column, kind = self.read(token)
            if kind == "array":
                self.write(token, F.array_join(column, str(sep)))

    def mutate_merge(self, value) -> None:
        for dest, sources in self.pairs(value):
            name = self.name(dest)
            for s in strings(sources):
                token = field_name(s)
                if name == "@output":
                    name = "_output"
                column, kind = self.read(token)
                known = token in self.kinds or token in self.aliases or self.hints or name == "_output"
                if name == "_output":
                    column, kind = F.lit(token), "string"
                elif not known:
                    column, kind = F.lit(s), "string"
                below = [k for k in self.kinds if k.startswith(token + ".")]
                if token not in self.kinds and token not in self.aliases and below and name != "_output":
                    for k in below:
                        self.append(name + k[len(token) :], self.col(k), self.kinds[k])
                    continue
                self.append(name, column, kind)

    def append(self, name: str, column: Column, kind: str) -> None:
        empty = F.array().cast("array<string>")
        more = column if kind == "array" else F.when(column.isNotNull(), F.array(column.cast("string")))
        old = empty if name not in self.kinds else self.col(name) if self.kinds[name] == "array" else F.when(self.col(name).isNotNull(), F.array(self.col(name).cast("string")))
        self.write(name, F.concat(F.coalesce(old, empty), F.coalesce(more, empty)), "array")

    def mutate_remove_field(self, value) -> None:
        for token in strings(value):
            self.forget(self.name(token))

    def mutate_add_tag(self, value) -> None:
        self.tag(strings(value))

    def mutate_remove_tag(self, value) -> None:
        self.write("tags", F.array_except(self.tags(), F.array(*[self.template(t)[0] for t in strings(value)])), "array")

    def name(self, token: str) -> str:
        """The name of a destination; references to literal loop variables cannot be names and stay as they are."""
        return field_name(str(token))

    def pairs(self, value) -> list[tuple]:
        if isinstance(value, Pairs):
            return list(value)
        return list(zip(value[::2], value[1::2], strict=False)) if isinstance(value, list) else []

    # Filters and events

    def do_drop(self, p: Plugin) -> None:
        percentage = p.config.first("percentage")
        held = self.guard if self.guard is not None else F.lit(True)
        if percentage is not None:
            held = held & (F.rand(7) * 100 < float(str(percentage)))
        self.df = self.df.where(~held)

    def do_statedump(self, p: Plugin) -> None:
        return None

    def do_on_error(self, p: Plugin) -> None:
        """The fallback runs on events for which any earlier plugin since the last such block failed."""
        flags, self.flags = [f for f in dict.fromkeys(self.flags) if f in self.kinds], []
        if flags and p.fallback:
            outer = self.guard
            failed = F.lit(False)
            for f in flags:
                failed = failed | F.coalesce(self.col(f) == "true", F.lit(False))
            self.guard = failed if outer is None else outer & failed
            self.run(p.fallback)
            self.guard = outer

    def do_clone(self, p: Plugin) -> None:
        """The event and one copy for each clone type, by exploding an array: one scan, no union."""
        types = strings(p.config.first("clones"))
        guard = self.guard if self.guard is not None else F.lit(True)
        copies = F.array(F.lit(None).cast("string"), *[F.lit(t) for t in types])
        held = f"__clone_{len(self.hidden)}"
        self.hidden.append(held)
        self.df = self.df.withColumn(held, F.explode(F.when(guard, copies).otherwise(F.array(F.lit(None).cast("string")))))
        old = self.col("type") if "type" in self.kinds else F.lit(None).cast("string")
        self.df = self.df.withColumn("type", F.coalesce(self.col(held), old))
        self.kinds["type"] = "string"

    def do_split(self, p: Plugin) -> None:
        source = field_name(str(p.config.first("field", "message")))
        target = field_name(str(p.config.first("target", source)))
        column, kind = self.read(source)
        parts = column if kind == "array" else F.split(column, re.escape(str(p.config.first("terminator", "\n"))))
        if kind != "array" and target == source and self.guard is not None:
            parts = F.when(self.guard, parts).otherwise(F.array(column))
        elif self.guard is not None:
            parts = F.when(self.guard, parts)
        self.df = self.df.withColumn(target, F.explode_outer(parts))
        self.kinds[target] = "string"

    def do_prune(self, p: Plugin) -> None:
        keep, gone = strings(p.config.first("whitelist_names")), strings(p.config.first("blacklist_names"))
        for name in [k for k in self.kinds if not k.startswith("__")]:
            if keep and not any(re.search(x, name) for x in keep) or any(re.search(x, name) for x in gone):
                self.forget(name)

    # Transforms

    def do_date(self, p: Plugin) -> Column | None:
        match = strings(p.config.first("match"))
        if not match:
            return None
        text = self.text(field_name(match[0]))
        zone = p.config.first("timezone")
        value = transforms.parse_date(text, match[1:], str(zone) if isinstance(zone, str) and not REFERENCE.search(zone) else None)
        target = field_name(str(p.config.first("target", EVENT_TIME)))
        held = self.col(self.temp("date", value))
        old = self.col(target) if self.kinds.get(target) == "timestamp" else F.lit(None).cast("timestamp")
        self.write(target, F.coalesce(held, old), "timestamp")
        return held.isNull()

    def in_place(self, config: Pairs, change: Callable[[Column], Column], sources: tuple[str, ...] = ("source", "field", "fields")) -> None:
        target = config.first("target", config.first("destination"))
        for key in sources:
            value = config.first(key)
            for token in [k for k, _ in value] if isinstance(value, Pairs) else strings(value):
                name = field_name(token)
                self.write(field_name(str(target)) if isinstance(target, str) else name, change(self.text(name)))

    def do_base64(self, p: Plugin) -> None:
        encode = p.config.first("action") == "encode"
        safe = "url" in str(p.config.first("encoding", "")).lower() or any("url" in str(v).lower() for x in p.config.all("fields") if isinstance(x, Pairs) for _, v in x)
        self.in_place(p.config, (lambda c: F.base64(c.cast("binary"))) if encode else lambda c: transforms.decode_base64(c, safe))

    def do_url_decode(self, p: Plugin) -> None:
        self.in_place(p.config, F.try_url_decode)

    do_urldecode = do_url_decode

    def do_syslog_pri(self, p: Plugin) -> None:
        source = field_name(str(p.config.first("source", p.config.first("syslog_pri_field_name", "syslog_pri"))))
        number = F.coalesce(self.text(source).try_cast("bigint"), F.lit(13))
        severity, facility = number.bitwiseAND(7), F.shiftright(number, 3)
        self.write(f"{source}_severity_code", severity, "bigint")
        self.write(f"{source}_facility_code", facility, "bigint")
        names = (strings(p.config.first("severity_labels")) or transforms.SEVERITIES, strings(p.config.first("facility_labels")) or transforms.FACILITIES)
        for kind, code, labels in (("severity", severity, names[0]), ("facility", facility, names[1])):
            self.write(f"{source}_{kind}", F.get(F.array(*map(F.lit, labels)), code.cast("int")))

    def do_translate(self, p: Plugin) -> None:
        c = p.config
        source = field_name(str(c.first("field", c.first("source", ""))))
        dest = field_name(str(c.first("destination", c.first("target", source))))
        text, fallback = self.text(source), c.first("fallback")
        path, table = c.first("dictionary_path"), c.first("dictionary", Pairs())
        if path is not None and str(path) in self.runtime.lookups:
            self.looked_up(str(path), text, dest, fallback)
            return
        entries = [(k, v) for k, v in (table if isinstance(table, Pairs) else zip(table[::2], table[1::2], strict=False)) if isinstance(v, str)]
        if not entries:
            return
        if c.first("regex") in (True, "true"):
            value = F.lit(None).cast("string")
            for k, v in reversed(entries):
                value = F.when(text.rlike(k), v).otherwise(value)
        elif c.first("exact") in (False, "false"):
            value = text
            for k, v in entries:
                value = F.replace(value, F.lit(k), F.lit(v))
        else:
            value = F.element_at(F.create_map(*[F.lit(x) for kv in dict(entries).items() for x in kv]), text)
        old = self.text(dest) if dest in self.kinds and dest != source else F.lit(None).cast("string")
        self.write(dest, F.coalesce(value, self.template(fallback)[0] if fallback is not None else old))

    def looked_up(self, name: str, key: Column, dest: str, fallback) -> None:
        held = self.temp("key", self.guarded(key, None))
        got = f"__value_{len(self.hidden)}"
        self.hidden.append(got)
        self.df = lookup_join(self.df, self.runtime.lookups[name], held, got)
        new = F.coalesce(self.col(got), self.template(fallback)[0]) if fallback is not None else self.col(got)
        self.write(dest, new)

    def do_geoip(self, p: Plugin) -> None:
        """A range lookup: the table has low, high (addresses as numbers) and any columns to take over."""
        table = self.runtime.lookups.get("geoip")
        if table is None:
            return
        source = self.fallback_source(p.config)
        target = field_name(str(p.config.first("target", "geoip")))
        held = self.temp("ip", self.guarded(transforms.ip_number(self.text(source)), None))
        wanted = strings(p.config.first("fields")) or [c for c in table.columns if c not in ("low", "high")]
        self.df = range_lookup(self.df, table, held, {c: f"__{target}.{c}" for c in wanted})
        for c in wanted:
            self.hidden.append(f"__{target}.{c}")
            self.write(f"{target}.{c}", self.col(f"__{target}.{c}").cast("string"))

    def do_useragent(self, p: Plugin) -> None:
        table = self.runtime.lookups.get("useragent")
        if table is not None:
            target = p.config.first("target")
            dest = f"{field_name(str(target))}.name" if target is not None else str(p.config.first("prefix", "")) + "name"
            self.looked_up("useragent", self.text(self.fallback_source(p.config)), dest, None)

    def do_dns(self, p: Plugin) -> None:
        if "dns" in self.runtime.lookups:
            for token in [*strings(p.config.first("resolve")), *strings(p.config.first("reverse"))]:
                name = field_name(token)
                self.looked_up("dns", self.text(name), name if p.config.first("action") == "replace" else f"{name}_dns", None)

    def external(self, name: str, config: Pairs) -> None:
        if name in self.runtime.lookups:
            key = next((field_name(str(config.first(k))) for k in ("source", "field", "key", "parameters", "query", "url", "statement") if isinstance(config.first(k), str)), "message")
            key = m[1] if (m := REFERENCE.search(key)) else key
            self.looked_up(name, self.text(field_name(key)), field_name(str(config.first("target", name))), None)

    def do_cidr(self, p: Plugin) -> None:
        address = self.template(strings(p.config.first("address"))[0])[0] if p.config.first("address") is not None else self.text("message")
        found = F.lit(False)
        for n in strings(p.config.first("network")):
            found = found | transforms.in_network(address, n)
        self.only_where(p, found)

    def do_mac(self, p: Plugin) -> None:
        self.in_place(p.config, transforms.normal_mac)

    def do_bytes(self, p: Plugin) -> None:
        self.in_place(p.config, lambda c: transforms.number_of_bytes(c).cast("bigint").cast("string"))

    def do_tld(self, p: Plugin) -> None:
        self.in_place(p.config, transforms.top_level)

    def do_extractnumbers(self, p: Plugin) -> None:
        source = self.fallback_source(p.config)
        target = field_name(str(p.config.first("target", source)))
        self.write(target, F.regexp_extract_all(self.text(source), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), "array")

    def do_truncate(self, p: Plugin) -> None:
        size = int(str(p.config.first("length_bytes", 256)))
        self.in_place(p.config, lambda c: transforms.cut_bytes(c, size))

    def do_i18n(self, p: Plugin) -> None:
        self.in_place(p.config, lambda c: F.translate(c, "áàâäãéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ", "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC"), ("source", "field", "fields", "transliterate"))

    def do_alter(self, p: Plugin) -> None:
        for value in p.config.all("coalesce"):
            items = strings(value)
            self.write(field_name(items[0]), F.coalesce(*[F.nullif(self.template(x)[0].cast("string"), F.lit("")) for x in items[1:]]))
        for value in p.config.all("condrewrite"):
            items = strings(value)
            for k in range(0, len(items) - 2, 3):
                token = field_name(items[k])
                self.write(token, F.when(self.text(token) == items[k + 1], self.template(items[k + 2])[0]).otherwise(self.text(token)))

    def do_math(self, p: Plugin) -> None:
        items = p.config.first("calculate")
        rows = items if isinstance(items, list) and items and isinstance(items[0], list) else [items] if items else []
        for op, a, b, dest in (strings(r) for r in rows):
            x, y = (self.text(field_name(v)).try_cast("double") if not re.fullmatch(r"-?\d+(\.\d+)?", v) else F.lit(float(v)) for v in (a, b))
            made = {"+": lambda: x + y, "add": lambda: x + y, "-": lambda: x - y, "sub": lambda: x - y, "subtract": lambda: x - y, "*": lambda: x * y, "multiply": lambda: x * y, "mpx": lambda: x * y, "/": lambda: F.try_divide(x, y), "divide": lambda: F.try_divide(x, y), "div": lambda: F.try_divide(x, y)}
            self.write(field_name(dest), made.get(op, lambda: F.lit(None).cast("double"))(), "double")

    def do_fingerprint(self, p: Plugin) -> None:
        method, key = str(p.config.first("method", "SHA256")).upper(), p.config.first("key")
        parts = [F.coalesce(self.text(field_name(t)), F.lit("")) for t in strings(p.config.first("source", "message"))]
        text = F.concat(*([F.lit(str(key))] if key else []), *parts)
        made = {"MD5": lambda: F.md5(text.cast("binary")), "SHA1": lambda: F.sha1(text.cast("binary")), "MURMUR3": lambda: F.hash(text).cast("string"), "UUID": lambda: F.expr("uuid()")}
        self.write(field_name(str(p.config.first("target", "fingerprint"))), made.get(method, lambda: F.sha2(text, int(re.sub(r"\D", "", method) or 256)))())

    def key_of(self, p: Plugin) -> str:
        key = p.config.first("key", self.runtime.key)
        if key is None:
            raise UnsupportedPlugin(f"line {p.line}: {p.name} needs a key")
        return str(key)

    def do_anonymize(self, p: Plugin) -> None:
        key = self.key_of(p)
        self.in_place(p.config, lambda c: F.sha2(F.concat(F.lit(key), c), 256))

    def do_cipher(self, p: Plugin) -> None:
        """AES in the mode that algorithm names (aes-256-cbc, aes-128-gcm, ...); GCM unless named."""
        key, way = F.lit(self.key_of(p)), str(p.config.first("mode", "encrypt"))
        named = str(p.config.first("algorithm", "gcm")).upper().rsplit("-", 1)[-1]
        mode = F.lit(named if named in ("ECB", "CBC", "GCM") else "GCM")
        change = (lambda c: F.base64(F.aes_encrypt(c, key, mode))) if way == "encrypt" else lambda c: F.try_aes_decrypt(F.unbase64(c), key, mode).cast("string")
        self.in_place(p.config, change)

    def do_uuid(self, p: Plugin) -> None:
        self.write(field_name(str(p.config.first("target", "uuid"))), F.expr("uuid()"))

    def share(self, key: Column) -> list[Column]:
        """What a window over the events of a key is dealt by: the key where the guard holds, and else, as for events
        without a key, a spread that keeps them apart; and whether an event takes part."""
        held = self.temp("share", self.guarded(key.cast("string"), None))
        others = [self.col(c) for c in self.df.columns if c in ("message",)] or [F.lit(0)]
        spread = self.temp("spread", F.when(self.col(held).isNull(), F.pmod(F.xxhash64(*others), F.lit(4096))))
        return [self.col(held), self.col(spread)]

    def tagged(self, tag) -> Column:
        return F.array_contains(self.tags(), str(tag))

    def do_elapsed(self, p: Plugin) -> None:
        """Seconds since the previous event of the same id; with start_tag and end_tag, from the last event with the
        one to an event with the other. Beyond timeout (seconds) there is no time but a tag. Events without an id and
        those of other branches take no part."""
        c = p.config
        dealt = self.share(self.text(field_name(str(c.first("unique_id_field", "id")))))
        order = self.read(field_name(str(c.first("timestamp_field", EVENT_TIME))))[0]
        micros = F.unix_micros(order.cast("timestamp"))
        by = Window.partitionBy(*dealt).orderBy(order, *[self.col(x) for x in strings(c.first("tie_break"))])
        start, end = c.first("start_tag"), c.first("end_tag")
        earlier = by.rowsBetween(Window.unboundedPreceding, -1)
        begun = F.last(F.when(self.tagged(start), micros), ignorenulls=True).over(earlier) if start is not None else F.lag(micros).over(by)
        takes = dealt[0].isNotNull() & (self.tagged(end) if end is not None else F.lit(True))
        passed = self.col(self.temp("passed", F.when(takes, (micros - begun) / 1e6)))
        timeout = c.first("timeout")
        late = passed > float(str(timeout)) if timeout is not None else F.lit(False)
        self.write("elapsed.time", F.when(~late, passed), "double")
        if end is not None:
            self.tag(["elapsed", "elapsed_match"], F.coalesce(passed.isNotNull() & ~late, F.lit(False)))
            self.tag(["elapsed_expired_error"], F.coalesce(late, F.lit(False)))

    def do_aggregate(self, p: Plugin) -> None:
        """The events of a task share a map. At run time aggregate.count is their number, and each simple statement of
        the code on map[name] gives aggregate.name: += number or field (sum), ||= field (first), = field (last),
        << field (all); the last three in the order of order_field. Events without a task take no part."""
        c = p.config
        dealt = self.share(F.nullif(self.template(str(c.first("task_id", "")))[0].cast("string"), F.lit("")))
        whole = Window.partitionBy(*dealt)
        order = self.read(field_name(str(c.first("order_field", EVENT_TIME))))[0]
        ordered = whole.orderBy(order, *[self.col(x) for x in strings(c.first("tie_break"))]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        give = lambda name, value, kind: self.write(name, F.when(dealt[0].isNotNull(), value), kind)
        give("aggregate.count", F.count(F.lit(1)).over(whole), "bigint")
        if isinstance(total := c.first("sum_field"), str):
            give("aggregate.sum", F.sum(self.text(field_name(total)).try_cast("double")).over(whole), "double")
        for name, op, field_, number in MAP_STATEMENT.findall(str(c.first("code", ""))):
            value = self.text(field_name(field_)) if field_ else F.lit(number)
            if op == "+=":
                give(f"aggregate.{name}", F.sum(value.try_cast("double")).over(whole), "double")
            elif op == "<<":
                give(f"aggregate.{name}", F.collect_list(value).over(ordered), "array")
            else:
                pick = F.first if op == "||=" else F.last
                give(f"aggregate.{name}", pick(value, ignorenulls=True).over(ordered), "string")

    def do_throttle(self, p: Plugin) -> None:
        """Events of a key beyond after_count, in the order of a field, are throttled, and those before before_count;
        they get the tags and fields. Events without a key and those of other branches are never."""
        c = p.config
        dealt = self.share(F.nullif(self.template(str(c.first("key", "")))[0].cast("string"), F.lit("")))
        order = self.read(field_name(str(c.first("order_field", EVENT_TIME))))[0]
        by = Window.partitionBy(*dealt).orderBy(order, *[self.col(x) for x in strings(c.first("tie_break"))])
        nth = self.col(self.temp("nth", F.row_number().over(by)))
        least, most = int(str(c.first("before_count", 0))), int(str(c.first("after_count", 1)))
        over = self.col(self.temp("over", dealt[0].isNotNull() & ((nth > most) | (nth < least))))
        self.write("throttled", over, "boolean")
        self.only_where(p, over)

    def only_where(self, p: Plugin, held: Column) -> None:
        """Apply the decorators to some events, and take them out of the configuration."""
        names = ("add_tag", "remove_tag", "add_field", "remove_field")
        outer = self.guard
        self.guard = held if outer is None else outer & held
        self.mutate(Pairs([(k, v) for k, v in p.config if k in names]))
        self.guard = outer
        p.config[:] = [(k, v) for k, v in p.config if k not in names]

    def do_ruby(self, p: Plugin) -> None:
        """Code is not run; a deployment registers a function for it."""
        if not self.runtime.skip_unsupported:
            raise UnsupportedPlugin(f"line {p.line}: ruby code needs a registered plugin")


#: A statement on an aggregate's map: map['n'] += 1, map[:first] ||= event.get('f') and the like.
MAP_STATEMENT = re.compile(r"""map\[[:'"](\w+)['"]?\]\s*(\+=|\|\|=|<<|=(?!=))\s*(?:event\.get\(\s*['"]([^'"]+)['"]\s*\)|(-?\d+(?:\.\d+)?))""")


def picked(names: list[str]) -> Callable[[Column], Column]:
    return lambda e: F.array(*[e[n] for n in names])


def foldable(body: list) -> bool:
    """Whether a loop's body only merges and replaces, and merges at all; @output anchors make rows of their own."""

    def simple(statements: list) -> bool:
        for x in statements:
            if isinstance(x, If):
                if not all(simple(a.body) for a in x.arms) or not simple(x.otherwise or []):
                    return False
            elif not isinstance(x, Plugin) or x.name != "mutate" or any(op not in ("merge", "replace") or not isinstance(v, Pairs) for op, v in x.config):
                return False
            elif any(not isinstance(t, str) and (op == "replace" or isinstance(t, Pairs)) or str(d).startswith("@") for op, v in x.config for d, t in v):
                return False
        return True

    def merges(statements: list) -> bool:
        return any(any(merges(a.body) for a in x.arms) or merges(x.otherwise or []) if isinstance(x, If) else any(op == "merge" for op, _ in x.config) for x in statements)

    return simple(body) and merges(body)


EXTERNAL = frozenset({*LOGSTASH_ONLY, "enrich_geoip", "jdbc_lookup", "threat_lookup", "cidr_lookup", "rest_filter", "http_filter"})


def json_path(token: str) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" if re.fullmatch(r"\w+", p) else f"['{p}']" for p in token.split("."))


def run_parser(code: str, events: DataFrame, runtime: Runtime | None = None, fields: list[str] | None = None) -> DataFrame:
    """Run a parser over events. fields: what to return besides the columns of events, read as the parser
    would; if None, every field that it wrote."""
    compiler = Compiler(events, runtime or Runtime())
    compiler.run(parse(code).statements)
    given = [c for c in events.columns if c in compiler.df.columns]
    if fields is None:
        fields = [c for c in compiler.kinds if not c.startswith("__") and c not in given]
    wanted = [compiler.read(f)[0].alias(f) for f in fields]
    return compiler.df.select(*[q(c) for c in given if c not in fields], *wanted)
