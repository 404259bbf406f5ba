"""The front end: comments, statements, plugin configurations. It never raises on bad input.

A parser source is a sequence of plugins ``name { config }``, conditionals, loops and the blocks
``filter``, ``input`` and ``output``. What cannot be read becomes an Unknown statement with a diagnostic,
and reading goes on behind it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

MAX_DEPTH = 64
#: Blocks without an end behind which reading goes on, line by line; the next one takes the rest of the source.
MAX_UNCLOSED = 64

Value = "str | bool | list | Pairs"


class Pairs(list):
    """A map literal: (key, value) pairs in order, duplicates kept."""

    def first(self, key: str, default=None):
        return next((v for k, v in self if k == key), default)

    def all(self, key: str) -> list:
        return [v for k, v in self if k == key]


class Bare(str):
    """An unquoted word."""


class Regex(str):
    """The body of a /regex/ literal."""


@dataclass
class Diagnostic:
    line: int
    column: int
    message: str


@dataclass
class Plugin:
    name: str
    config: Pairs
    line: int
    body: str = ""
    diagnostics: list[Diagnostic] = field(default_factory=list)
    #: Statements of an on_error block.
    fallback: list | None = None


@dataclass
class Arm:
    condition: str
    body: list
    line: int


@dataclass
class If:
    arms: list[Arm]
    otherwise: list | None
    line: int


@dataclass
class For:
    variables: list[str]
    iterable: str
    is_map: bool
    header: str
    body: list
    line: int


@dataclass
class Io:
    kind: str
    body: list
    line: int


@dataclass
class Unknown:
    text: str
    line: int


@dataclass
class Program:
    statements: list
    diagnostics: list[Diagnostic]


class _Error(Exception):
    def __init__(self, at: int, message: str) -> None:
        super().__init__(message)
        self.at, self.message = at, message


_MATCH_BEFORE = re.compile(r"[=!]~\s*$")
_REGEX_BEFORE = re.compile(r"(?:[=!]~|=>|[\[,(])\s*$")
_NAME = re.compile(r"[A-Za-z_@][A-Za-z0-9_.@-]*")
#: An unquoted word: braces belong to it in pairs, an equals sign if it is no arrow.
_BARE = re.compile(r"(?:[^\s{}\[\],\"'=]++|=(?!>)|(?<=[\w/.:=-])\{[^\s{}\"',]*+\})+")
#: A quoted path that ends in a backslash, at the end of a line or before a delimiter.
_LAST_BACKSLASH = re.compile(r"([\"'])[\w:./-]*+(?:\\[\w:./-]++)*+\\\1(?=[ \t]*(?:[}\],\n]|\Z))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "b": "\b", "v": "\v", "\\": "\\"}
REFERENCE = re.compile(r"%\{([^}]+)\}")
_HEX = re.compile(r"x[0-9A-Fa-f]{2}|u[0-9A-Fa-f]{4}")


def _quote_end(text: str, at: int) -> int:
    """The place behind a quoted string that begins at ``at``, or the end of the text.

    A backslash takes the next character's meaning, but where that would carry a path such as "\\" or "C:\\dir\\" beyond
    its line, its last quote closes it.
    """
    start, mark = at, text[at]
    at += 1
    while at < len(text) and text[at] != mark:
        at += 2 if text[at] == "\\" else 1
    end = min(at + 1, len(text))
    if (at >= len(text) or "\n" in text[start:end]) and (m := _LAST_BACKSLASH.match(text, start)):
        return m.end()
    return end


def _slash(text: str, at: int, lines: bool) -> int | None:
    """The place behind the slash that closes a regex literal: on its line none inside a class, if its classes are closed."""
    stop = len(text) if lines else text.find("\n", at)
    stop = len(text) if stop < 0 else stop
    for classes in (False,) if lines else (True, False):
        inside, i = False, at + 1
        while i < stop:
            c = text[i]
            if c == "\\":
                i += 1
            elif c == "/" and not inside:
                return i + 1
            elif classes and c in "[]":
                inside = c == "["
            i += 1
    return None


def _regex_end(text: str, at: int) -> int | None:
    """The place behind the regex literal whose slash is at ``at``, or None.

    Behind a match operator any slash begins one, which may go over lines if a block or a logical word follows it.
    Elsewhere a literal ends its value, so /var/log/x and /a_{/b/} are paths.
    """
    end = _slash(text, at, False)
    if _MATCH_BEFORE.search(text[max(0, at - 8) : at]):
        if end is None and (far := _slash(text, at, True)) and re.compile(r"\s*(?:[{)]|and\b|or\b)").match(text, far):
            return far
        return end
    return end if end is None or end == len(text) or text[end] in " \t\r\n,]})" else None


def _in_url(text: str, at: int) -> bool:
    """Whether a number sign stands inside an unquoted address."""
    start = max(text.rfind(c, 0, at) for c in " \t\n,\"'[{") + 1
    return "://" in text[start:at]


def strip_comments(text: str) -> str:
    """Comments become spaces, so that every other character keeps its place."""
    out, at, plain = [], 0, 0

    def blank(start: int, end: int) -> None:
        nonlocal plain
        out.append(text[plain:start])
        out.append(re.sub(r"[^\n]", " ", text[start:end]))
        plain = end

    special = re.compile(r"[\"'#/]")
    while m := special.search(text, at):
        at, c = m.start(), m[0]
        if c in "\"'":
            # An apostrophe inside a word is no quote.
            at = at + 1 if c == "'" and at and text[at - 1].isalnum() else _quote_end(text, at)
            continue
        line_end = text.find("\n", at)
        line_end = len(text) if line_end < 0 else line_end
        if c == "#":
            if _in_url(text, at):
                at += 1
                continue
            blank(at, line_end)
            at = line_end
        elif text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = len(text) if end < 0 else end + 2
            blank(at, end)
            at = end
        elif _REGEX_BEFORE.search(text[max(0, at - 8) : at]) and (end := _regex_end(text, at)):
            at = end
        elif text.startswith("//", at) and (at == 0 or text[at - 1] in " \t\n{}") and ("=>" not in text[at:line_end] or text[at + 2 : at + 3].isspace()):
            blank(at, line_end)
            at = line_end
        else:
            at += 1
    out.append(text[plain:])
    return "".join(out)


class Reader:
    def __init__(self, text: str, first_line: int = 1) -> None:
        self.text = strip_comments(text)
        self.at = 0
        self.diagnostics: list[Diagnostic] = []
        self.unclosed = 0
        self.starts = [0, *[m.end() for m in re.finditer("\n", self.text)]]
        self.first_line = first_line

    def line(self, at: int | None = None) -> int:
        return bisect_right(self.starts, self.at if at is None else at) - 1 + self.first_line

    def note(self, at: int, message: str) -> Diagnostic:
        row = bisect_right(self.starts, at) - 1
        d = Diagnostic(row + self.first_line, at - self.starts[row] + 1, message)
        self.diagnostics.append(d)
        return d

    def space(self) -> None:
        m = re.compile(r"\s*").match(self.text, self.at)
        self.at = m.end()

    def peek(self) -> str:
        self.space()
        return self.text[self.at] if self.at < len(self.text) else ""

    # Statements

    def program(self) -> Program:
        out = self.statements(0, False)
        return Program(out, self.diagnostics)

    def statements(self, depth: int, inner: bool) -> list:
        out: list = []
        while c := self.peek():
            if c == "}":
                if inner:
                    return out
                self.note(self.at, "unexpected '}'")
                out.append(Unknown("}", self.line()))
                self.at += 1
                continue
            start = self.at
            try:
                out += self.statement(depth)
            except _Error as e:
                self.note(e.at, e.message)
                self.at = max(start, self.at)
                self.recover(start)
                out.append(Unknown(self.text[start : self.at].strip(), self.line(start)))
        if inner:
            self.note(self.at, "missing '}'")
        return out

    def recover(self, start: int) -> None:
        """Skip to the end of the line, or of the block that opens on it."""
        end = self.text.find("\n", start)
        end = len(self.text) if end < 0 else end
        brace = self.text.find("{", start, end)
        self.at = (self.block_end(brace) or end) if brace >= 0 else max(end, start + 1)

    def block_end(self, at: int) -> int | None:
        """The place behind the brace that closes the one at ``at``."""
        depth, i, text = 0, at, self.text
        while i < len(text):
            c = text[i]
            if c in "\"'":
                i = i + 1 if c == "'" and text[i - 1].isalnum() else _quote_end(text, i)
                continue
            if c == "/" and _REGEX_BEFORE.search(text[max(0, i - 8) : i]) and (end := _regex_end(text, i)):
                i = end
                continue
            depth += (c == "{") - (c == "}")
            i += 1
            if depth == 0:
                return i
        return None

    def word(self) -> str:
        self.space()
        m = _NAME.match(self.text, self.at)
        if not m:
            raise _Error(self.at, f"unexpected {self.text[self.at : self.at + 1]!r}")
        self.at = m.end()
        return m[0]

    def keyword(self, name: str) -> bool:
        self.space()
        if re.compile(rf"{name}\b").match(self.text, self.at):
            self.at += len(name)
            return True
        return False

    def header(self) -> str:
        """Text up to the brace that opens a block; white space is one space outside of regexes, and as it is beside quotes."""
        start, i, text, depth = self.at, self.at, self.text, 0
        regexes: list[tuple[int, int]] = []
        while i < len(text):
            c = text[i]
            if c in "\"'":
                i = _quote_end(text, i)
                continue
            if c == "/" and _REGEX_BEFORE.search(text[max(start, i - 8) : i]) and (end := _regex_end(text, i)):
                regexes.append((i, end))
                i = end
                continue
            if m := REFERENCE.match(text, i):
                i = m.end()
                continue
            depth += (c in "[(") - (c in "])")
            if c == "{" and depth <= 0:
                self.at = i
                if '"' in text[start:i] or "'" in text[start:i]:
                    return text[start:i].strip()
                out, plain = [], start
                for a, b in regexes:
                    out += [re.sub(r"\s+", " ", text[plain:a]), text[a:b]]
                    plain = b
                return "".join([*out, re.sub(r"\s+", " ", text[plain:i])]).strip()
            i += 1
        raise _Error(start, "missing '{'")

    def block(self, depth: int) -> list:
        if self.peek() != "{":
            raise _Error(self.at, "missing '{'")
        if depth > 4 * MAX_DEPTH:
            raise _Error(self.at, "blocks are nested too deeply")
        self.at += 1
        out = self.statements(depth + 1, True)
        if self.peek() == "}":
            self.at += 1
        return out

    def statement(self, depth: int) -> list:
        start, line = self.at, self.line()
        name = self.word()
        if name == "if":
            return [self.conditional(depth, line)]
        if name in ("else", "elsif"):
            raise _Error(start, f"{name!r} without 'if'")
        if name == "for":
            return [self.loop(depth, line)]
        if self.peek() != "{":
            raise _Error(self.at, f"expected '{{' after {name!r}")
        if name == "filter":
            return self.block(depth)
        if name in ("input", "output") and depth == 0:
            return [Io(name, self.block(depth), line)]
        open_at = self.at
        if name == "on_error":
            return [Plugin(name, Pairs(), line, fallback=self.block(depth))]
        config, notes = self.config(open_at)
        return [Plugin(name, config, line, self.text[open_at + 1 : max(open_at + 1, self.at - 1)], notes)]

    def conditional(self, depth: int, line: int) -> If:
        arms = [Arm(self.header(), self.block(depth), line)]
        otherwise = None
        while True:
            self.space()
            mark, at = self.at, self.line()
            if self.keyword("elsif") or (self.keyword("else") and self.keyword("if")):
                arms.append(Arm(self.header(), self.block(depth), at))
                continue
            self.at = mark
            if self.keyword("else"):
                otherwise = self.block(depth)
            return If(arms, otherwise, line)

    def loop(self, depth: int, line: int) -> For:
        header = self.header()
        m = re.fullmatch(r"(.+?)\s+in\s+(.+?)(\s+map)?", header, re.S)
        if not m:
            raise _Error(self.at, f"cannot read loop header {header!r}")
        names = [v.strip() for v in m[1].split(",") if v.strip()]
        return For(names, m[2].strip(), bool(m[3]), header, self.block(depth), line)

    # Configurations

    def config(self, open_at: int) -> tuple[Pairs, list[Diagnostic]]:
        known = len(self.diagnostics)
        try:
            self.at = open_at + 1
            out = self.pairs("}", 0)
            return out, self.diagnostics[known:]
        except (_Error, RecursionError) as e:
            at, message = (e.at, e.message) if isinstance(e, _Error) else (open_at, "configuration is nested too deeply")
            end = self.block_end(open_at)
            if end is None and self.unclosed < MAX_UNCLOSED:  # no configuration, but a block that is never closed
                self.unclosed += 1
                raise _Error(open_at, "missing '}'") from e
            note = self.note(at, message)
            self.diagnostics.pop()  # it belongs to the plugin
            self.at = end or len(self.text)
            return Pairs(), [note]

    def pairs(self, end: str, depth: int) -> Pairs:
        if depth > MAX_DEPTH:
            raise _Error(self.at, "configuration is nested too deeply")
        out = Pairs()
        while True:
            c = self.peek()
            if not c:
                raise _Error(self.at, f"missing {end!r}")
            if c == end:
                self.at += 1
                return out
            if c == ",":
                self.at += 1
                continue
            key = self.key()
            self.space()
            if self.text.startswith("=>", self.at):
                self.at += 2
                out.append((key, self.value(depth)))
            elif self.text.startswith("=", self.at):
                self.at += 1
                out.append((key, self.value(depth)))
            elif self.peek() == "{" and key == "on_error":
                self.block_end(self.at)
                inner = self.at
                self.at += 1
                out.append((key, self.pairs("}", depth + 1) if self.block_end(inner) else True))
            else:
                out.append((key, True))

    def key(self) -> str:
        c = self.peek()
        if c in "\"'":
            return self.string()
        if c == "[":
            m = re.compile(r"(?:\[[^\[\]\n]*\])+").match(self.text, self.at)
            if not m:
                raise _Error(self.at, "cannot read a key")
            self.at = m.end()
            return m[0]
        m = re.compile(r"[^\s{},\"'=]+(?:=(?!>)[^\s{},\"'=]+)*").match(self.text, self.at)
        if not m or m[0].startswith("]"):
            raise _Error(self.at, f"unexpected {c!r} in a configuration")
        self.at = m.end()
        return m[0]

    def value(self, depth: int):
        if depth > MAX_DEPTH:
            raise _Error(self.at, "configuration is nested too deeply")
        c = self.peek()
        if not c or c in "}],":
            raise _Error(self.at, "missing a value")
        if c in "\"'":
            return self.string()
        if c == "{":
            self.at += 1
            return self.pairs("}", depth + 1)
        if c == "[":
            m = re.compile(r"(?:\[[A-Za-z_@][\w@.-]*\])+(?=\s*(?:\}|\n|\Z|[a-z_]+\s*=>))").match(self.text, self.at)
            if m and m[0].count("[") > 1:  # a field reference
                self.at = m.end()
                return Bare(m[0])
            self.at += 1
            return self.array(depth + 1)
        if c == "/" and (end := _regex_end(self.text, self.at)):
            body = self.text[self.at + 1 : end - 1]
            self.at = end
            return Regex(body)
        m = _BARE.match(self.text, self.at)
        if not m:
            raise _Error(self.at, f"unexpected {c!r} in a configuration")
        self.at = m.end()
        word = m[0]
        return {"true": True, "false": False}.get(word, Bare(word))

    def array(self, depth: int) -> list:
        out: list = []
        while True:
            c = self.peek()
            if not c:
                raise _Error(self.at, "missing ']'")
            if c == "]":
                self.at += 1
                return out
            if c == ",":
                self.at += 1
                continue
            out.append(self.value(depth))

    def string(self) -> str:
        start, end = self.at, _quote_end(self.text, self.at)
        if end > len(self.text) or end - start < 2 or self.text[end - 1] != self.text[start]:
            raise _Error(start, "missing closing quote")
        self.at = end
        return unescape(self.text[start + 1 : end - 1])


def unescape(raw: str) -> str:
    if "\\" not in raw:
        return raw
    out, i = [], 0
    while i < len(raw):
        c = raw[i]
        if c != "\\" or i + 1 == len(raw):
            out.append(c)
            i += 1
            continue
        n = raw[i + 1]
        if n in _ESCAPES:
            out.append(_ESCAPES[n])
            i += 2
        elif n in "\"'":
            out.append(n)
            i += 2
        elif m := _HEX.match(raw, i + 1):
            out.append(chr(int(m[0][1:], 16)))
            i = m.end()
        else:  # unknown escapes stay as they are
            out.append("\\" + n)
            i += 2
    return "".join(out)


def parse(code: str) -> Program:
    """The statements of a parser source; filter blocks are flattened."""
    reader = Reader(code.removeprefix("﻿"))
    try:
        return reader.program()
    except RecursionError:
        return Program([Unknown(code[:80], 1)], [Diagnostic(1, 1, "the source is nested too deeply")])


def field_name(ref: str) -> str:
    """The dotted name of a reference: %{x}, [a][b], a[0][n] or a plain name."""
    ref = ref.strip()
    if m := re.fullmatch(r"%\{([^{}]+)\}", ref):
        ref = m[1].strip()
    if m := re.fullmatch(r"([A-Za-z_@][\w@.-]*)?((?:\[[^\[\]]+\])+)", ref):
        parts = [p.strip("\"'") for p in re.findall(r"\[([^\[\]]+)\]", m[2])]
        return ".".join([*([m[1]] if m[1] else []), *parts])
    return ref
