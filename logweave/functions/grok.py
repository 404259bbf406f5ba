"""Grok patterns: expansion, and translation to Java regexes."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from logweave.functions.patterns import LIBRARY

__all__ = ["LIBRARY", "UnknownPattern", "captures", "compile_pattern", "expand", "load_libraries", "parse_library"]

MAX_DEPTH, MAX_BODY, MAX_FILE = 32, 8192, 1 << 20


class UnknownPattern(ValueError):
    """A reference to a pattern that no library has, or that refers to itself."""


_REFERENCE = re.compile(r"%\{(\w+)(?::([^}:]+))?(?::(\w+))?\}")
_NAMED = re.compile(r"\(\?P?<([A-Za-z_][^>]*)>")
#: POSIX classes, which Java's engine reads as sets of single letters.
_POSIX = {"alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "digit": r"\d", "space": r"\s", "upper": r"\p{Upper}", "lower": r"\p{Lower}", "punct": r"\p{Punct}", "xdigit": r"\p{XDigit}", "word": r"\w", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}", "print": r"\p{Print}", "graph": r"\p{Graph}"}


def parse_library(text: str) -> dict[str, str]:
    """Lines ``NAME body``; blank lines and comments are skipped, the last of a name wins."""
    out = {}
    for line in text.splitlines():
        m = re.match(r"(\w+)\s+(\S.*)$", line)
        if m and not line.startswith("#"):
            out[m[1]] = m[2].rstrip()
    return out


def load_libraries(paths: Iterable[str]) -> dict[str, str]:
    """Pattern files, directories of them in sorted order; files over the size limit are refused."""
    out: dict[str, str] = {}
    for path in paths:
        files = sorted(os.path.join(path, f) for f in os.listdir(path)) if os.path.isdir(path) else [path]
        root = os.path.realpath(path)
        for f in files:
            if not os.path.isfile(f) or os.path.commonpath([os.path.realpath(f), root]) != root:
                continue
            if os.path.getsize(f) > MAX_FILE:
                raise ValueError(f"pattern file {f} is larger than {MAX_FILE} bytes")
            with open(f, encoding="utf-8") as text:
                out |= parse_library(text.read())
    return out


def expand(name: str, library: dict[str, str], depth: int = 0, above: tuple[str, ...] = ()) -> str | None:
    """The regex that a pattern stands for, captures left out; None if it is unknown, cyclic or too large."""
    body = library.get(name)
    if body is None or name in above or depth > MAX_DEPTH:
        return None
    parts, at = [], 0
    for m in _REFERENCE.finditer(body):
        inner = expand(m[1], library, depth + 1, (*above, name))
        if inner is None:
            return None
        parts += [body[at : m.start()], f"(?:{inner})"]
        at = m.end()
    out = "".join([*parts, body[at:]])
    return out if len(out.encode()) <= MAX_BODY else None


@dataclass
class Capture:
    token: str
    pattern: str
    kind: str | None
    group: int = 0


def captures(pattern: str, library: dict[str, str] | None = None) -> list[Capture]:
    """The named captures of a pattern, in order, and with a library those inside the patterns that it refers to, for
    each pattern once in a text."""
    known: dict[str, list[Capture]] = {}

    def inside(text: str, above: tuple[str, ...]) -> list[Capture]:
        found: list[tuple[int, Capture]] = []
        seen: set[str] = set()
        for m in _REFERENCE.finditer(text):
            if m[2]:
                found.append((m.start(), Capture(m[2], m[0], m[3])))
            if library is None or m[1] in seen or m[1] in above or len(above) >= MAX_DEPTH:
                continue
            seen.add(m[1])
            if m[1] not in known:
                known[m[1]] = inside(library.get(m[1], ""), (*above, m[1]))
            found += [(m.start(), c) for c in known[m[1]]]
        found += [(m.start(), Capture(m[1], m[0], None)) for m in _NAMED.finditer(text)]
        return [c for _, c in sorted(found, key=lambda x: x[0])]

    return inside(pattern, ())


def compile_pattern(pattern: str, library: dict[str, str]) -> tuple[str, list[Capture]]:
    """A Java regex with numbered groups, and which group each capture is. Raises UnknownPattern."""
    found: list[Capture] = []

    def inner(text: str, depth: int) -> str:
        out, at = [], 0
        for m in _REFERENCE.finditer(text):
            out.append(text[at : m.start()])
            body = library.get(m[1])
            if body is None or depth > MAX_DEPTH:
                raise UnknownPattern(m[1])
            body = inner(body, depth + 1)
            if m[2]:
                found.append(Capture(m[2], m[0], m[3]))
                out.append(f"(?<\x00{len(found) - 1}>{body})")
            else:
                out.append(f"(?:{body})")
            at = m.end()
        return "".join([*out, text[at:]])

    def named(m: re.Match) -> str:
        if m[1].startswith("\x00"):
            return m[0]
        found.append(Capture(m[1], m[0], None))
        return f"(?<\x00{len(found) - 1}>"

    regex = re.sub(r"\(\?P?<([A-Za-z_\x00][^>]*)>", named, inner(pattern, 0))
    regex = re.sub(r"\[:(\w+):\]", lambda m: _POSIX.get(m[1], m[0]), regex)
    return number_groups(regex, found)


def number_groups(regex: str, found: list[Capture]) -> tuple[str, list[Capture]]:
    """Marked groups become plain ones, and all groups are counted."""
    out, i, n, in_class = [], 0, 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            out.append(regex[i : i + 2])
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        elif c == "(" and not in_class:
            if m := re.compile(r"\(\?<\x00(\d+)>").match(regex, i):
                n += 1
                found[int(m[1])].group = n
                out.append("(")
                i = m.end()
                continue
            if not regex.startswith("(?", i):
                n += 1
        out.append(c)
        i += 1
    return "".join(out), found
