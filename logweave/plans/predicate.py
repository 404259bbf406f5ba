"""Conditions: a small parser, and what they mean as Columns."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweave.plans.syntax import field_name, unescape

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<field>(?:\[[^\[\]"',]+\])+)|(?P<op>==|!=|=~|!~|<=|>=|<|>|\(|\)|\[|\]|,|!)|(?P<number>-?\d+(?:\.\d+)?(?![\w.]))|(?P<word>[A-Za-z_@%][\w@.%{}-]*))""",
    re.S,
)
_REGEX = re.compile(r"\s*/((?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])*)/")


@dataclass
class Field:
    name: str


@dataclass
class Literal:
    value: str | float | list
    kind: str  # string, number, regex or list


@dataclass
class Compare:
    op: str
    left: object
    right: object


@dataclass
class Logic:
    op: str
    parts: list


class ConditionError(ValueError):
    pass


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def next(self, take: bool = True) -> tuple[str, str]:
        m = _TOKEN.match(self.text, self.at)
        if not m or not m.lastgroup:
            return "", ""
        if take:
            self.at = m.end()
        return m.lastgroup, m[m.lastgroup]

    def take_word(self, *words: str) -> str:
        kind, text = self.next(False)
        if kind == "word" and text in words:
            self.next()
            return text
        return ""

    def expression(self):
        out = self.conjunction()
        while op := self.take_word("or", "xor", "nor"):
            out = Logic(op, [out, self.conjunction()])
        return out

    def conjunction(self):
        out = self.factor()
        while op := self.take_word("and", "nand"):
            out = Logic(op, [out, self.factor()])
        return out

    def factor(self):
        kind, text = self.next(False)
        if text == "!" and kind == "op" or kind == "word" and text == "not":
            self.next()
            return Logic("not", [self.factor()])
        if kind == "op" and text == "(":
            self.next()
            out = self.expression()
            if self.next()[1] != ")":
                raise ConditionError(f"missing ')' in {self.text!r}")
            return self.compared(out)
        return self.compared(self.operand())

    def compared(self, left):
        mark = self.at
        kind, text = self.next()
        if kind == "op" and text in ("=~", "!~"):
            return Compare(text, left, self.pattern())
        if kind == "op" and text in ("==", "!=", "<", ">", "<=", ">="):
            return Compare(text, left, self.operand())
        if kind == "word" and text == "in":
            return Compare("in", left, self.operand())
        if kind == "word" and text == "not" and self.take_word("in"):
            return Logic("not", [Compare("in", left, self.operand())])
        self.at = mark
        return left

    def pattern(self):
        if m := _REGEX.match(self.text, self.at):
            self.at = m.end()
            return Literal(m[1].replace("\\/", "/"), "regex")
        out = self.operand()
        return Literal(out.value, "regex") if isinstance(out, Literal) else out

    def operand(self):
        if self.text[self.at :].lstrip().startswith("[") and (m := re.compile(r"\s*\[(?=\s*[\"'\d\]])").match(self.text, self.at)):
            self.at = m.end()
            items = []
            while True:
                kind, text = self.next()
                if kind == "op" and text == "]":
                    return Literal(items, "list")
                if not kind:
                    raise ConditionError(f"missing ']' in {self.text!r}")
                if text != ",":
                    items.append(_plain(kind, text))
        kind, text = self.next()
        if kind == "string":
            return Literal(unescape(text[1:-1]), "string")
        if kind == "number":
            return Literal(float(text), "number")
        if kind == "field":
            return Field(field_name(text))
        if kind == "word":
            return Literal(1.0 if text == "true" else 0.0, "bool") if text in ("true", "false") else Field(field_name(text))
        raise ConditionError(f"cannot read {self.text[self.at : self.at + 20]!r} in {self.text!r}")


def _plain(kind: str, text: str) -> str:
    return unescape(text[1:-1]) if kind == "string" else text


def parse_condition(text: str):
    p = _Parser(text)
    out = p.expression()
    if p.text[p.at :].strip():
        raise ConditionError(f"cannot read {p.text[p.at :]!r} in {text!r}")
    return out


def fields_of(node) -> set[str]:
    if isinstance(node, Field):
        return {node.name}
    if isinstance(node, Compare):
        return fields_of(node.left) | fields_of(node.right)
    if isinstance(node, Logic):
        return set().union(*map(fields_of, node.parts))
    return set()


def to_column(node, read: Callable[[str], tuple[Column, str]]) -> Column:
    """The condition as a Column that is never null. read: a field's Column and kind (string, array, ...)."""
    return F.coalesce(_column(node, read), F.lit(False))


def _text(column: Column, kind: str) -> Column:
    return column if kind == "string" else column.cast("string") if kind not in ("array", "map") else F.to_json(column)


def _column(node, read) -> Column:
    if isinstance(node, Field):  # a field alone: it is there and not false
        column, kind = read(node.name)
        return column if kind == "boolean" else column.isNotNull() & (F.lit(True) if kind in ("array", "map") else _text(column, kind) != "false")
    if isinstance(node, Literal):
        return F.lit(bool(node.value))
    if isinstance(node, Logic):
        parts = [to_column(p, read) for p in node.parts]
        if node.op == "not":
            return ~parts[0]
        a, b = parts
        return {"and": a & b, "or": a | b, "xor": a != b, "nand": ~(a & b), "nor": ~(a | b)}[node.op]
    return _compare(node, read)


def _compare(node: Compare, read) -> Column:
    left, right, op = node.left, node.right, node.op
    if op == "in":
        return _membership(left, right, read)
    if op in ("=~", "!~"):
        column, kind = read(left.name) if isinstance(left, Field) else (F.lit(str(left.value)), "string")
        pattern = F.lit(right.value) if isinstance(right, Literal) else read(right.name)[0]
        found = F.coalesce(F.exists(column, lambda x: x.rlike(pattern)) if kind == "array" else F.rlike(_text(column, kind), pattern), F.lit(False))
        return found if op == "=~" else ~found
    a, b = _operand(left, read), _operand(right, read)
    if any(k in ("number", "double", "int", "bigint") for _, k in (a, b)):
        x, y = a[0].try_cast("double"), b[0].try_cast("double")
    else:
        x, y = _text(*a), _text(*b)
    if op == "==":
        return x.eqNullSafe(y) if isinstance(left, Field) and isinstance(right, Field) else x == y
    if op == "!=":
        return ~x.eqNullSafe(y)
    return {"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op]


def _operand(node, read) -> tuple[Column, str]:
    if isinstance(node, Field):
        return read(node.name)
    if isinstance(node, Literal):
        if node.kind == "bool":
            return F.lit("true" if node.value else "false"), "string"
        return F.lit(node.value), node.kind
    return to_column(node, read), "boolean"


def _membership(left, right, read) -> Column:
    needle, kind = _operand(left, read)
    if isinstance(right, Literal) and right.kind == "list":
        return _text(needle, kind).isin(*right.value) if right.value else F.lit(False)
    column, held = _operand(right, read)
    if held == "array":
        return F.array_contains(column, _text(needle, kind))
    return F.contains(_text(column, held), _text(needle, kind))  # a part of a string, not a member
