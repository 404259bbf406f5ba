"""Whether a list of conditions can hold together, as far as literals and regexes tell. Unknown never prunes."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

from logweave.operators.algebra import language, literal, satisfiable
from logweave.plans.predicate import Compare, ConditionError, Field, Literal, Logic, parse_condition

MAX_COMBINATIONS = 256
_NOT = re.compile(r"NOT\((.*)\)$", re.S)

#: (field, language, holds)
Fact = tuple


@lru_cache(maxsize=8192)
def alternatives(condition: str, holds: bool = True) -> tuple[tuple[Fact, ...], ...]:
    """Conjunctions of facts, one of which a true condition implies; an empty conjunction says nothing."""
    if m := _NOT.match(condition):
        return alternatives(m[1], not holds)
    try:
        return _facts(parse_condition(condition), holds)
    except (ConditionError, RecursionError):
        return ((),)


def _facts(node, holds: bool) -> tuple[tuple[Fact, ...], ...]:
    if isinstance(node, Logic) and node.op == "not":
        return _facts(node.parts[0], not holds)
    if isinstance(node, Logic) and node.op in ("and", "or"):
        a, b = (_facts(p, holds) for p in node.parts)
        if (node.op == "and") == holds:
            out = tuple(x + y for x, y in product(a, b))
        else:
            out = a + b
        return out if len(out) <= MAX_COMBINATIONS else ((),)
    if isinstance(node, Compare) and isinstance(node.left, Field) and isinstance(node.right, Literal):
        value = node.right.value
        if node.op in ("==", "!=") and node.right.kind == "string":
            return (((node.left.name, literal(value), (node.op == "==") == holds),),)
        if node.op in ("=~", "!~") and node.right.kind == "regex" and (held := language(value)) is not None:
            return (((node.left.name, held, (node.op == "=~") == holds),),)
        if node.op in ("in", "not in") and node.right.kind == "list" and value and all(isinstance(v, Literal) and v.kind == "string" or isinstance(v, str) for v in value):
            texts = dict.fromkeys(v if isinstance(v, str) else v.value for v in value)
            found = (node.op == "in") == holds
            each = [(node.left.name, literal(v), found) for v in texts]
            out = tuple((x,) for x in each) if found else (tuple(each),)
            return out if len(out) <= MAX_COMBINATIONS else ((),)
    return ((),)


def compatible(conditions: tuple[str, ...]) -> bool:
    """False only if the conditions contradict each other for certain."""
    options = [a for c in dict.fromkeys(conditions) if any(a := alternatives(c))]
    total = 1
    for o in options:
        total *= len(o)
        if total > MAX_COMBINATIONS:
            return True
    return any(_consistent(tuple(f for part in combo for f in part)) for combo in product(*options))


def _consistent(facts: tuple[Fact, ...]) -> bool:
    by_field: dict[str, tuple[list, list]] = {}
    for name, held, holds in facts:
        by_field.setdefault(name, ([], []))[0 if holds else 1].append(held)
    for positive, negative in by_field.values():
        # A field that is absent meets every negative fact, so only fields with a positive one can contradict.
        if positive and satisfiable(tuple(dict.fromkeys(positive)), tuple(dict.fromkeys(negative))) is False:
            return False
    return True
