"""What a parser has assigned so far, along one path; branches are overlays that are merged again."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import islice

from logweave.operators.model import Anchor, Diagnostics, Hint, IoAnchor, Lineage, unique
from logweave.operators.registry import MAX_DROP_CONDITIONS, MAX_MERGE_ALTERNATIVES, MAX_NOOP_ALTERNATIVES


@dataclass(frozen=True)
class Tags:
    """Tags that an event has for certain, and those it may have."""

    definitely: frozenset[str] = frozenset()
    possibly: frozenset[str] = frozenset()
    dynamic: bool = False

    def add(self, tags: Iterable[str]) -> Tags:
        new = frozenset(tags)
        return Tags(self.definitely | new, self.possibly | new, self.dynamic)

    def maybe(self, tags: Iterable[str]) -> Tags:
        return Tags(self.definitely, self.possibly | frozenset(tags), self.dynamic)

    def remove(self, tags: Iterable[str]) -> Tags:
        gone = frozenset(tags)
        return Tags(self.definitely - gone, self.possibly - gone, self.dynamic)

    def join(self, other: Tags) -> Tags:
        return Tags(self.definitely & other.definitely, self.possibly | other.possibly, self.dynamic or other.dynamic)

    def holds(self, tag: str) -> bool | None:
        if tag in self.definitely:
            return True
        return None if tag in self.possibly or self.dynamic else False


@dataclass
class Shared:
    """What all paths of one analysis have in common."""

    diagnostics: Diagnostics = field(default_factory=Diagnostics)
    #: For every dotted prefix, the tokens below it that any path has written.
    below: dict[str, dict[str, None]] = field(default_factory=dict)
    mutated: set[str] = field(default_factory=set)
    loops: int = 0


class State:
    """Assignments as an overlay on the parent path's: a fork costs nothing, and a merge only what was changed."""

    def __init__(self, shared: Shared, parent: State | None = None) -> None:
        self.shared, self.parent = shared, parent
        #: The rows of each token, as the keys of a dict: in order, each once.
        self.own: dict[str, dict[Lineage, None]] = {}
        self.depth = parent.depth + 1 if parent else 0
        self.hints: list[Hint] = list(parent.hints) if parent else []
        self.hint_base = len(self.hints)
        self.anchors: list[Anchor] = []
        self.io_anchors: list[IoAnchor] = []
        self.routes: list[tuple] = []
        self.tags: Tags = parent.tags if parent else Tags()
        self.path_conditions: tuple[str, ...] = parent.path_conditions if parent else ()
        self.implicit: dict[str, tuple[str, ...]] = dict(parent.implicit) if parent else {}
        self.dropped = False

    def fork(self) -> State:
        return State(self.shared, self)

    def get(self, token: str) -> dict[Lineage, None]:
        state: State | None = self
        while state is not None:
            if token in state.own:
                return state.own[token]
            state = state.parent
        return {}

    def has(self, token: str) -> bool:
        return bool(self.get(token))

    def set(self, token: str, rows: Iterable[Lineage]) -> None:
        self.own[token] = dict.fromkeys(rows)
        self.register(token)

    def append(self, token: str, rows: Iterable[Lineage]) -> None:
        """Add to a token's rows; what the parent path has is copied at the first time only."""
        if token not in self.own:
            self.own[token] = dict(self.get(token))
            self.register(token)
        self.own[token].update(dict.fromkeys(rows))

    def register(self, token: str) -> None:
        at = token.rfind(".")
        while at > 0:
            names = self.shared.below.setdefault(token[:at], {})
            if token in names:
                break
            names[token] = None
            at = token.rfind(".", 0, at)

    def summary(self, token: str, rows: dict[Lineage, None]) -> Lineage:
        message = f"token {token!r} has {len(rows)} alternatives; summarized after limit {MAX_MERGE_ALTERNATIVES}"
        self.shared.diagnostics.add("branch_lineage_fanout", "warning", message, None, token)
        return Lineage("conditional", unique(s for r in islice(rows, 64) for s in r.sources), f"{len(rows)} alternatives", conditions=("summarized branch alternatives",), notes=(message,))

    def under(self, token: str) -> list[str]:
        """Tokens below a token that exist on this path."""
        return [t for t in self.shared.below.get(token, ()) if self.has(t)]

    def forget(self, token: str) -> None:
        self.own[token] = {}

    def unbind(self, token: str) -> None:
        """Facts that patterns implied about a token, and what lies below it, no longer hold."""
        for t in [t for t in self.implicit if t == token or t.startswith(token + ".")]:
            del self.implicit[t]

    def tokens(self) -> list[str]:
        seen: dict[str, None] = {}
        state: State | None = self
        chain = []
        while state is not None:
            chain.append(state)
            state = state.parent
        for s in reversed(chain):
            seen.update(dict.fromkeys(s.own))
        return [t for t in seen if self.has(t)]


@dataclass
class Branch:
    state: State
    conditions: tuple[str, ...]
    idle: bool = False  # an arm that does nothing
    #: What the arm itself requires, where conditions also has what leads to the block.
    label: tuple[str, ...] | None = None


def survived(state: State, conditions: list[str]) -> None:
    """The path goes on because events were not dropped; many such conditions are counted instead of listed."""
    held = [c for c in state.path_conditions if c.startswith("NOT(drop path:")]
    counted = next((c for c in state.path_conditions if c.startswith("NOT(any of ") and c.endswith(" drop paths)")), None)
    number = int(counted.split()[2]) if counted else 0
    if number or len(held) + len(conditions) > MAX_DROP_CONDITIONS:
        rest = tuple(c for c in state.path_conditions if c not in held and c != counted)
        state.path_conditions = (*rest, f"NOT(any of {number + len(held) + len(conditions)} drop paths)")
    else:
        state.path_conditions = unique((*state.path_conditions, *conditions))


def merge(base: State, branches: list[Branch], location: str) -> None:
    """Join the paths that survive into ``base``.

    A token that some path changed becomes the union of all paths: rows that a path wrote are kept as they
    are, and where a path left the token alone its old rows hold under that path's conditions, unless
    another path kept the very same row.
    """
    for b in branches:
        base.routes += b.state.routes
    alive = [b for b in branches if not b.state.dropped]
    if not alive:
        base.dropped = True
        return
    gone = [b for b in branches if b.state.dropped]
    if gone:
        texts = [" AND ".join(b.conditions if b.label is None else b.label) or "always" for b in gone]
        survived(base, [f"NOT(drop path: {t})" for t in texts])
    changed = sorted({t for b in alive for t in b.state.own})
    for token in changed:
        old = base.get(token)
        rows: dict[Lineage, None] = {}
        written = [b for b in alive if token in b.state.own]
        kept = {r for b in written for r in b.state.own[token]}
        for b in alive:
            if token in b.state.own:
                rows.update(dict.fromkeys(b.state.own[token]))
            elif old:
                if b.idle and len(old) > MAX_NOOP_ALTERNATIVES:
                    rows[base.summary(token, old).under(b.conditions)] = None
                else:
                    rows.update((r if r in kept else r.under(b.conditions), None) for r in old)
            elif "." not in token and token in base.shared.mutated:
                note = "not assigned on this branch path"
                rows[Lineage("unresolved", (), token, conditions=b.conditions, parser_locations=(location,), notes=(note,))] = None
        base.set(token, rows if len(rows) <= MAX_MERGE_ALTERNATIVES else [base.summary(token, rows)])
    for b in alive:
        s = b.state
        base.hints += [h for h in s.hints[s.hint_base :] if h not in base.hints]
        base.anchors += s.anchors
        base.io_anchors += s.io_anchors
    tags = alive[0].state.tags
    shared = dict(alive[0].state.implicit)
    paths = set(alive[0].state.path_conditions)
    for b in alive[1:]:
        tags = tags.join(b.state.tags)
        shared = {t: tuple(c for c in cs if c in b.state.implicit.get(t, ())) for t, cs in shared.items()}
        paths &= set(b.state.path_conditions)
    base.tags = tags
    base.implicit = {t: cs for t, cs in shared.items() if cs}
    base.path_conditions = unique(base.path_conditions + tuple(c for c in alive[0].state.path_conditions if c in paths))
