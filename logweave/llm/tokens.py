"""Token counts by rank-synchronous array merging.

Pre-tokens are byte-pair encoded in batches: their symbols lie in one flat array with a sequence number
each. In every round each sequence finds the pair of lowest rank among its neighbours and merges all its
places at once, while the other sequences merge theirs; sequences without a ranked pair drop out. What is
left is counted. Texts repeat words, so only words that a worker has not met recently are merged.

A pre-token of thousands of bytes would go through all its rounds at full length. Such a one keeps, for each rank, the
places where its pair stands, and a round touches only those: still the lowest rank at all its places at once.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.frames import utf8

LIMIT = 2048
#: Chunks between white space whose counts a worker remembers; it starts anew when there are more.
REMEMBERED = 400_000
#: Symbols that are merged together, 40 bytes each.
BATCH_SYMBOLS = 1 << 20
#: Bytes from which a pre-token is merged by itself.
LONG = 2048

#: White space as the vocabulary's pattern language has it.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: The pre-token pattern on lower-case ASCII without white space.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_NONE = np.int64(1 << 60)


@lru_cache(maxsize=1)
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest in turn from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merger:
    """Byte-pair merges as sorted arrays: key (left * size + right), rank, and the merged symbol."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        size = self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * size + vocabulary[b] for a, b in merges], dtype=np.int64)
        made = np.array([vocabulary[a + b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], np.arange(len(merges), dtype=np.int64)[order], made[order]
        self.by_rank = keys, made
        self.inner = np.array([vocabulary[c] for c in byte_symbols()], dtype=np.int64)
        self.final = np.array([vocabulary[c + suffix] for c in byte_symbols()], dtype=np.int64)

    def counts(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols that survive in each pre-token; none is empty."""
        if any(len(p) >= LONG for p in pretokens):
            short = [p for p in pretokens if len(p) < LONG]
            found = iter(self.counts(short).tolist())
            return np.array([self._merge_long(p) if len(p) >= LONG else next(found) for p in pretokens], dtype=np.int64)
        out, at, size = np.zeros(len(pretokens), dtype=np.int64), 0, 0
        for k, p in enumerate(pretokens):
            if size and size + len(p) > BATCH_SYMBOLS:
                out[at:k] = self._merge(pretokens[at:k])
                at, size = k, 0
            size += len(p)
        if pretokens:
            out[at:] = self._merge(pretokens[at:])
        return out

    def _merge(self, pretokens: list[bytes]) -> np.ndarray:
        lengths = np.fromiter(map(len, pretokens), dtype=np.int64, count=len(pretokens))
        data = np.frombuffer(b"".join(pretokens), dtype=np.uint8)
        symbol, sequence = self.inner[data], np.repeat(np.arange(len(lengths)), lengths)
        last = np.cumsum(lengths) - 1
        symbol[last] = self.final[data[last]]
        alive = lengths.copy()
        while len(symbol) > 1:
            pair = symbol[:-1] * self.size + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = (self.keys[at] == pair) & (sequence[:-1] == sequence[1:])
            rank = np.where(known, self.ranks[at], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], sequence[1:] != sequence[:-1]]))
            sizes = np.diff(np.append(starts, len(symbol)))
            lowest = np.minimum.reduceat(np.append(rank, _NONE), starts)
            goes_on = np.repeat(lowest < _NONE, sizes)
            pick = (rank == np.repeat(lowest, sizes)[:-1]) & known
            # In a run of one symbol the pairs overlap; from the left, every other one is merged.
            touching = pick[1:] & pick[:-1]
            if touching.any():
                place = np.arange(len(pick))
                begins = np.concatenate([[True], ~touching]) & pick
                run = np.maximum.accumulate(np.where(begins, place, -1))
                pick &= (place - run) % 2 == 0
            merged = np.flatnonzero(pick)
            symbol = symbol.copy()
            symbol[merged] = self.made[at[merged]]
            np.subtract.at(alive, sequence[merged], 1)
            keep = goes_on.copy()
            keep[merged + 1] = False
            symbol, sequence = symbol[keep], sequence[keep]
        return alive


    def _merge_long(self, pretoken: bytes) -> int:
        data = np.frombuffer(pretoken, dtype=np.uint8)
        n = left = len(data)
        symbol = self.inner[data]
        symbol[-1] = self.final[data[-1]]
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        waiting: dict[int, list[np.ndarray]] = {}
        order: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Note the pairs that begin at these places under their ranks."""
            at = at[after[at] < n]
            pair = symbol[at] * self.size + symbol[after[at]]
            k = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            known = self.keys[k] == pair
            at, rank = at[known], self.ranks[k[known]]
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cuts = np.flatnonzero(np.diff(rank, prepend=-1)).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(rank)], strict=False):
                r = int(rank[i])
                if r not in waiting:
                    waiting[r] = []
                    heappush(order, r)
                waiting[r].append(at[i:j])

        enter(np.arange(n - 1))
        while order:
            r = heappop(order)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (after[at] < n)]
            at = at[symbol[at] * self.size + symbol[after[at]] == self.by_rank[0][r]]
            if len(at) > 1:  # pairs that overlap in a run of one symbol: every other one, from the left
                place = np.arange(len(at))
                begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
                at = at[(place - np.maximum.accumulate(np.where(begins, place, -1))) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            behind = after[gone]
            symbol[at], after[at], alive[gone] = self.by_rank[1][r], behind, False
            inside = behind < n
            before[behind[inside]] = at[inside]
            left -= len(at)
            previous = before[at]
            enter(np.unique(np.concatenate([at, previous[previous >= 0]])))
        return left


class TokenCounter:
    """Counts as the tokenizers library gives them for a word-level BPE file, without special tokens added.

    Normalising and splitting of anything but plain ASCII is left to the library's own components, so that
    its Unicode tables decide; the merging is this module's.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merger = Merger(model["vocab"], merges, model["end_of_word_suffix"] or "")
        own = Tokenizer.from_file(path)
        self.normalise, self.split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self.bytes_of = {c: b for b, c in enumerate(byte_symbols())}
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.known: dict[str, int] = {}

    def pretokens(self, chunk: str) -> list[bytes]:
        if chunk.isascii():
            return [p.encode() for p in _ASCII.findall(chunk.lower())]
        return [bytes(map(self.bytes_of.__getitem__, p)) for p, _ in self.split(self.normalise(chunk))]

    def learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > REMEMBERED:
            self.known.clear()
        parts = [self.pretokens(c) for c in chunks]
        sums = np.concatenate([[0], np.cumsum(self.merger.counts([p for ps in parts for p in ps]))])
        ends = np.cumsum([len(ps) for ps in parts])
        self.known.update(zip(chunks, (sums[ends] - sums[ends - [len(ps) for ps in parts]]).tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        bags: list[tuple[Counter, int]] = []
        for t in texts:
            special = 0
            if self.special and (found := self.special.findall(t)):
                special, t = len(found), self.special.sub("\n", t)
            bags.append((Counter(_SPACE.split(t)), special))
        out = [0] * len(bags)
        at = 0
        while at < len(bags):  # as many texts at a time as have few enough new chunks
            new: dict[str, None] = {}
            to = at
            while to < len(bags) and (to == at or len(new) < 20_000):
                new.update((c, None) for c in bags[to][0] if c and c not in self.known)
                to += 1
            known = self.known
            if new:
                old = {} if len(known) + len(new) <= REMEMBERED else {c: known[c] for bag, _ in bags[at:to] for c in bag if c in known}
                self.learn(list(new))
                known.update(old)
            for k in range(at, to):
                bag, special = bags[k]
                out[k] = special + sum(n * known[c] for c, n in bag.items() if c)
            at = to
        return out


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _counts(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            n = counter.count([t.decode("utf-8") for t in texts])
            columns = [b.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path names a vocabulary file that every executor has at the same place. A null text counts as an empty
    one (no tokens); repeated rows are counted each; an empty table gives no rows. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("t"))
    return slim.mapInArrow(_counts(path, limit), f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
