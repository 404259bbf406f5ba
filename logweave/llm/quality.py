"""Quality rules by tokeniser fertility.

Public vocabularies cut clean text of a language into pieces of a typical length and variety. Shouted, symbol-ridden,
listed or repeated text comes out differently: fewer characters a token, byte fallback, a token distribution of low
entropy. Documents are measured word by word under two vocabularies, a sentencepiece one with byte fallback and a
byte-level one, and held against bands for their language, or for their script where the language has none.

Entropy grows with a text's length, so a language's band follows the logarithm of the number of tokens; and all
measures scatter more in short texts, so bands are wider there. The three distances from a language's centre, in
units of its spread, are added up; a document that falls too far below is rejected.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import log2, sqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.frames import SLICE, filter_rows, utf8

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Words whose pieces a worker remembers; it starts anew when there are more.
REMEMBERED = 150_000
#: How the byte-level vocabulary parts a word: letters, digits in threes, the rest.
WORD_PARTS = r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]+"
_SYMBOLS = (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")


#: Tokens at which the scatter of a measure has about doubled in variance, and the sum of distances that rejects.
SHORT, LIMIT = 200, -9.0
#: Labelled rows that a fit takes at most.
FIT_ROWS = 20_000


@dataclass(frozen=True)
class Band:
    """A script's: what is accepted, wide enough for any running text."""

    chars_low: float
    chars_high: float
    fallback_high: float
    entropy_low: float

    def rejects(self, m: Measures) -> bool:
        return not self.chars_low <= m.chars <= self.chars_high or m.fallback > self.fallback_high or m.entropy < self.entropy_low


@dataclass(frozen=True)
class Language:
    """Centre and spread of characters per token under either vocabulary, and the line that entropy follows (at one
    token, and for each doubling) with its spread."""

    chars: tuple[float, float]
    other: tuple[float, float]
    entropy: tuple[float, float, float]
    chars_high: float = 4.8
    fallback_high: float = 0.05

    def distance(self, m: Measures) -> float:
        if not m.tokens:
            return float("-inf")
        line = self.entropy[0] + self.entropy[1] * log2(m.tokens)
        total = (m.chars - self.chars[0]) / self.chars[1] + (m.other - self.other[0]) / self.other[1] + (m.entropy - line) / self.entropy[2]
        return total / sqrt(1 + SHORT / m.tokens)

    def rejects(self, m: Measures) -> bool:
        return m.chars > self.chars_high or m.other > self.chars_high or m.fallback > self.fallback_high or self.distance(m) < LIMIT


class Measures(NamedTuple):
    """Tokens, characters per token and share of byte fallback under the first vocabulary, characters per token under
    the second, and entropy in bits under the first."""

    tokens: int
    chars: float
    fallback: float
    other: float
    entropy: float


def fit_language(good: list[Measures]) -> Language:
    """The band of a language from measures of documents that are labelled good, FIT_ROWS at most: medians, half the
    distance between the 16th and 84th percentiles, and a least-squares line for entropy."""
    rows = np.array(good[:FIT_ROWS], dtype=np.float64)

    def centre(values: np.ndarray) -> tuple[float, float]:
        low, middle, high = np.quantile(values, [0.16, 0.5, 0.84])
        return round(float(middle), 3), round(float(high - low) / 2, 3)

    step, start = np.polyfit(np.log2(rows[:, 0]), rows[:, 4], 1)
    middle, spread = centre(rows[:, 4] - start - step * np.log2(rows[:, 0]))
    return Language(centre(rows[:, 1]), centre(rows[:, 3]), (round(float(start + middle), 3), round(float(step), 3), spread))


#: What fit_language gives for the good documents with even ids of the labelled sample at sf0.1 that pass the base rules.
LANGUAGES = {
    "en": Language((2.219, 0.035), (2.294, 0.037), (4.664, 0.205, 0.099)),
    "de": Language((2.245, 0.037), (2.315, 0.036), (4.917, 0.162, 0.089)),
    "es": Language((1.942, 0.032), (2.223, 0.046), (4.832, 0.175, 0.101)),
    "fr": Language((1.978, 0.033), (2.072, 0.034), (5.016, 0.146, 0.084)),
}
#: Per script for every other language: only what no running text shows.
SCRIPTS = {
    "latin": Band(1.1, 6.0, 0.15, 4.0),
    "cyrillic": Band(0.9, 5.0, 0.15, 4.0),
    "greek": Band(0.5, 4.0, 0.40, 4.0),
    "cjk": Band(0.3, 3.0, 0.85, 4.0),
    "other": Band(0.2, 5.0, 1.00, 3.5),
}
_SCRIPT_RANGES = (("latin", re.compile("[A-Za-zÀ-ɏḀ-ỿ]")), ("cyrillic", re.compile("[Ѐ-ԯ]")), ("greek", re.compile("[Ͱ-Ͽ]")), ("cjk", re.compile("[぀-ヿ㐀-鿿가-힯]")))


def script_of(text: str) -> str:
    """The script of most letters; other if none of the known ones has a tenth of the characters."""
    counts = {name: sum(1 for _ in pattern.finditer(text)) for name, pattern in _SCRIPT_RANGES}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] * 10 > len(text) else "other"


class Fertility:
    """Pieces of words under a sentencepiece vocabulary and their number under a byte-level one, remembered between texts."""

    def __init__(self, pieces: str, ranks: str) -> None:
        import sentencepiece
        import tiktoken

        self.model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        with open(ranks, "rb") as f:
            held = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.other = tiktoken.Encoding("ranks", pat_str=WORD_PARTS, mergeable_ranks=held, special_tokens={})
        #: Of each word, as four-byte numbers: its tokens under the second vocabulary, then its pieces under the first.
        self.known: dict[bytes, bytes] = {}

    def measure(self, bag: Counter, chars: int) -> Measures:
        new = [w for w in bag if w not in self.known]
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known.clear()
                new = list(bag)
            texts = [w.decode("utf-8") for w in new]
            ids = self.model.encode(texts, num_threads=1)
            self.known.update((w, np.array([len(self.other.encode_ordinary(t)), *i], dtype=np.int32).tobytes()) for w, t, i in zip(new, texts, ids, strict=True))
        if not bag:
            return Measures(0, 0.0, 0.0, 0.0, 0.0)
        held = [self.known[w] for w in bag]
        times, sizes = np.fromiter(bag.values(), np.int64, len(bag)), np.fromiter(map(len, held), np.int64, len(held)) // 4
        every = np.frombuffer(b"".join(held), np.int32)
        first = np.cumsum(sizes) - sizes
        others = int((every[first] * times).sum())
        weights = np.repeat(times, sizes)
        weights[first] = 0
        fallback = float(weights[self.is_byte[np.where(weights > 0, every, 0)]].sum())
        counts = np.bincount(every, weights=weights, minlength=1)
        total = int(weights.sum())
        if not total:
            return Measures(0, 0.0, 0.0, 0.0, 0.0)
        shares = counts[counts > 0] / total
        return Measures(total, chars / total, fallback / total, chars / others if others else 0.0, float(-(shares * np.log2(shares)).sum()))


@lru_cache(maxsize=2)
def _fertility(pieces: str, ranks: str) -> Fertility:
    return Fertility(pieces, ranks)


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words, their characters, symbols, repeated lines, and words in three-word windows found twice."""
    words = text.split()  # bytes.split() parts at ASCII white space alone
    inner = b"".join(words)
    chars = len(inner) if inner.isascii() else len(inner.decode("utf-8"))
    symbols = sum(text.count(s) for s in _SYMBOLS)
    seen: set[bytes] = set()
    duplicates = 0
    for line in text.split(b"\n"):
        if line in seen:
            duplicates += 1
        elif line and not line.isspace():
            seen.add(line)
    return words, chars, symbols, duplicates, repeated_words(words)


def repeated_words(words: list[bytes], n: int = 3) -> int:
    if len(words) < n:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    size = len(number)
    if size < 2_000_000:  # size ** 3 fits a long
        key = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        key = np.unique((ids[:-2] * size + ids[1:-1]), return_inverse=True)[1] * size + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(n):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


_OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, other_chars_per_token double, token_entropy double, base_failed boolean, kept boolean"


def judge(model: Fertility, text: bytes, lang: str | None, languages: dict[str, Language], scripts: dict[str, Band]) -> tuple:
    """The columns of _OUT for one text."""
    words, chars, symbols, duplicates, repeated = base_counts(text)
    m = model.measure(Counter(words), chars)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    band = languages.get(lang) if lang is not None else None
    if band is None and not failed:
        band = scripts[script_of(text.decode("utf-8"))]
    return len(words), chars, symbols, duplicates, repeated, *m, failed, not failed and not band.rejects(m)


def _scores(paths: tuple[str, str], languages: dict[str, Language], scripts: dict[str, Band]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _fertility(*paths)
        for b in batches:
            rows = []
            for k in range(0, b.num_rows, SLICE):
                part = b.slice(k, SLICE)
                rows += [judge(model, text, lang, languages, scripts) for text, lang in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            names = [c.split()[0] for c in _OUT.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.float64()] * 4 + [pa.bool_()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", *names])

    return run


def score_quality(docs: DataFrame, paths: tuple[str, str], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: dict[str, Language] | None = None, scripts: dict[str, Band] | None = None) -> DataFrame:
    """One row for each row of docs: its counts, its fertility measures, base_failed and kept.

    paths name a sentencepiece file and one of byte-level ranks, which every executor has at the same places. A null text has no words and
    fails; a null or unknown language is judged by the bands of the text's script; repeated rows are scored
    each; an empty table gives no rows. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    run = _scores(tuple(paths), languages or LANGUAGES, scripts or SCRIPTS)
    return slim.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, {_OUT}")


def keep_good(docs: DataFrame, paths: tuple[str, str], text_col: str = "text", lang_col: str = "lang", languages: dict[str, Language] | None = None, scripts: dict[str, Band] | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all columns. Each row is judged where it is, by its text and language."""
    held = languages or LANGUAGES, scripts or SCRIPTS

    def start():
        model = _fertility(*paths)
        return lambda rows: [judge(model, text or b"", None if lang is None else lang.decode("utf-8"), *held)[-1] for text, lang in rows]

    return filter_rows(docs, [text_col, lang_col], start)
