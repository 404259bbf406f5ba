"""Licence scans by ordered signature rules [DataFrame functions only].

A text is reduced to its words, lower-cased and parted by single spaces. Documents with none of a few stems
are done. For the others, each rule whose keyword occurs runs its pattern, and every match is an interval
of words. Intervals are sorted, and one that lies inside an interval of the same or a better priority is
suppressed; the labels of the rest are the document's. All of it is one projection: no shuffle, no row
leaves its task, and hot documents cost only themselves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.license_rules import STEMS, Rule, rules

#: Phrases that are always counted, and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
PRIORITIES = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def word_line(text: Column) -> Column:
    """The words with a space before each and one at the end; a single space if there is none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(F.concat(F.lit(" "), lowered, F.lit(" ")), _GAP, " ")


def _literal(own: list[Rule]) -> Column:
    quoted = lambda s: "r'" + s + "'"
    row = lambda r: f"named_struct('label', {quoted(r.label)}, 'priority', {r.priority}, 'score', {r.score}D, 'keyword', {quoted(r.keyword)}, 'also', {quoted(r.also)}, 'pattern', {quoted('(?<= )(?:' + r.pattern + ')(?= )')})"
    return F.expr("array(" + ", ".join(map(row, own)) + ")")


def _matches(line: Column, rule: Column) -> Column:
    """Intervals (first word, minus end, priority, label, score) of a rule's matches, in order."""
    parts, found = F.split(line, rule["pattern"]), F.regexp_extract_all(line, rule["pattern"], F.lit(0))
    steps = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(spaces(p).alias("gap"), (spaces(m) + 1).alias("words")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,till:int,priority:int,label:string,score:double>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        first = acc["at"] + s["gap"] - 1
        own = F.struct(first.cast("int").alias("first"), (-(first + s["words"])).cast("int").alias("till"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["score"].alias("score"))
        return F.struct((first + s["words"]).cast("int").alias("at"), F.array_append(acc["out"], own).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _survivors(intervals: Column) -> Column:
    """One struct (label, first, end, score) for each label that has an interval no other suppresses.

    Sorted by start and falling end, an interval lies inside an earlier one exactly if that one ends no
    sooner; so the furthest end seen so far, for each priority, is all that is needed.
    """
    tiers = range(1, PRIORITIES + 1)
    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in tiers], F.array().cast("array<struct<label:string,first:int,end:int,score:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["till"]
        reach = reduce(lambda a, p: F.when((x["priority"] >= p) & (acc[f"e{p}"] > a), acc[f"e{p}"]).otherwise(a), tiers, F.lit(-1))
        new = (end > reach) & ~F.exists(acc["out"], lambda o: o["label"] == x["label"])
        own = F.struct(x["label"].alias("label"), x["first"].alias("first"), end.alias("end"), x["score"].alias("score"))
        return F.struct(
            *[F.when((x["priority"] == p) & (end > acc[f"e{p}"]), end).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in tiers],
            F.when(new, F.array_append(acc["out"], own)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(F.array_sort(intervals), start, step, lambda acc: acc["out"])


def _base(line: Column, n_words: Column) -> list[Column]:
    """For each base phrase: count, first and last start."""
    out = []
    for phrase, label in BASE:
        parts = F.split(line, rf"(?<= ){phrase}(?= )")
        size = len(phrase.split())
        found = F.size(parts) - 1
        last = n_words - (spaces(F.element_at(parts, -1)) - 1) - size
        out.append(F.struct(found.alias("n"), F.when(found > 0, spaces(F.element_at(parts, 1)) - 1).alias("first"), F.when(found > 0, last).alias("last"), F.lit(label).alias("label")))
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", own: list[Rule] | None = None) -> DataFrame:
    """One row for each row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score
    and detections (label, first and end word, score), one for each label that a rule found.

    labels joins those of the base phrases and of the surviving detections. score is the greatest confidence
    among the detections, 0.5 for a base phrase alone, else 0. A null text counts as an empty one and has
    no words; repeated rows are scanned each; an empty table gives no rows. Other columns are not read.
    """
    table = _literal(own or rules())
    line = F.col("__line")
    rows = docs.select(F.col(id_col).alias("doc_id"), word_line(F.col(text_col)).alias("__line")).withColumn("n_words", spaces(line) - 1)
    none = F.array().cast("array<struct<n:int,first:int,last:int,label:string>>")
    rows = rows.withColumn("__base", F.when(F.contains(line, F.lit(" license ")), F.filter(F.array(*_base(line, F.col("n_words"))), lambda b: b["n"] > 0)).otherwise(none))
    gate = reduce(lambda a, b: a | b, [F.contains(line, F.lit(s)) for s in STEMS])
    tried = F.filter(table, lambda r: F.contains(line, r["keyword"]) & F.contains(line, r["also"]) & F.rlike(line, r["pattern"]))
    found = _survivors(F.flatten(F.transform(tried, lambda r: _matches(line, r))))
    rows = rows.withColumn("detections", F.when(gate, found).otherwise(F.array().cast("array<struct<label:string,first:int,end:int,score:double>>")))
    base, own_labels = F.col("__base"), F.col("detections.label")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    confident = F.coalesce(F.array_max(F.col("detections.score")), F.lit(0.0))
    return rows.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.aggregate(base, F.lit(0), lambda a, b: a + b["n"]).cast("long").alias("n_base"),
        F.array_min(F.col("__base.first")).cast("long").alias("first_word"), F.array_max(F.col("__base.last")).cast("long").alias("last_word"),
        joined(F.col("__base.label")).alias("base_labels"), joined(F.concat(F.col("__base.label"), own_labels)).alias("labels"),
        F.greatest(confident, F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))).alias("score"), "detections",
    )
