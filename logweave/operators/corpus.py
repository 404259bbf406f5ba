"""Lineage of a corpus of parsers as DataFrames, and the questions to it as DataFrame operations.

Each parser is analyzed in one task (its statements depend on each other); parsers are independent, so a
corpus is one map stage. The stage writes rows of one shape, (path, dialect, kind, ord, payload), which are
the tables below; every query over them is joins and aggregations that Catalyst plans.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweave.operators.model import PRECEDENCE, LIVE, Diagnostic
from logweave.operators.query import UDM, ParserLineage
from logweave.operators.registry import DIALECTS, MAX_PARSER_BYTES
from logweave.sources.folders import shared_path

SOURCE = "struct<kind:string,source_token:string,path:string,capture_name:string,column:int,pattern:string,expression:string,details:string>"
TAINT = "struct<code:string,message:string,parser_location:string,source_token:string>"
SCHEMAS = {
    "lineage": f"token string, status string, sources array<{SOURCE}>, expression string, transformations array<string>, conditions array<string>, parser_locations array<string>, notes array<string>, taints array<{TAINT}>, value_type string",
    "anchor": "anchor string, conditions array<string>, parser_locations array<string>",
    "io_anchor": "kind string, plugin string, conditions array<string>, parser_locations array<string>, config_summary array<array<string>>",
    "hint": "kind string, source_token string, details string, conditions array<string>, parser_locations array<string>, source_resolved boolean",
    "failure_tag_route": "plugin string, tag string, conditions array<string>, parser_locations array<string>",
    "diagnostic": "code string, kind string, message string, parser_location string, source_token string, strict boolean",
}
RAW = "path string, dialect string, kind string, ord int, payload string"


def analyzed_rows(path: str, code: str, dialect: str, options: dict) -> list[tuple]:
    """The rows of one parser; a parser that cannot be analyzed gives one diagnostic, audit_error."""
    rows: list[tuple] = []

    def put(kind: str, items) -> None:
        rows.extend((path, dialect, kind, k, json.dumps(x, default=str)) for k, x in enumerate(items))

    try:
        p = ParserLineage(code, dialect=dialect, **options)
        state = p.analyze()
        put("lineage", [{"token": t} | r.row() for t in state.tokens() for r in state.get(t)])
        put("anchor", map(asdict, p.anchors()))
        put("io_anchor", map(asdict, state.io_anchors))
        put("hint", [{"kind": h.kind, "source_token": h.source_token, "details": json.dumps(dict(h.details), default=str), "conditions": h.conditions, "parser_locations": h.parser_locations, "source_resolved": h.source_resolved} for h in state.hints])
        put("failure_tag_route", [dict(zip(("plugin", "tag", "conditions", "parser_locations"), r, strict=True)) for r in state.routes])
        put("diagnostic", map(asdict, p.diagnostics))
    except Exception as e:  # the audit goes on with the next parser
        rows = [(path, dialect, "diagnostic", 0, json.dumps(asdict(Diagnostic("audit_error", "unsupported", f"{type(e).__name__}: {e}"[:500]))))]
    return rows


def read_parsers(spark, root: str, pattern: str = "*.cbn", max_bytes: int = MAX_PARSER_BYTES) -> DataFrame:
    """parsers(path, code, problem): every file below root whose name fits, without a byte-order mark. One over
    max_bytes has no code but a problem, which becomes a diagnostic."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    code = F.regexp_replace("value", "^﻿", "")
    fits = F.octet_length("code") <= max_bytes
    read = files.select(F.col("_metadata.file_path").alias("path"), code.alias("code"))
    return read.select("path", F.when(fits, F.col("code")).alias("code"), F.when(~fits, F.format_string("the source has more than %d bytes", F.lit(max_bytes))).alias("problem"))


def analyze_corpus(parsers: DataFrame, dialects: tuple[str, ...] = ("secops",), partitions: int | None = None, **options) -> DataFrame:
    """The raw rows (path, dialect, kind, ord, payload) of parsers(path, code).

    A null source counts as an empty one. Parsers are spread evenly first, as few large files make few
    partitions. Write the result as a table if more than one question is put to it.
    """
    bad = set(dialects) - set(DIALECTS)
    if bad:
        raise ValueError(f"unknown dialects {sorted(bad)}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, code, problem in zip(frame["path"], frame["code"], frame["problem"], strict=True):
                for d in dialects:
                    unread = [(path, d, "diagnostic", 0, json.dumps(asdict(Diagnostic("source_unreadable", "unsupported", problem))))] if problem else None
                    yield pd.DataFrame(unread or analyzed_rows(path, code or "", d, options), columns=["path", "dialect", "kind", "ord", "payload"])

    slim = parsers.select("path", F.coalesce("code", F.lit("")).alias("code"), F.col("problem") if "problem" in parsers.columns else F.lit(None).cast("string").alias("problem"))
    spread = slim.repartition(partitions, "path") if partitions else slim.repartition("path")
    return spread.mapInPandas(run, RAW)


def stored(raw: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, one partition for each kind, so that the parsers are analyzed
    once and a question reads only the tables that it needs."""
    path = shared_path(raw.sparkSession, "corpus")
    raw.write.partitionBy("kind").parquet(path)
    return raw.sparkSession.read.schema(RAW).parquet(path).select("path", "dialect", "kind", "ord", "payload")


def corpus_table(raw: DataFrame, kind: str) -> DataFrame:
    """One of the tables in SCHEMAS, with path, dialect and ord."""
    rows = raw.where(F.col("kind") == kind).select("path", "dialect", "ord", F.from_json("payload", SCHEMAS[kind]).alias("r"))
    return rows.select("path", "dialect", "ord", "r.*")


def status_column(statuses, mappings, repeating):
    """The precedence of a field's status over the set of its rows' statuses."""
    out = F.when(mappings == 0, "unresolved")
    for test, status, result in PRECEDENCE:
        alone = {"has": F.lit(True), "only": F.size(statuses) == 1, "mixed": F.size(statuses) > 1}[test]
        out = out.when(F.array_contains(statuses, status) & alone, result)
    many = F.when(F.array_contains(statuses, "repeated") | repeating, "repeated").otherwise("derived")
    return out.when(mappings > 1, many).otherwise(F.element_at(statuses, 1))


def query_fields(raw: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """For every parser and field: (results, mappings).

    results: path, dialect, udm_field, status, is_conditional, has_dynamic, has_unresolved, has_taints, mappings.
    mappings: path, dialect, udm_field, token, ord and the lineage columns, once for each output anchor above
    the token. A field without mappings is unresolved.
    """
    asked = F.explode(F.array(*[F.lit(f) for f in dict.fromkeys(x.strip() for x in fields)])).alias("udm_field")
    parsers = raw.select("path", "dialect").distinct()
    anchors = corpus_table(raw, "anchor").select("path", "dialect", "anchor", F.col("conditions").alias("anchor_conditions")).distinct()
    roots = parsers.withColumn("root", F.lit("event")).union(anchors.select("path", "dialect", F.col("anchor").alias("root"))).distinct()
    bare = F.regexp_replace("udm_field", r"^event\.", "")
    suffix = F.when(F.startswith(bare, F.concat("root", F.lit("."))), F.substring(bare, F.length("root") + 2, F.length(bare))).otherwise(bare)
    below = F.concat("root", F.lit("."), suffix)
    deep = F.when(~F.startswith(suffix, F.lit("idm.")), F.concat("root", F.lit(f".{UDM}"), suffix))
    plain = F.when(~F.startswith("udm_field", F.lit("idm.")) & ~F.startswith("udm_field", F.lit("event.")), F.concat(F.lit(UDM), "udm_field"))
    named = roots.select("*", asked).withColumn("token", F.explode(F.array_compact(F.array("udm_field", below, deep, plain))))
    named = named.select("path", "dialect", "udm_field", "token").distinct()
    lineage = corpus_table(raw, "lineage")
    fixed = lineage.where(~F.contains("token", F.lit("%{"))).join(named, ["path", "dialect", "token"])
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace("token", r"[.\[\]()*+?^$|\\]", r"\\$0"), r"%\{[^}]*\}", ".+"), F.lit("$"))
    templates = lineage.where(F.contains("token", F.lit("%{"))).withColumn("__pattern", pattern).withColumn("status", F.lit("dynamic"))
    dynamic = templates.join(named.withColumnRenamed("token", "__name"), ["path", "dialect"]).where(F.rlike("__name", F.col("__pattern")))
    dynamic = dynamic.withColumn("notes", F.array_append("notes", F.concat(F.lit("matched dynamic destination "), "token"))).withColumn("token", F.col("__name")).drop("__name", "__pattern")
    found = fixed.unionByName(dynamic)
    parts = F.split("token", r"\.")
    above = found.withColumn("anchor", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))))
    held = above.join(anchors, ["path", "dialect", "anchor"]).groupBy("path", "dialect", "udm_field", "token", "ord").agg(F.collect_set("anchor_conditions").alias("__sets"))
    mapped = found.join(held, ["path", "dialect", "udm_field", "token", "ord"], "left").withColumn("__sets", F.coalesce("__sets", F.array(F.array().cast("array<string>"))))
    mapped = mapped.withColumn("__more", F.explode("__sets")).withColumn("conditions", F.array_union("conditions", F.col("__more")))
    promoted = F.col("status").isin("exact", "exact_capture", "constant", "derived", "repeated") & (F.size("__more") > 0)
    mapped = mapped.withColumn("status", F.when(promoted, "conditional").otherwise(F.col("status"))).drop("__sets", "__more")
    words = F.exists(F.concat("transformations", "parser_locations"), lambda w: w.rlike(r"\b(merge|add_tag|add_field)\b"))
    totals = mapped.groupBy("path", "dialect", "udm_field").agg(
        F.sort_array(F.collect_set("status")).alias("statuses"), F.count(F.lit(1)).alias("mappings"), F.bool_or(F.size("conditions") > 0).alias("is_conditional"),
        F.bool_or(F.col("status") == "dynamic").alias("has_dynamic"), F.bool_or(F.col("status") == "unresolved").alias("has_unresolved"), F.bool_or(F.size("taints") > 0).alias("has_taints"), F.bool_or(words).alias("repeating"),
    )
    joined = parsers.select("*", asked).join(totals, ["path", "dialect", "udm_field"], "left").fillna({"mappings": 0, "is_conditional": False, "has_dynamic": False, "has_taints": False, "has_unresolved": True, "repeating": False})
    results = joined.select("path", "dialect", "udm_field", status_column(F.coalesce("statuses", F.array().cast("array<string>")), F.col("mappings"), F.col("repeating")).alias("status"), "is_conditional", "has_dynamic", "has_unresolved", "has_taints", "mappings")
    return results, mapped


def list_udm_fields(raw: DataFrame) -> DataFrame:
    """(path, dialect, udm_field): UDM tokens, and ``event.`` names for those below other anchors."""
    tokens = corpus_table(raw, "lineage").select("path", "dialect", "token").distinct()
    udm = tokens.where(F.rlike("token", F.lit(r"^(event\d*\.)?idm\.read_only_udm\.")))
    anchors = corpus_table(raw, "anchor").select("path", "dialect", "anchor").where("anchor <> 'event'").distinct()
    rooted = tokens.withColumn("anchor", F.substring_index("token", ".", 1)).join(anchors, ["path", "dialect", "anchor"])
    rooted = rooted.withColumn("rest", F.substring("token", F.length("anchor") + 2, F.length("token"))).where(F.startswith("rest", F.lit(UDM)))
    both = rooted.select("path", "dialect", F.explode(F.array("token", F.concat(F.lit("event."), "rest"))).alias("udm_field"))
    return udm.withColumnRenamed("token", "udm_field").union(both).distinct()


def diagnostic_counts(raw: DataFrame) -> DataFrame:
    """(path, dialect, kind, code, n)."""
    return corpus_table(raw, "diagnostic").groupBy("path", "dialect", "kind", "code").agg(F.count(F.lit(1)).alias("n"))


def compat_counts(raw: DataFrame) -> DataFrame:
    """(path, dialect, status, n): assignments of each status; the report's other counters are diagnostic_counts."""
    return corpus_table(raw, "lineage").groupBy("path", "dialect", "status").agg(F.count(F.lit(1)).alias("n"))


def affected_fields(raw: DataFrame) -> DataFrame:
    """(path, dialect, token, n): UDM tokens with dynamic, unresolved or tainted assignments, most first."""
    weak = corpus_table(raw, "lineage").where(F.rlike("token", F.lit(r"^(event\d*\.)?idm\.read_only_udm\.")) & (~F.col("status").isin(*LIVE) | (F.col("status") == "dynamic") | (F.size("taints") > 0)))
    return weak.groupBy("path", "dialect", "token").agg(F.count(F.lit(1)).alias("n"))


def audit_totals(raw: DataFrame, limit: int = 25) -> DataFrame:
    """(dialect, kind, code, parsers, n): totals over the corpus, the ``limit`` most frequent codes of each dialect and kind."""
    per_parser = diagnostic_counts(raw)
    totals = per_parser.groupBy("dialect", "kind", "code").agg(F.count(F.lit(1)).alias("parsers"), F.sum("n").alias("n"))
    rank = Window.partitionBy("dialect", "kind").orderBy(F.desc("n"), "code")
    return totals.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= limit).drop("__rank")


def regressions(now: DataFrame, baseline: DataFrame) -> DataFrame:
    """Codes that are more frequent than in a baseline of the same shape (dialect, kind, code, n)."""
    old = baseline.select("dialect", "kind", "code", F.col("n").alias("was"))
    both = now.select("dialect", "kind", "code", "n").join(old, ["dialect", "kind", "code"], "full_outer").fillna(0, ["n", "was"])
    return both.where("n > was")


def uncovered(observed: DataFrame, raw: DataFrame) -> DataFrame:
    """Observed (path, dialect, token) that no live assignment explains: what a sound analysis has none of."""
    live = corpus_table(raw, "lineage").where(F.col("status").isin(*LIVE)).select("path", "dialect", "token").distinct()
    return observed.join(live, ["path", "dialect", "token"], "left_anti")

