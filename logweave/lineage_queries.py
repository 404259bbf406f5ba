"""Registered queries over the lineage of a corpus of parsers, one for each row of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.operators import corpus
from logweave.plans.runtime import run_parser
from logweave.queries import _event_line, table
from logweave.sources.events import file_stream
from logweave.streaming.stateful import drain, elapsed_stream, run_parser_stream, throttle_stream

COUNTRY = "event.idm.read_only_udm.principal.location.country"


def nation_parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parsers(path, code): a parser for each nation; those of region 0 use an unknown plugin, those of region 1 drop."""
    name = F.col("n_name")
    tail = F.when(F.col("n_regionkey") == 0, "  mystery { target => \"extra\" }\n").when(F.col("n_regionkey") == 1, "  if [kind] == \"noise\" { drop { } }\n").otherwise("")
    code = F.concat(
        F.lit('filter {\n  kv { source => "message" }\n  if [nation] == "'), name, F.lit(f'" {{\n    mutate {{ replace => {{ "{COUNTRY}" => "'), name,
        F.lit(f'" }} }}\n  }} else {{\n    mutate {{ replace => {{ "{COUNTRY}" => "%{{nation}}" }} uppercase => ["{COUNTRY}"] }}\n  }}\n'),
        F.lit('  grok { match => { "message" => "ip=%{IP:addr}" } }\n  mutate { rename => { "addr" => "event.idm.read_only_udm.principal.ip" } }\n'), tail,
        F.lit('  mutate { merge => { "@output" => "event" } }\n}\n'),
    )
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), code.alias("code"))


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.stored(corpus.analyze_corpus(nation_parsers(spark, sf_dir)))


def lineage_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    results, _ = corpus.query_fields(_raw(spark, sf_dir), ["principal.location.country", "principal.ip", "target.ip", "extra"])
    return results.drop("dialect")


def lineage_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mapped = corpus.query_fields(_raw(spark, sf_dir), ["principal.location.country"])
    return mapped.select("path", "status", "expression", F.array_join("conditions", " & ").alias("conditions"), F.array_join("transformations", ",").alias("transformations"), F.array_join(F.col("sources.kind"), ",").alias("kinds"))


def lineage_list_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.list_udm_fields(_raw(spark, sf_dir)).drop("dialect")


def lineage_compat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.compat_counts(_raw(spark, sf_dir)).drop("dialect")


def lineage_audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.audit_totals(corpus.analyze_corpus(nation_parsers(spark, sf_dir), ("secops", "logstash")))


def lineage_affected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.affected_fields(corpus.analyze_corpus(nation_parsers(spark, sf_dir).withColumn("code", F.replace(F.replace("code", F.lit("%{IP:addr}"), F.lit("none")), F.lit("kv {"), F.lit("csv {"))))).drop("dialect")


def lineage_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.corpus_table(_raw(spark, sf_dir), "anchor").select("path", "anchor", F.array_join("conditions", " & ").alias("conditions"))


def lineage_failure_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = corpus.analyze_corpus(nation_parsers(spark, sf_dir), ("logstash",))
    return corpus.corpus_table(raw, "failure_tag_route").select("path", "plugin", "tag", F.array_join("conditions", " & ").alias("conditions"))


def lineage_regressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = corpus.audit_totals(_raw(spark, sf_dir))
    old = corpus.audit_totals(corpus.analyze_corpus(nation_parsers(spark, sf_dir).where("path < 'NATION_2'")))
    return corpus.regressions(now, old).drop("dialect")


def lineage_soundness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that a run over the events fills, for how many events, and whether the analysis knows each."""
    code = 'filter { kv { } if [action] == "click" { mutate { replace => { "a.b" => "%{user}" } } } grok { match => { "message" => "id=%{INT:n}" } } mutate { copy => { "n" => "m" } add_tag => ["t"] } }'
    events = table(spark, sf_dir, "events").select(_event_line().alias("message"))
    run = run_parser(code, events)
    written = [c for c in run.columns if c != "message"]
    counts = run.agg(F.create_map(*[x for c in written for x in (F.lit(c), F.count(F.col(f"`{c}`")))]).alias("n")).select(F.explode("n").alias("token", "events"))
    observed = counts.where("events > 0").select(F.lit("p").alias("path"), F.lit("secops").alias("dialect"), "token", "events")
    raw = corpus.analyze_corpus(spark.range(1).select(F.lit("p").alias("path"), F.lit(code).alias("code")))
    unknown = corpus.uncovered(observed, raw).select("token", F.lit(True).alias("unknown"))
    return observed.join(unknown, "token", "left").select("token", "events", F.col("unknown").isNull().alias("known"))


#: A branch below an equality, by what the equality's value decides: a regex, its negation, and a list.
DECIDED = {"target.ip": '[n] =~ /^NATION_1[0-9]?$/', "target.hostname": '[n] !~ /^NATION_1[0-9]?$/', "target.url": '[n] in ["NATION_3", "NATION_14", "NATION_2"]', "target.port": '[n] == "NATION_5" and [n] =~ /5$/'}


def lineage_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields set in branches that contradict the condition above them, or do not."""
    inner = "".join(f'  if {c} {{ mutate {{ replace => {{ "{f}" => "1" }} }} }}\n' for f, c in DECIDED.items())
    code = F.concat(F.lit('filter {\n if [n] == "'), F.col("n_name"), F.lit('" {\n' + inner + " }\n}\n"))
    raw = corpus.stored(corpus.analyze_corpus(table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"), code.alias("code"))))
    return corpus.query_fields(raw, list(DECIDED))[0].select("path", "udm_field", "status")


def stream_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = file_stream(spark, sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(throttle_stream(events, "user_id", "ts", "event_id", 3), "stream-throttle")
    return out.select(F.col("tie").alias("event_id"), "throttled")


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A compiled parser on a stream of the events."""
    schema = table(spark, sf_dir, "events").schema
    lines = file_stream(spark, sf_dir, schema, "events.parquet").select("event_id", _event_line().alias("message"))
    code = 'filter { kv { } if [action] == "view" { drop { } } translate { field => "action" destination => "verb" dictionary => { "click" => "CLICK" } fallback => "REST" } }'
    return drain(run_parser_stream(code, lines, fields=["user", "verb"]).drop("message"), "stream-route")


def stream_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    events = file_stream(spark, sf_dir, schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drain(elapsed_stream(events, "user_id", "ts", "event_id"), "stream-elapsed")
    return out.select(F.col("tie").alias("event_id"), "seconds")


_C = f"'{COUNTRY}'"
QUERIES = {f.__name__: f for f in (lineage_query, lineage_mappings, lineage_list_fields, lineage_compat_counts, lineage_audit_totals, lineage_affected_fields, lineage_anchors, lineage_failure_routes, lineage_regressions, lineage_soundness, lineage_contradictions, stream_route, stream_elapsed, stream_throttle)}
SQL = {
    "lineage_query": """SELECT n_name AS path, udm_field, CASE WHEN n_regionkey = 1 AND mappings > 0 THEN 'conditional' ELSE status END AS status, is_conditional OR (n_regionkey = 1 AND mappings > 0) AS is_conditional, has_dynamic, has_unresolved, has_taints, mappings FROM nation, (VALUES
        ('principal.location.country', 'conditional', true, false, false, false, CAST(2 AS BIGINT)), ('principal.ip', 'derived', false, false, false, false, 1), ('target.ip', 'unresolved', false, false, true, false, 0)) AS f(udm_field, status, is_conditional, has_dynamic, has_unresolved, has_taints, mappings)
        UNION ALL SELECT n_name, 'extra', 'unresolved', false, false, true, n_regionkey = 0, CASE WHEN n_regionkey = 0 THEN 1 ELSE 0 END FROM nation""",
    "lineage_mappings": """SELECT n_name AS path, 'conditional' AS status, n_name AS expression, '[nation] == "' || n_name || '"' || CASE WHEN n_regionkey = 1 THEN ' & NOT(drop path: [kind] == "noise")' ELSE '' END AS conditions, '' AS transformations, 'constant' AS kinds FROM nation
        UNION ALL SELECT n_name, 'conditional', 'nation', 'NOT([nation] == "' || n_name || '")' || CASE WHEN n_regionkey = 1 THEN ' & NOT(drop path: [kind] == "noise")' ELSE '' END, 'uppercase', 'kv_key' FROM nation""",
    "lineage_list_fields": f"SELECT n_name AS path, f.udm_field FROM nation, (VALUES ({_C}), ('event.idm.read_only_udm.principal.ip')) AS f(udm_field)",
    "lineage_compat_counts": """SELECT n_name AS path, status, CAST(n AS BIGINT) AS n FROM nation, (VALUES ('exact', 1), ('derived', 1), ('conditional', 2)) AS s(status, n) UNION ALL SELECT n_name, 'unresolved', 1 FROM nation WHERE n_regionkey = 0""",
    "lineage_audit_totals": """SELECT d.dialect, k.kind, k.code, count(*) AS parsers, count(*) AS n FROM nation, (VALUES ('secops'), ('logstash')) AS d(dialect), (VALUES (0, 'taint', 'unsupported_plugin'), (0, 'unsupported', 'unsupported_plugin'), (1, 'warning', 'drop')) AS k(region, kind, code) WHERE n_regionkey = k.region GROUP BY ALL""",
    "lineage_affected_fields": f"SELECT n_name AS path, f.token, CAST(1 AS BIGINT) AS n FROM nation, (VALUES ({_C}), ('event.idm.read_only_udm.principal.ip')) AS f(token)",
    "lineage_anchors": "SELECT n_name AS path, 'event' AS anchor, CASE WHEN n_regionkey = 1 THEN 'NOT(drop path: [kind] == \"noise\")' ELSE '' END AS conditions FROM nation",
    "lineage_failure_routes": "SELECT n_name AS path, t.plugin, t.tag, t.plugin || ' failure' AS conditions FROM nation, (VALUES ('kv', '_kvparsefailure'), ('grok', '_grokparsefailure'), ('grok', '_groktimeout')) AS t(plugin, tag)",
    "lineage_regressions": "SELECT k.kind, k.code, count(*) AS n, count(*) FILTER (WHERE n_name < 'NATION_2') AS was FROM nation, (VALUES (0, 'taint', 'unsupported_plugin'), (0, 'unsupported', 'unsupported_plugin'), (1, 'warning', 'drop')) AS k(region, kind, code) WHERE n_regionkey = k.region GROUP BY ALL HAVING count(*) > count(*) FILTER (WHERE n_name < 'NATION_2')",
    "lineage_soundness": "SELECT token, events, true AS known FROM (SELECT 'a.b' AS token, count(*) FILTER (WHERE event_type = 'click') AS events FROM events UNION ALL SELECT t.token, count(*) FROM events, (VALUES ('n'), ('m'), ('tags')) AS t(token) GROUP BY 1) WHERE events > 0",
    "stream_route": "SELECT event_id, CAST(user_id AS VARCHAR) AS \"user\", CASE WHEN event_type = 'click' THEN 'CLICK' ELSE 'REST' END AS verb FROM events WHERE event_type <> 'view'",
    "stream_elapsed": "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS seconds FROM events",
    "lineage_contradictions": """SELECT n_name AS path, f.udm_field, CASE WHEN f.holds THEN 'conditional' ELSE 'unresolved' END AS status FROM nation, LATERAL (VALUES ('target.ip', regexp_matches(n_name, '^NATION_1[0-9]?$')), ('target.hostname', NOT regexp_matches(n_name, '^NATION_1[0-9]?$')),
        ('target.url', n_name IN ('NATION_3', 'NATION_14', 'NATION_2')), ('target.port', n_name = 'NATION_5')) AS f(udm_field, holds)""",
    "stream_throttle": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3 AS throttled FROM events",
}
