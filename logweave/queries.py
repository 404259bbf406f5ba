"""The registered queries: each runs a parser over log lines made from a table, with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans.runtime import Runtime, run_parser

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Case:
    """events: the frame with a message; code: the parser; fields: columns kept from events and read from the parser."""

    events: Callable[[SparkSession, str], DataFrame]
    code: str
    keep: tuple[str, ...]
    fields: dict[str, str]
    sql: str
    runtime: Callable[[SparkSession, str], Runtime] = lambda spark, d: Runtime()
    casts: dict[str, str] | None = None
    then: Callable[[DataFrame], DataFrame] | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run_parser(self.code, self.events(spark, sf_dir), self.runtime(spark, sf_dir), list(self.fields))
        columns = [F.col(f"`{f}`").cast(self.casts[f]).alias(a) if self.casts and f in self.casts else F.col(f"`{f}`").alias(a) for f, a in self.fields.items()]
        out = out.select(*self.keep, *columns)
        return self.then(out) if self.then else out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def made(name: str, message: Column | Callable[[], Column], *keep: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: table(spark, d, name).select(*keep, (message() if callable(message) else message).alias("message"))


def _event_line() -> Column:
    return F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit(" action="), F.col("event_type"), F.lit(" id="), F.col("event_id").cast("string"))


EVENT_LINES = made("events", _event_line, "event_id")
ROUTING = """
filter {
  kv { source => "message" field_split => " " value_split => "=" }
  if [action] == "purchase" {
    mutate { replace => { "event.idm.read_only_udm.security_result.action" => "ALLOW" } }
  } else if [action] == "error" or [action] == "signup" {
    mutate { replace => { "event.idm.read_only_udm.security_result.action" => "BLOCK" } }
  } else {
    mutate { replace => { "event.idm.read_only_udm.security_result.action" => "UNKNOWN_ACTION" } }
  }
  mutate { merge => { "@output" => "event" } }
}
"""
ACTION = "event.idm.read_only_udm.security_result.action"
ROUTED = "CASE WHEN event_type = 'purchase' THEN 'ALLOW' WHEN event_type IN ('error', 'signup') THEN 'BLOCK' ELSE 'UNKNOWN_ACTION' END"


def _json_events() -> Column:
    return F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","user":{"id":'), F.col("user_id").cast("string"), F.lit('},"props":'), F.col("props"), F.lit("}"))


CASES: dict[str, Case] = {
    "kv_extract": Case(EVENT_LINES, 'filter { kv { source => "message" } mutate { replace => { "who" => "%{user}" } } }', ("event_id",), {"who": "who"}, "SELECT event_id, CAST(user_id AS VARCHAR) AS who FROM events"),
    "kv_include_trim": Case(
        made("part", lambda: F.concat(F.lit('name="'), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit('";brand=<'), F.col("p_brand"), F.lit(">;size="), F.col("p_size").cast("string")), "p_partkey"),
        'filter { kv { source => "message" field_split => ";" value_split => "=" trim_value => "\\"<>" include_keys => ["name", "brand"] } }',
        ("p_partkey",), {"name": "name", "brand": "brand", "size": "size"},
        "SELECT p_partkey, replace(p_name, ' ', '_') AS name, p_brand AS brand, CAST(NULL AS VARCHAR) AS size FROM part",
    ),
    "json_extract": Case(made("events", _json_events, "event_id"), 'filter { json { source => "message" } mutate { convert => { "props.k" => "integer" } } }', ("event_id",), {"type": "type", "user.id": "user_id", "props.k": "k"}, "SELECT event_id, event_type AS type, CAST(user_id AS VARCHAR) AS user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "json_target": Case(made("events", lambda: F.col("props"), "event_id"), 'filter { json { source => "message" target => "doc" } mutate { replace => { "k" => "k=%{doc.k}" } } }', ("event_id",), {"k": "k"}, "SELECT event_id, 'k=' || json_extract_string(props, '$.k') AS k FROM events"),
    "csv_columns": Case(
        made("orders", lambda: F.concat(F.col("o_orderkey").cast("string"), F.lit(',"'), F.col("o_orderpriority"), F.lit(', x",'), F.col("o_orderstatus")), "o_orderkey"),
        'filter { csv { source => "message" separator => "," columns => ["key", "priority", "status"] } }',
        (), {"key": "key", "priority": "priority", "column3": "status"},
        "SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderpriority || ', x' AS priority, o_orderstatus AS status FROM orders",
    ),
    "grok_capture": Case(EVENT_LINES, 'filter { grok { match => { "message" => "user=%{INT:who:int} action=%{WORD:act}" } } }', ("event_id",), {"who": "who", "act": "act"}, "SELECT event_id, user_id AS who, event_type AS act FROM events"),
    "grok_alternatives": Case(EVENT_LINES, 'filter { grok { match => { "message" => ["action=click id=%{INT:clicked}", "action=%{WORD:other} id=%{INT}"] } on_error => "bad" } }', ("event_id",), {"clicked": "clicked", "other": "other", "bad": "bad"}, "SELECT event_id, CASE WHEN event_type = 'click' THEN CAST(event_id AS VARCHAR) END AS clicked, CASE WHEN event_type <> 'click' THEN event_type END AS other, 'false' AS bad FROM events"),
    "grok_definitions": Case(EVENT_LINES, 'filter { grok { pattern_definitions => { "ACT" => "click|view" } match => { "message" => "action=%{ACT:seen} " } tag_on_failure => ["unseen"] } }', ("event_id",), {"seen": "seen", "tags": "tags"}, "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type END AS seen, CASE WHEN event_type IN ('click', 'view') THEN '' ELSE 'unseen' END AS tags FROM events", then=lambda df: df.withColumn("tags", F.array_join("tags", ","))),
    "dissect_fields": Case(
        made("orders", lambda: F.concat_ws(" ", F.lit("["), F.col("o_orderpriority"), F.lit("]"), F.col("o_orderkey").cast("string"), F.col("o_orderstatus")), "o_orderkey"),
        'filter { dissect { mapping => { "message" => "[ %{priority} ] %{key} %{+key} %{?skip}" } } }'.replace(" %{+key} %{?skip}", " %{status}"),
        (), {"priority": "priority", "key": "key", "status": "status"},
        "SELECT o_orderpriority AS priority, CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status FROM orders",
    ),
    "dissect_append": Case(made("customer", lambda: F.concat_ws("|", "c_name", "c_mktsegment", F.col("c_custkey").cast("string"))), 'filter { dissect { mapping => { "message" => "%{who}|%{?segment}|%{+who}" } append_separator => "/" } }', (), {"who": "who"}, "SELECT c_name || '/' || CAST(c_custkey AS VARCHAR) AS who FROM customer"),
    "xml_xpath": Case(made("part", lambda: F.concat(F.lit("<p><n>"), F.col("p_name"), F.lit("</n><b>"), F.col("p_brand"), F.lit("</b></p>")), "p_partkey"), 'filter { xml { source => "message" xpath => { "/p/n" => "name" "/p/b" => "brand" } } }', ("p_partkey",), {"name": "name", "brand": "brand"}, "SELECT p_partkey, p_name AS name, p_brand AS brand FROM part"),
    "date_parse": Case(made("orders", lambda: F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"), "o_orderkey"), 'filter { date { match => ["message", "ISO8601", "dd/MM/yyyy HH:mm:ss"] target => "at" } }', ("o_orderkey",), {"at": "at"}, "SELECT o_orderkey, date_trunc('second', o_orderdate) AS at FROM orders", casts={"at": "timestamp_ntz"}),
    "date_unix": Case(made("events", lambda: F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"), "event_id"), 'filter { date { match => ["message", "UNIX"] target => "at" } }', ("event_id",), {"at": "at"}, "SELECT event_id, date_trunc('second', ts) AS at FROM events", casts={"at": "timestamp_ntz"}),
    "mutate_case": Case(made("part", lambda: F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")), "p_partkey"), 'filter { mutate { copy => { "message" => "up" } } mutate { uppercase => ["up"] strip => ["message", "up"] lowercase => ["message"] } }', ("p_partkey",), {"up": "up", "message": "low"}, "SELECT p_partkey, upper(trim(p_name)) AS up, lower(trim(p_name)) AS low FROM part"),
    "mutate_gsub": Case(made("part", lambda: F.col("p_type"), "p_partkey"), r'filter { mutate { gsub => ["message", "([A-Z]+) ([A-Z]+)", "\2-\1", "message", "[aeiou]", "_"] } }', ("p_partkey",), {"message": "t"}, r"SELECT p_partkey, regexp_replace(regexp_replace(p_type, '([A-Z]+) ([A-Z]+)', '\2-\1', 'g'), '[aeiou]', '_', 'g') AS t FROM part"),
    "mutate_split_join": Case(made("part", lambda: F.col("p_name"), "p_partkey"), 'filter { mutate { split => { "message" => " " } } mutate { join => { "message" => "+" } } }', ("p_partkey",), {"message": "t"}, "SELECT p_partkey, replace(p_name, ' ', '+') AS t FROM part"),
    "mutate_convert": Case(made("lineitem", lambda: F.concat_ws(",", F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string"), F.lit("yes")), "l_orderkey", "l_linenumber"), 'filter { csv { columns => ["qty", "n", "flag"] } mutate { convert => { "qty" => "integer" "n" => "float" "flag" => "boolean" } } }', ("l_orderkey", "l_linenumber"), {"qty": "qty", "n": "n", "flag": "flag"}, "SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS BIGINT) AS qty, CAST(l_linenumber AS DOUBLE) AS n, true AS flag FROM lineitem"),
    "mutate_rename_copy_remove": Case(made("customer", lambda: F.concat_ws(" ", F.concat(F.lit("a.name="), F.replace("c_name", F.lit("#"), F.lit("-"))), F.concat(F.lit("seg="), "c_mktsegment")), "c_custkey"), 'filter { kv { } mutate { replace => { "p.seg" => "%{seg}" "p.name" => "%{a.name}" } } mutate { rename => { "p" => "q" } copy => { "q.seg" => "s" } } mutate { remove_field => ["q.seg"] } }', ("c_custkey",), {"q.name": "name", "s": "s", "q.seg": "gone", "p.name": "moved"}, "SELECT c_custkey, replace(c_name, '#', '-') AS name, c_mktsegment AS s, CAST(NULL AS VARCHAR) AS gone, CAST(NULL AS VARCHAR) AS moved FROM customer"),
    "mutate_update_add_field": Case(EVENT_LINES, 'filter { kv { } mutate { replace => { "a" => "%{action}" } } mutate { update => { "a" => "x-%{a}" "missing" => "y" } add_field => { "b" => "%{user}/%{id}" } } }', ("event_id",), {"a": "a", "b": "b", "missing": "missing"}, "SELECT event_id, 'x-' || event_type AS a, user_id || '/' || event_id AS b, CAST(NULL AS VARCHAR) AS missing FROM events"),
    "mutate_merge": Case(EVENT_LINES, 'filter { kv { } mutate { replace => { "v" => "%{action}" "w" => "%{user}" } } mutate { merge => { "all" => "v" } } mutate { merge => { "all" => "w" } } }', ("event_id",), {"all": "every"}, "SELECT event_id, event_type || ',' || user_id AS every FROM events", then=lambda df: df.withColumn("every", F.array_join("every", ","))),
    "route_if_else": Case(made("orders", lambda: F.concat(F.lit("priority="), F.col("o_orderpriority")), "o_orderkey"), 'filter { kv { field_split => ";" } if [priority] =~ /^[12]-/ { mutate { replace => { "lane" => "fast" } } } elsif [priority] in ["3-MEDIUM"] { mutate { replace => { "lane" => "mid" } } } else { mutate { replace => { "lane" => "slow" } } } }', ("o_orderkey",), {"lane": "lane"}, "SELECT o_orderkey, CASE WHEN regexp_matches(o_orderpriority, '^[12]-') THEN 'fast' WHEN o_orderpriority = '3-MEDIUM' THEN 'mid' ELSE 'slow' END AS lane FROM orders"),
    "route_nested": Case(EVENT_LINES, 'filter { kv { } mutate { convert => { "user" => "integer" } } if [user] >= 50 and ![flag] { if [action] == "click" or "view" in [action] { mutate { replace => { "r" => "hot" } } } else { mutate { replace => { "r" => "warm" } } } } else if [action] not in ["click", "view"] { mutate { replace => { "r" => "cold" } } } }', ("event_id",), {"r": "r"}, "SELECT event_id, CASE WHEN user_id >= 50 THEN CASE WHEN event_type IN ('click', 'view') THEN 'hot' ELSE 'warm' END WHEN event_type NOT IN ('click', 'view') THEN 'cold' END AS r FROM events"),
    "drop_filter": Case(EVENT_LINES, 'filter { kv { } if [action] == "view" or [action] == "click" { drop { } } mutate { replace => { "kept" => "%{action}" } } }', ("event_id",), {"kept": "kept"}, "SELECT event_id, event_type AS kept FROM events WHERE event_type NOT IN ('view', 'click')"),
    "for_array_explode": Case(made("part", lambda: F.col("p_name"), "p_partkey"), 'filter { mutate { split => { "message" => " " } } for i, word in message { mutate { replace => { "at" => "%{i}" "w" => "%{word}" } } } }', ("p_partkey",), {"at": "at", "w": "w"}, "SELECT p_partkey, CAST(i - 1 AS VARCHAR) AS at, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)", casts={"at": "string"}),
    "for_map": Case(made("events", lambda: F.col("props"), "event_id"), 'filter { for k, v in message map { mutate { replace => { "key" => "%{k}" "value" => "%{v}" } } } }', ("event_id",), {"key": "key", "value": "value"}, "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events"),
    "for_static": Case(EVENT_LINES, 'filter { kv { } for x in ["click", "error"] { if [action] == "click" { mutate { merge => { "seen" => "x" } } } } }', ("event_id",), {"seen": "seen"}, "SELECT event_id, CASE WHEN event_type = 'click' THEN 'click,error' END AS seen FROM events", then=lambda df: df.withColumn("seen", F.array_join("seen", ","))),
    "on_error_flag": Case(made("events", lambda: F.when(F.col("event_id") % 3 == 0, F.lit("not json")).otherwise(F.col("props")), "event_id"), 'filter { json { source => "message" on_error => "not_json" } if [not_json] == "true" { mutate { replace => { "k" => "none" } } } else { mutate { replace => { "k" => "%{k}" } } } }', ("event_id",), {"not_json": "not_json", "k": "k"}, "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END AS not_json, CASE WHEN event_id % 3 = 0 THEN 'none' ELSE json_extract_string(props, '$.k') END AS k FROM events"),
    "failure_tags": Case(made("events", lambda: F.when(F.col("event_id") % 2 == 0, F.lit("x")).otherwise(F.lit("user=1")), "event_id"), 'filter { grok { match => { "message" => "user=%{INT:u}" } } if "_grokparsefailure" in [tags] { mutate { replace => { "ok" => "no" } } } else { mutate { replace => { "ok" => "yes" } } } }', ("event_id",), {"ok": "ok"}, "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'no' ELSE 'yes' END AS ok FROM events", runtime=lambda s, d: Runtime(dialect="logstash")),
    "tag_membership": Case(EVENT_LINES, 'filter { kv { } if [action] == "error" { mutate { add_tag => ["bad", "seen"] } } else { mutate { add_tag => ["seen"] } } mutate { remove_tag => ["seen"] } if "bad" in [tags] { mutate { replace => { "level" => "high" } } } }', ("event_id",), {"level": "level"}, "SELECT event_id, CASE WHEN event_type = 'error' THEN 'high' END AS level FROM events"),
    "translate_inline": Case(EVENT_LINES, 'filter { kv { } translate { field => "action" destination => "verb" dictionary => { "click" => "CLICKED" "view" => "VIEWED" } fallback => "OTHER" } }', ("event_id",), {"verb": "verb"}, "SELECT event_id, CASE event_type WHEN 'click' THEN 'CLICKED' WHEN 'view' THEN 'VIEWED' ELSE 'OTHER' END AS verb FROM events"),
    "translate_regex": Case(EVENT_LINES, 'filter { kv { } translate { source => "action" target => "verb" regex => true dictionary => { "^c" => "c-word" "e" => "e-word" } fallback => "rest:%{action}" } }', ("event_id",), {"verb": "verb"}, "SELECT event_id, CASE WHEN event_type LIKE 'c%' THEN 'c-word' WHEN event_type LIKE '%e%' THEN 'e-word' ELSE 'rest:' || event_type END AS verb FROM events"),
    "translate_lookup": Case(made("customer", lambda: F.concat(F.lit("nation="), F.col("c_nationkey").cast("string")), "c_custkey"), 'filter { kv { } translate { field => "nation" destination => "name" dictionary_path => "nations" fallback => "?" } }', ("c_custkey",), {"name": "name"}, "SELECT c_custkey, coalesce(n_name, '?') AS name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey", runtime=lambda s, d: Runtime(lookups={"nations": table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))})),
    "external_lookup": Case(made("supplier", lambda: F.concat(F.lit("nation="), F.col("s_nationkey").cast("string")), "s_suppkey"), 'filter { kv { } memcached { key => "nation" target => "name" } }', ("s_suppkey",), {"name": "name"}, "SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey", runtime=lambda s, d: Runtime(dialect="logstash", lookups={"memcached": table(s, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))})),
    "geoip_ranges": Case(
        made("events", lambda: F.concat(F.lit("ip=10."), (F.col("user_id") % 20).cast("string"), F.lit(".0."), (F.col("event_id") % 250).cast("string")), "event_id"),
        'filter { kv { } geoip { source => "ip" target => "geo" } }', ("event_id",), {"geo.country": "country"},
        "SELECT event_id, n_name AS country FROM events LEFT JOIN nation ON n_nationkey = user_id % 20 AND n_nationkey < 12",
        runtime=lambda s, d: Runtime(lookups={"geoip": table(s, d, "nation").where("n_nationkey < 12").select((F.lit(167772160) + F.col("n_nationkey") * 65536).cast("long").alias("low"), (F.lit(167772160) + F.col("n_nationkey") * 65536 + 65535).cast("long").alias("high"), F.col("n_name").alias("country"))}),
    ),
    "cidr_match": Case(made("events", lambda: F.concat(F.lit("ip=10."), (F.col("user_id") % 4).cast("string"), F.lit(".0.7")), "event_id"), 'filter { kv { } cidr { address => ["%{ip}"] network => ["10.0.0.0/15"] add_tag => ["inside"] } if "inside" in [tags] { mutate { replace => { "in" => "y" } } } }', ("event_id",), {"in": "inside"}, "SELECT event_id, CASE WHEN user_id % 4 < 2 THEN 'y' END AS inside FROM events"),
    "clone_union": Case(EVENT_LINES, 'filter { clone { clones => ["audit", "raw"] } }', ("event_id",), {"type": "type"}, "SELECT event_id, unnest([NULL, 'audit', 'raw']) AS type FROM events"),
    "split_events": Case(made("documents", lambda: F.col("text"), "doc_id"), 'filter { split { field => "message" target => "line" } }', ("doc_id",), {"line": "line"}, "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents"),
    "syslog_pri": Case(made("events", lambda: F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">")), "event_id"), 'filter { grok { match => { "message" => "<%{INT:pri}>" } } syslog_pri { source => "pri" } }', ("event_id",), {"pri_severity_code": "severity", "pri_facility_code": "facility", "pri_severity": "name"}, "SELECT event_id, (event_id % 192) & 7 AS severity, (event_id % 192) >> 3 AS facility, ['emergency','alert','critical','error','warning','notice','informational','debug'][((event_id % 192) & 7) + 1] AS name FROM events"),
    "base64_decode": Case(made("part", lambda: F.base64(F.col("p_name").cast("binary")), "p_partkey"), 'filter { base64 { source => "message" target => "plain" } }', ("p_partkey",), {"plain": "plain"}, "SELECT p_partkey, p_name AS plain FROM part"),
    "url_decode": Case(made("part", lambda: F.replace("p_name", F.lit(" "), F.lit("%20")), "p_partkey"), 'filter { url_decode { field => "message" } }', ("p_partkey",), {"message": "plain"}, "SELECT p_partkey, p_name AS plain FROM part"),
    "fingerprint": Case(made("customer", lambda: F.col("c_name"), "c_custkey"), 'filter { fingerprint { source => "message" method => "MD5" target => "m" } fingerprint { source => ["message"] method => "SHA256" key => "k" target => "s" } }', ("c_custkey",), {"m": "m", "s": "s"}, "SELECT c_custkey, md5(c_name) AS m, sha256('k' || c_name) AS s FROM customer"),
    "anonymize_cipher": Case(made("customer", lambda: F.col("c_name"), "c_custkey"), 'filter { mutate { copy => { "message" => "a" } } anonymize { fields => ["a"] key => "salt" } cipher { source => "message" target => "c" mode => "encrypt" algorithm => "aes-128-cbc" key => "a key of 16 byte" } cipher { source => "c" target => "d" mode => "decrypt" algorithm => "aes-128-cbc" key => "a key of 16 byte" } }', ("c_custkey",), {"a": "a", "d": "d"}, "SELECT c_custkey, sha256('salt' || c_name) AS a, c_name AS d FROM customer"),
    "math_calculate": Case(made("lineitem", lambda: F.concat_ws(" ", F.concat(F.lit("q="), F.col("l_quantity").cast("string")), F.concat(F.lit("p="), F.col("l_linenumber").cast("string"))), "l_orderkey", "l_linenumber"), 'filter { kv { } math { calculate => [["*", "q", "p", "area"], ["+", "area", "1", "more"]] } }', ("l_orderkey", "l_linenumber"), {"area": "area", "more": "more"}, "SELECT l_orderkey, l_linenumber, l_quantity * l_linenumber AS area, l_quantity * l_linenumber + 1 AS more FROM lineitem"),
    "text_transforms": Case(
        made("part", lambda: F.concat_ws(",", F.concat(F.lit("host"), F.col("p_partkey").cast("string"), F.lit(".example."), F.when(F.col("p_size") % 2 == 0, "com").otherwise("org")), F.concat(F.col("p_size").cast("string"), F.lit(" KB")), F.lit("AA-BB-CC-00-11-22"), F.lit("café"), F.concat(F.lit("n "), F.col("p_size").cast("string"), F.lit(" of 7"))), "p_partkey"),
        'filter { csv { columns => ["host", "size", "mac", "word", "nums"] } tld { source => "host" target => "tld" } bytes { source => "size" target => "bytes" } mac { source => "mac" target => "mac2" } i18n { transliterate => ["word"] } extractnumbers { source => "nums" target => "found" } truncate { fields => ["host"] length_bytes => 4 } alter { coalesce => ["first", "%{nothing}", "%{word}"] } }',
        ("p_partkey",), {"tld": "tld", "bytes": "bytes", "mac2": "mac", "word": "word", "found": "found", "host": "host", "first": "first"},
        "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'com' ELSE 'org' END AS tld, CAST(p_size * 1000 AS VARCHAR) AS bytes, 'aa:bb:cc:00:11:22' AS mac, 'cafe' AS word, p_size || '|7' AS found, 'host' AS host, 'cafe' AS first FROM part",
        then=lambda df: df.withColumn("found", F.array_join("found", "|")),
    ),
    "prune_fields": Case(EVENT_LINES, 'filter { kv { } mutate { replace => { "keep_a" => "%{action}" "lose_b" => "%{user}" } } prune { blacklist_names => ["^lose_"] } }', ("event_id",), {"keep_a": "keep_a", "lose_b": "lose_b"}, "SELECT event_id, event_type AS keep_a, CAST(NULL AS VARCHAR) AS lose_b FROM events"),
    "elapsed_lag": Case(lambda s, d: table(s, d, "events").select("event_id", "user_id", "ts", F.lit("x").alias("message")), 'filter { elapsed { unique_id_field => "user_id" timestamp_field => "ts" tie_break => ["event_id"] } }', ("event_id",), {"elapsed.time": "seconds"}, "SELECT event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS seconds FROM events"),
    "aggregate_task": Case(EVENT_LINES, 'filter { kv { } aggregate { task_id => "%{user}" code => "map[:n] += 1" } }', ("event_id",), {"aggregate.count": "n"}, "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n FROM events"),
    "throttle_row_number": Case(lambda s, d: table(s, d, "events").select("event_id", "ts", F.concat(F.lit("u="), F.col("user_id").cast("string")).alias("message")), 'filter { kv { } throttle { key => "%{u}" after_count => 3 order_field => "ts" tie_break => ["event_id"] } }', ("event_id",), {"throttled": "throttled"}, "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3 AS throttled FROM events"),
    "output_anchor_routing": Case(EVENT_LINES, 'filter { kv { } if [action] == "purchase" { mutate { merge => { "@output" => "sale" } } } else { mutate { merge => { "@output" => "visit" } } } mutate { merge => { "@output" => "raw" } } }', ("event_id",), {"_output": "anchors"}, "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'sale,raw' ELSE 'visit,raw' END AS anchors FROM events", then=lambda df: df.withColumn("anchors", F.array_join("anchors", ","))),
    "on_error_block": Case(made("events", lambda: F.when(F.col("event_id") % 5 == 0, F.lit("?")).otherwise(_event_line()), "event_id"), 'filter { grok { match => { "message" => "action=%{WORD:act}" } on_error => "on_error_grok" } on_error { mutate { replace => { "act" => "fallback" } } } }', ("event_id",), {"act": "act"}, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'fallback' ELSE event_type END AS act FROM events"),
    "loop_merge": Case(made("part", lambda: F.col("p_name"), "p_partkey"), 'filter { mutate { split => { "message" => " " } } for i, w in message { if [w] =~ /^[a-m]/ { mutate { replace => { "v" => "%{i}:%{w}" } } mutate { merge => { "all" => "v" } } } } }', ("p_partkey",), {"all": "every", "v": "last"}, "WITH w AS (SELECT p_partkey, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i, unnest(string_split(p_name, ' ')) AS w FROM part), k AS (SELECT p_partkey, string_agg(i || ':' || w, ',' ORDER BY i) AS every, CASE WHEN bool_or(i = m) THEN arg_max(i || ':' || w, i) END AS last_ FROM (SELECT *, max(i) OVER (PARTITION BY p_partkey) AS m FROM w) WHERE regexp_matches(w, '^[a-m]') GROUP BY 1) SELECT p.p_partkey, coalesce(every, '') AS every, last_ AS last FROM part p LEFT JOIN k USING (p_partkey)", then=lambda df: df.withColumn("every", F.array_join("every", ","))),
    "elapsed_guarded": Case(lambda s, d: table(s, d, "events").select("event_id", "ts", F.when(F.col("event_id") % 7 > 0, F.col("user_id")).alias("who"), F.col("event_type").alias("message")), 'filter { if [message] == "click" { elapsed { unique_id_field => "who" timestamp_field => "ts" tie_break => ["event_id"] } } }', ("event_id",), {"elapsed.time": "seconds"}, "SELECT event_id, CASE WHEN event_type = 'click' AND event_id % 7 > 0 THEN (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type, event_id % 7 > 0 ORDER BY ts, event_id)) / 1e6 END AS seconds FROM events"),
    "elapsed_tags": Case(lambda s, d: table(s, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("message")), 'filter { if [message] == "view" { mutate { add_tag => ["begin"] } } else if [message] == "purchase" { mutate { add_tag => ["end"] } } elapsed { start_tag => "begin" end_tag => "end" unique_id_field => "user_id" timestamp_field => "ts" timeout => 100000 tie_break => ["event_id"] } }', ("event_id",), {"elapsed.time": "seconds", "tags": "tags"}, "WITH e AS (SELECT event_id, event_type, CASE WHEN event_type = 'purchase' THEN (epoch_us(ts) - max(CASE WHEN event_type = 'view' THEN epoch_us(ts) END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6 END AS s FROM events) SELECT event_id, CASE WHEN s <= 100000 THEN s END AS seconds, concat_ws(',', CASE event_type WHEN 'view' THEN 'begin' WHEN 'purchase' THEN 'end' END, CASE WHEN s <= 100000 THEN 'elapsed,elapsed_match' WHEN s > 100000 THEN 'elapsed_expired_error' END) AS tags FROM e", then=lambda df: df.withColumn("tags", F.coalesce(F.array_join("tags", ","), F.lit("")))),
    "aggregate_guarded": Case(made("events", _event_line, "event_id"), "filter { kv { } if [action] == \"click\" { aggregate { task_id => \"%{user}\" code => \"map[:n] += 1; map[:sum] += event.get('id')\" } } }", ("event_id",), {"aggregate.count": "c", "aggregate.n": "n", "aggregate.sum": "total"}, "SELECT event_id, CASE WHEN event_type = 'click' THEN count(*) OVER w END AS c, CASE WHEN event_type = 'click' THEN CAST(count(*) OVER w AS DOUBLE) END AS n, CASE WHEN event_type = 'click' THEN CAST(sum(event_id) OVER w AS DOUBLE) END AS total FROM events WINDOW w AS (PARTITION BY user_id, event_type = 'click')"),
    "aggregate_map": Case(lambda s, d: table(s, d, "events").select("event_id", "ts", _event_line().alias("message")), "filter { kv { } aggregate { task_id => \"%{user}\" order_field => \"ts\" tie_break => [\"event_id\"] code => \"map[:first] ||= event.get('action'); map[:last] = event.get('id')\" } }", ("event_id",), {"aggregate.first": "first", "aggregate.last": "last"}, "SELECT event_id, first_value(event_type) OVER w AS first, CAST(last_value(event_id) OVER w AS VARCHAR) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "throttle_guarded": Case(lambda s, d: table(s, d, "events").select("event_id", "ts", F.concat(F.lit("a="), F.col("event_type"), F.when(F.col("event_id") % 3 > 0, F.concat(F.lit(" u="), F.col("user_id").cast("string"))).otherwise(F.lit(""))).alias("message")), 'filter { kv { } if [a] == "click" { throttle { key => "%{u}" after_count => 2 order_field => "ts" tie_break => ["event_id"] add_tag => ["slow"] } } }', ("event_id",), {"throttled": "throttled", "tags": "tags"}, "WITH t AS (SELECT event_id, event_type, event_id % 3 > 0 AND row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 > 0 ORDER BY ts, event_id) > 2 AS o FROM events) SELECT event_id, CASE WHEN event_type = 'click' THEN o END AS throttled, CASE WHEN event_type = 'click' AND o THEN 'slow' END AS tags FROM t", then=lambda df: df.withColumn("tags", F.nullif(F.array_join("tags", ","), F.lit("")))),
    "kv_quoted": Case(made("part", lambda: F.concat(F.lit('name="'), F.col("p_name"), F.lit("\" type='"), F.col("p_type"), F.lit("' brand=["), F.col("p_brand"), F.lit("] size="), F.col("p_size").cast("string")), "p_partkey"), 'filter { kv { default_keys => ["size", "0", "color", "none"] } }', ("p_partkey",), {"name": "name", "type": "type", "brand": "brand", "size": "size", "color": "color"}, "SELECT p_partkey, p_name AS name, p_type AS type, p_brand AS brand, CAST(p_size AS VARCHAR) AS size, 'none' AS color FROM part"),
    "csv_wide": Case(made("part", lambda: F.concat(F.repeat(F.lit("x,"), F.lit(39)), F.lit('"say ""'), F.col("p_name"), F.lit('"", ok",'), F.col("p_size").cast("string")), "p_partkey"), "filter { csv { } }", ("p_partkey",), {"column39": "c39", "column40": "c40", "column41": "c41", "column42": "c42"}, "SELECT p_partkey, 'x' AS c39, 'say \"' || p_name || '\", ok' AS c40, CAST(p_size AS VARCHAR) AS c41, CAST(NULL AS VARCHAR) AS c42 FROM part"),
    "csv_convert": Case(made("part", lambda: F.concat_ws(";", F.col("p_size").cast("string"), F.lit(""), F.col("p_retailprice").cast("string")), "p_partkey"), 'filter { csv { separator => ";" columns => ["size", "empty", "price"] convert => { "size" => "integer" "price" => "float" } } }', ("p_partkey",), {"size": "size", "empty": "empty", "price": "price"}, "SELECT p_partkey, CAST(p_size AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS empty, p_retailprice AS price FROM part"),
    "truncate_bytes": Case(made("part", lambda: F.concat(F.repeat(F.lit("é"), F.col("p_size") % 4), F.lit("ab漢")), "p_partkey"), 'filter { truncate { fields => ["message"] length_bytes => 5 } }', ("p_partkey",), {"message": "t"}, "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'ab漢' WHEN 1 THEN 'éab' WHEN 2 THEN 'ééa' ELSE 'éé' END AS t FROM part"),
    "cidr_ipv6": Case(made("events", lambda: F.concat(F.lit("ip=2001:db8:"), F.hex(F.col("user_id") % 4), F.lit("::"), F.hex(F.col("event_id"))), "event_id"), 'filter { kv { } cidr { address => ["%{ip}"] network => ["2001:db8::/47", "10.0.0.0/8"] add_field => { "in" => "y" } } }', ("event_id",), {"in": "inside"}, "SELECT event_id, CASE WHEN user_id % 4 < 2 THEN 'y' END AS inside FROM events"),
    "xml_nodes": Case(made("part", lambda: F.concat(F.lit('<p id="'), F.col("p_size").cast("string"), F.lit('"><w>'), F.replace("p_name", F.lit(" "), F.lit("</w><w>")), F.lit("</w></p>")), "p_partkey"), 'filter { xml { source => "message" xpath => { "/p/w/text()" => "words" "/p/@id" => "id" } } }', ("p_partkey",), {"words": "words", "id": "id"}, "SELECT p_partkey, replace(p_name, ' ', ',') AS words, CAST(p_size AS VARCHAR) AS id FROM part", then=lambda df: df.withColumn("words", F.array_join("words", ",")).withColumn("id", F.array_join("id", ","))),
    "on_error_any": Case(made("events", lambda: F.when(F.col("event_id") % 5 == 0, F.lit('{"a":1}')).when(F.col("event_id") % 5 == 1, F.lit("x=1")).otherwise(F.lit("none")), "event_id"), 'filter { json { source => "message" on_error => "bad_json" } grok { match => { "message" => "x=%{INT:x}" } on_error => "bad_grok" } on_error { mutate { replace => { "state" => "%{bad_json}/%{bad_grok}" } } } }', ("event_id",), {"state": "state"}, "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'false/true' WHEN 1 THEN 'true/false' ELSE 'true/true' END AS state FROM events"),
    "grok_syslog": Case(made("events", lambda: F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit(">1 2024-03-01T10:00:00Z host"), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(' 77 ID [a b="c"] did it')), "event_id"), 'filter { grok { match => { "message" => "%{SYSLOG5424LINE}" } } }', ("event_id",), {"syslog5424_pri": "pri", "syslog5424_host": "host", "syslog5424_app": "app", "syslog5424_sd": "sd", "syslog5424_msg": "msg"}, "SELECT event_id, CAST(event_id % 192 AS VARCHAR) AS pri, 'host' || user_id AS host, event_type AS app, '[a b=\"c\"]' AS sd, 'did it' AS msg FROM events"),
    "grok_syslog_base": Case(made("events", lambda: F.concat(F.lit("Mar  1 10:00:00 web"), F.col("user_id").cast("string"), F.lit(".example.org "), F.col("event_type"), F.lit("["), (F.col("event_id") + 1).cast("string"), F.lit("]: all is well")), "event_id"), 'filter { grok { match => { "message" => "%{SYSLOGLINE}" } } }', ("event_id",), {"timestamp": "at", "logsource": "host", "program": "program", "pid": "pid"}, "SELECT event_id, 'Mar  1 10:00:00' AS at, 'web' || user_id || '.example.org' AS host, event_type AS program, CAST(event_id + 1 AS VARCHAR) AS pid FROM events"),
    "grok_firewall": Case(made("events", lambda: F.concat(F.lit("Deny tcp src outside:10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".1/"), (F.col("event_id") % 60000).cast("string"), F.lit(' dst inside:192.168.0.7/443 by access-group "acl" [0x0, 0x0]')), "event_id"), 'filter { grok { match => { "message" => "%{CISCOFW106023}" } } }', ("event_id",), {"action": "action", "protocol": "protocol", "src_ip": "src", "src_port": "port", "dst_ip": "dst", "policy_id": "policy"}, "SELECT event_id, 'Deny' AS action, 'tcp' AS protocol, '10.0.' || user_id % 256 || '.1' AS src, CAST(event_id % 60000 AS VARCHAR) AS port, '192.168.0.7' AS dst, 'acl' AS policy FROM events"),
    "grok_web": Case(made("events", lambda: F.concat(F.lit('10.1.2.3 - bob [10/Oct/2000:13:55:36 -0700] "GET /'), F.col("event_type"), F.lit("?id="), F.col("event_id").cast("string"), F.lit(' HTTP/1.1" 200 '), F.col("user_id").cast("string"), F.lit(' "-" "curl/8"')), "event_id"), 'filter { grok { match => { "message" => "%{HTTPD_COMBINEDLOG}" } } }', ("event_id",), {"clientip": "client", "verb": "verb", "request": "request", "response": "status", "bytes": "bytes", "agent": "agent"}, "SELECT event_id, '10.1.2.3' AS client, 'GET' AS verb, '/' || event_type || '?id=' || event_id AS request, '200' AS status, CAST(user_id AS VARCHAR) AS bytes, '\"curl/8\"' AS agent FROM events"),
    "grok_load_balancer": Case(made("events", lambda: F.concat(F.lit("Feb  6 12:14:14 lb haproxy[14]: 10.0.1.2:33317 [06/Feb/2009:12:14:14.655] http-in static/srv"), F.col("user_id").cast("string"), F.lit(" 10/0/30/69/109 200 "), F.col("event_id").cast("string"), F.lit(' - - ---- 1/1/1/1/0 0/0 "GET /'), F.col("event_type"), F.lit(' HTTP/1.1"')), "event_id"), 'filter { grok { match => { "message" => "%{HAPROXYHTTP}" } } }', ("event_id",), {"server_name": "server", "bytes_read": "bytes", "http_verb": "verb", "http_request": "path"}, "SELECT event_id, 'srv' || user_id AS server, CAST(event_id AS VARCHAR) AS bytes, 'GET' AS verb, '/' || event_type AS path FROM events"),
    "grok_monitoring": Case(made("events", lambda: F.concat(F.lit("["), (F.col("event_id") + 1_700_000_000).cast("string"), F.lit("] SERVICE ALERT: web"), F.col("user_id").cast("string"), F.lit(";"), F.col("event_type"), F.lit(";CRITICAL;HARD;3;timed out; again")), "event_id"), 'filter { grok { match => { "message" => "%{NAGIOSTIME} %{NAGIOS_SERVICE_ALERT}" } } }', ("event_id",), {"nagios_epoch": "epoch", "nagios_type": "type", "nagios_hostname": "host", "nagios_service": "service", "nagios_state": "state", "nagios_message": "text"}, "SELECT event_id, CAST(event_id + 1700000000 AS VARCHAR) AS epoch, 'SERVICE ALERT' AS type, 'web' || user_id AS host, event_type AS service, 'CRITICAL' AS state, 'timed out; again' AS text FROM events"),
    "grok_monitoring_lines": Case(made("events", lambda: F.concat(F.lit("[17] "), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("CURRENT HOST STATE: h"), F.col("user_id").cast("string"), F.lit(";UP;HARD;1;ok"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("EXTERNAL COMMAND: ENABLE_SVC_CHECK;h"), F.col("user_id").cast("string"), F.lit(";"), F.col("event_type"))).otherwise(F.lit("nothing known"))), "event_id"), 'filter { grok { match => { "message" => "%{NAGIOSLOGLINE}" } on_error => "bad" } }', ("event_id",), {"nagios_type": "type", "nagios_hostname": "host", "bad": "bad"}, "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'CURRENT HOST STATE' WHEN 1 THEN 'EXTERNAL COMMAND' END AS type, CASE WHEN event_id % 3 < 2 THEN 'h' || user_id END AS host, CASE WHEN event_id % 3 < 2 THEN 'false' ELSE 'true' END AS bad FROM events"),
    "grok_sensor": Case(made("events", lambda: F.concat_ws("\t", F.lit("1.5"), F.concat(F.lit("C"), F.col("event_id").cast("string")), F.lit("10.0.0.1"), F.lit("4000"), F.lit("10.0.0.2"), F.lit("53"), F.lit("udp"), F.col("event_type"), *[F.lit("-")] * 11, F.concat(F.lit("t"), F.col("user_id").cast("string"))), "event_id"), 'filter { grok { match => { "message" => "%{BRO_CONN}" } } }', ("event_id",), {"uid": "uid", "resp_p": "port", "service": "service", "tunnel_parents": "parents"}, "SELECT event_id, 'C' || event_id AS uid, '53' AS port, event_type AS service, 't' || user_id AS parents FROM events"),
    "grok_mail": Case(made("events", lambda: F.concat(F.lit("2024-05-01 10:11:12 1s1abc-000dEF-Gh <= "), F.col("event_type"), F.lit("@example.org H=mx.example.org ["), F.lit("10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit("]:25 P=esmtps S="), F.col("event_id").cast("string")), "event_id"), 'filter { grok { match => { "message" => "%{EXIM}" } } }', ("event_id",), {"exim_msgid": "msgid", "exim_sender_email": "sender", "remote_host": "host", "exim_msg_size": "size"}, "SELECT event_id, '1s1abc-000dEF-Gh' AS msgid, event_type || '@example.org' AS sender, '10.0.0.' || user_id % 250 AS host, CAST(event_id AS VARCHAR) AS size FROM events"),
    "grok_backup": Case(made("events", lambda: F.concat(F.lit("01-May 10:11 backup-dir JobId "), F.col("event_id").cast("string"), F.when(F.col("event_type") == "click", F.concat(F.lit(": Start Backup JobId 1, Job=night."), F.col("user_id").cast("string"))).otherwise(F.lit(': Labeled new Volume "vol-1" on device "tape" (/dev/nst0).'))), "event_id"), 'filter { grok { match => { "message" => "%{BACULA_LOGLINE}" } } }', ("event_id",), {"jobid": "jobid", "job": "job", "volume": "volume", "device": "device"}, "SELECT event_id, CAST(event_id AS VARCHAR) AS jobid, CASE WHEN event_type = 'click' THEN 'night.' || user_id ELSE '' END AS job, CASE WHEN event_type = 'click' THEN '' ELSE 'vol-1' END AS volume, CASE WHEN event_type = 'click' THEN '' ELSE 'tape' END AS device FROM events"),
    "grok_user_patterns": Case(EVENT_LINES, 'filter { grok { match => { "message" => "%{WHO} %{DID:act} " } } }', ("event_id",), {"who": "who", "act": "act"}, "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(user_id AS VARCHAR) END AS who, CASE WHEN event_type IN ('click', 'view') THEN 'action=' || event_type END AS act FROM events", runtime=lambda s, d: Runtime(patterns={"WHO": "user=%{INT:who}", "DID": "action=(?:click|view)"})),
    "front_end_paths": Case(EVENT_LINES, 'filter { kv { } mutate { replace => { "a" => /var/log/app "b" => /spool/x_{y}/ "c" => https://h.example:1/p#part "d" => "\\" } } # end\n if [action] =~ /^cl/ { mutate { replace => { "a" => /opt_{/z/} } } } }', ("event_id",), {"a": "a", "b": "b", "c": "c", "d": "d"}, "SELECT event_id, CASE WHEN event_type LIKE 'cl%' THEN '/opt_{/z/}' ELSE '/var/log/app' END AS a, '/spool/x_{y}/' AS b, 'https://h.example:1/p#part' AS c, '\\' AS d FROM events"),
    "regex_over_lines": Case(made("events", lambda: F.concat(F.col("event_type"), F.lit("\n  {"), F.col("user_id").cast("string")), "event_id"), 'filter { if [message] =~ /(click|view)\n  \\{1/ { mutate { replace => { "hit" => "y" } } } }', ("event_id",), {"hit": "hit"}, "SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND CAST(user_id AS VARCHAR) LIKE '1%' THEN 'y' END AS hit FROM events"),
    "dns_lookup": Case(made("supplier", lambda: F.concat(F.lit("addr="), F.col("s_nationkey").cast("string")), "s_suppkey"), 'filter { kv { } dns { resolve => ["addr"] action => "replace" } }', ("s_suppkey",), {"addr": "name"}, "SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey", runtime=lambda s, d: Runtime(dialect="logstash", lookups={"dns": table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))})),
    "useragent_lookup": Case(made("supplier", lambda: F.concat(F.lit("agent="), F.col("s_nationkey").cast("string")), "s_suppkey"), 'filter { kv { } useragent { source => "agent" target => "ua" } }', ("s_suppkey",), {"ua.name": "name"}, "SELECT s_suppkey, n_name AS name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey", runtime=lambda s, d: Runtime(dialect="logstash", lookups={"useragent": table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("value"))})),
    "uuid_field": Case(EVENT_LINES, 'filter { kv { } if [action] == "click" { uuid { target => "own" } } }', ("event_id",), {"own": "own"}, "SELECT event_id, event_type = 'click' AS made FROM events", then=lambda df: df.select("event_id", F.coalesce(F.col("own").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), F.lit(False)).alias("made"))),
    "drop_percentage": Case(EVENT_LINES, 'filter { kv { } if [action] == "click" { drop { percentage => 100 } } if [action] == "view" { drop { percentage => 0 } } statedump { } }', ("event_id",), {"action": "action"}, "SELECT event_id, event_type AS action FROM events WHERE event_type <> 'click'"),
    "tags_added_removed": Case(EVENT_LINES, 'filter { kv { } mutate { add_tag => ["a", "b"] } if [action] == "click" { mutate { remove_tag => ["a"] add_tag => ["c"] } } }', ("event_id",), {"tags": "tags"}, "SELECT event_id, CASE WHEN event_type = 'click' THEN 'b,c' ELSE 'a,b' END AS tags FROM events", then=lambda df: df.withColumn("tags", F.array_join(F.array_sort("tags"), ","))),
}


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events for each security action: the flagship query."""
    routed = run_parser(ROUTING, EVENT_LINES(spark, sf_dir), fields=[ACTION])
    return routed.groupBy(F.col(f"`{ACTION}`").alias("action")).agg(F.count(F.lit(1)).alias("n"))


def topk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 most frequent words of part names, ties by name."""
    code = 'filter { mutate { split => { "message" => " " } } for w in message { mutate { replace => { "word" => "%{w}" } } } }'
    words = run_parser(code, made("part", F.col("p_name"), "p_partkey")(spark, sf_dir), fields=["word"])
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(25)


def dedupe_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and action, by time and id."""
    lines = table(spark, sf_dir, "events").select("event_id", "ts", _event_line().alias("message"))
    read = run_parser("filter { kv { } }", lines, fields=["user", "action"])
    return read.groupBy("user", "action").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("first_id"))


EXTRA: dict[str, tuple[Query, str]] = {
    "route_counts": (route_counts, f"SELECT {ROUTED} AS action, count(*) AS n FROM events GROUP BY 1"),
    "topk_counts": (topk_counts, "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 25"),
    "dedupe_first_seen": (dedupe_first_seen, 'SELECT CAST(user_id AS VARCHAR) AS "user", event_type AS action, arg_min(event_id, (ts, event_id)) AS first_id FROM events GROUP BY 1, 2'),
}


def queries() -> dict[str, Query]:
    return {**CASES, **{k: f for k, (f, _) in EXTRA.items()}}


def oracle_sql() -> dict[str, str]:
    return {**{k: c.sql for k, c in CASES.items()}, **{k: s for k, (_, s) in EXTRA.items()}}
