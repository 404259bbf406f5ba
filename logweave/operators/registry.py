"""Plugins of the DSL: classes, dialects, failure tags and limits.

The names, tags and numbers below are fixed values of the configuration language.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path

DIALECTS = ("secops", "logstash")
EXTRACTORS = ("json", "xml", "kv", "csv", "grok", "dissect")
TRANSFORMS = ("date", "base64", "url_decode", "syslog_pri", "ruby", "translate", "aggregate", "elapsed", "uuid")
GENERIC_TRANSFORMS = ("mac", "math", "extractnumbers", "tld", "cipher", "anonymize", "fingerprint", "urldecode", "bytes", "i18n", "alter", "truncate")
ENRICHERS = ("useragent", "geoip", "cidr", "dns")
EXTERNAL = ("elasticsearch", "memcached", "jdbc_streaming", "http", "rest", "acme_threat_lookup")
MUTATE_LIKE = ("mutate", "clone", "prune", "split")
CLASS_OF = {
    **dict.fromkeys(EXTRACTORS, "extractor"), **dict.fromkeys(TRANSFORMS + GENERIC_TRANSFORMS, "transform"), **dict.fromkeys(ENRICHERS + EXTERNAL, "enricher"),
    **dict.fromkeys(MUTATE_LIKE, "mutate_like"), "on_error": "passthrough",
}
FAILURE_TAGS = {"json": "_jsonparsefailure", "xml": "_xmlparsefailure", "kv": "_kvparsefailure", "csv": "_csvparsefailure", "grok": "_grokparsefailure", "date": "_dateparsefailure", "dissect": "_dissectfailure"}
TIMEOUT_TAGS = {"grok": "_groktimeout"}
SOURCE_KEYS = ("source", "field", "fields")
DEST_KEYS = ("target", "destination")
CANONICAL_ORDER = ("rename", "update", "replace", "convert", "gsub", "uppercase", "lowercase", "strip", "remove_field", "split", "join", "merge", "add_field", "add_tag", "remove_tag")
MUTATE_OPS = (*CANONICAL_ORDER, "copy", "on_error")
DECORATORS = ("add_tag", "remove_tag", "add_field", "remove_field")

MAX_PARSER_BYTES = 25_000_000
MAX_NESTING = 64
MAX_TEMPLATE_COMBINATIONS = 1024
MAX_PRIOR_NEGATIONS = 32
MAX_DROP_CONDITIONS = 32
MAX_MERGE_ALTERNATIVES = 4096
MAX_NOOP_ALTERNATIVES = 128
MAX_CLONES = 128
MAX_LOOP_FANOUT = 1000
MAX_STATIC_LOOP = 100_000
MAX_LITERAL_COLLECTION = 50_000
MAX_GSUB_PRODUCTS = 50_000
MAX_HINTS = 128
MAX_SOURCE_DEPTH = 32
MAX_ELIF_CHAIN = 1000
MAX_SYSLOG_LITERALS = 32
MAX_IO_VALUE = 256
MAX_ARRAY_LITERAL = 100_000
MAX_MEMBER_ALTERNATIVES = 2048
MAX_SIGNATURE_BYTES = 1 << 20

#: Keys of plugins whose configuration is validated: the kind of each value.
VALIDATED = {
    "json": {"source": "text", "target": "text", "array_function": "text"},
    "xml": {"source": "text", "xpath": "list", "namespaces": "list"},
    "kv": {"source": "text", "target": "text", "field_split": "text", "value_split": "text", "trim_value": "text", "trim_key": "text", "whitespace": "text", "prefix": "text", "include_keys": "texts", "exclude_keys": "texts", "allow_duplicate_values": "flag"},
    "csv": {"source": "text", "separator": "text", "columns": "texts"},
    "grok": {"match": "list", "pattern_definitions": "list"},
    "dissect": {"mapping": "list", "match": "list"},
    "date": {"match": "list", "target": "text", "timezone": "text", "locale": "text"},
    "base64": {"source": "text", "field": "text", "fields": "any", "target": "text", "encoding": "text"},
    "url_decode": {"source": "text", "field": "text", "fields": "any", "target": "text"},
}
#: Keys that any plugin may have, and those of single plugins, which are not reported as unknown.
COMMON_KEYS = frozenset("add_field add_tag enable_metric id on_error periodic_flush remove_field remove_tag tag_on_failure tag_on_timeout timeout_millis".split())
IGNORED_KEYS = {
    "json": "fallback skip_on_invalid_json",
    "xml": "force_array parse_options remove_namespaces store_xml target",
    "kv": "allow_empty_values default_keys exclude_keys field_split_pattern include_brackets include_keys recursive target transform_key transform_value value_split_pattern whitespace_strict",
    "csv": "autodetect_column_names autogenerate_column_names convert quote_char skip_empty_columns skip_empty_rows skip_header target",
    "grok": "break_on_match keep_empty_captures named_captures_only overwrite source target",
    "dissect": "append_separator convert_datatype",
    "base64": "action",
}


def problems(plugin: str, config) -> tuple[list[str], list[str]]:
    """What is wrong with the values of a validated plugin's configuration, and its unknown keys."""
    known = VALIDATED.get(plugin)
    if known is None:
        return [], []
    wrong, unknown = [], []
    for key, value in config:
        kind = known.get(key)
        if kind is None:
            if key not in COMMON_KEYS and key not in IGNORED_KEYS.get(plugin, "").split():
                unknown.append(key)
        elif kind == "text" and not isinstance(value, str):
            wrong.append(f"{key}: expected a string")
        elif kind in ("list", "texts") and not isinstance(value, list):
            wrong.append(f"{key}: expected a list")
        elif kind == "texts" and not all(isinstance(v, str) for v in value):
            wrong.append(f"{key}: expected a list of strings")
        elif kind == "flag" and value is not True:  # only the bare key is a flag; words are strings
            wrong.append(f"{key}: expected a flag")
    return wrong, unknown


def allowed(plugin: str, dialect: str) -> bool:
    return not (plugin in EXTERNAL and dialect != "logstash" or plugin == "on_error" and dialect != "secops")


@dataclass(frozen=True)
class Signature:
    """What a user declares of a plugin that the engine does not know."""

    name: str
    semantic_class: str = "enricher"
    source_keys: tuple[str, ...] = ()
    dest_keys: tuple[str, ...] = ()
    dest_value_kind: str = "scalar"
    in_place: bool = False
    lineage_status: str = "dynamic"
    taint_hint: str = "none"


BUNDLED = {
    s.name: s
    for s in (
        Signature("cidr_lookup", "enricher", ("source", "address"), ("target",), taint_hint="dynamic"),
        Signature("enrich_geoip", "enricher", ("source",), ("target",), taint_hint="dynamic"),
        Signature("http_filter", "enricher", ("url",), ("target_body", "target"), taint_hint="dynamic"),
        Signature("jdbc_lookup", "enricher", ("statement",), ("target",), taint_hint="dynamic"),
        Signature("rest_filter", "enricher", ("url",), ("target",), taint_hint="dynamic"),
        Signature("throttle", "passthrough", ("key",), ()),
        Signature("threat_lookup", "enricher", ("source", "field"), ("target",), taint_hint="dynamic"),
    )
}


def load_signatures(*paths: str) -> dict[str, Signature]:
    """Signatures from TOML files and directories of them: directories first, later names win."""
    out: dict[str, Signature] = {}
    files = [f for p in paths if Path(p).is_dir() for f in sorted(Path(p).glob("*.toml"))] + [Path(p) for p in paths if not Path(p).is_dir()]
    for f in files:
        if f.stat().st_size > MAX_SIGNATURE_BYTES:
            raise ValueError(f"signature file {f} is larger than {MAX_SIGNATURE_BYTES} bytes")
        for key, body in tomllib.loads(f.read_text("utf-8")).items():
            if body.get("name", key) != key:
                raise ValueError(f"{f}: signature {key!r} is named {body['name']!r}")
            unknown = set(body) - set(Signature.__dataclass_fields__)
            if unknown:
                raise ValueError(f"{f}: signature {key!r} has unknown keys {sorted(unknown)}")
            out[key] = Signature(**{"name": key} | {k: tuple(v) if isinstance(v, list) else v for k, v in body.items()})
    return out
