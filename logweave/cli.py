"""Command line: python -m logweave PARSER_FILE [FIELD] [flags]. Exit codes: 0 ok, 1 input, 2 usage, 3 strict."""

from __future__ import annotations

import argparse
import json
import os
import sys

from logweave.functions.grok import load_libraries
from logweave.operators.query import ParserLineage, is_strict_failure
from logweave.operators.registry import BUNDLED, MAX_PARSER_BYTES, load_signatures
from logweave.render import render_json, render_text

VERSION = "0.1.0"


def read_source(path: str, max_bytes: int) -> str:
    if path == "-":
        data = sys.stdin.buffer.read(max_bytes + 1)
    else:
        if os.path.isdir(path):
            raise OSError(f"{path} is a directory")
        with open(path, "rb") as f:
            data = f.read(max_bytes + 1)
    if len(data) > max_bytes:
        raise OSError(f"the parser source is larger than {max_bytes} bytes")
    return data.decode("utf-8-sig")


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="logweave", description="Which raw-log fields can populate an output field of a parser?")
    p.add_argument("parser_file")
    p.add_argument("field", nargs="?")
    mode = p.add_mutually_exclusive_group()
    for name in ("list", "summary", "compact-summary", "compat-report"):
        mode.add_argument(f"--{name}", action="store_true")
    p.add_argument("--json", action="store_true")
    p.add_argument("--compact-json", action="store_true")
    p.add_argument("--strict", action="store_true")
    p.add_argument("--verbose", action="store_true")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--dialect", choices=("secops", "logstash"), default="secops")
    p.add_argument("--max-parser-bytes", type=int, default=MAX_PARSER_BYTES)
    order = p.add_mutually_exclusive_group()
    order.add_argument("--mutate-canonical-order", action="store_true", default=None)
    order.add_argument("--mutate-source-order", action="store_true", default=None)
    p.add_argument("--include-pattern-bodies", action="store_true")
    p.add_argument("--grok-patterns-dir", action="append", default=[])
    p.add_argument("--plugin-signatures", action="append", default=[])
    p.add_argument("--plugin-signatures-dir", action="append", default=[])
    p.add_argument("--bundled-signatures", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    whole = args.list or args.summary or args.compact_summary or args.compat_report
    if bool(args.field) == bool(whole):
        print("give either a field or one of --list, --summary, --compact-summary, --compat-report", file=sys.stderr)
        return 2
    order = True if args.mutate_canonical_order else False if args.mutate_source_order else None
    try:
        code = read_source(args.parser_file, args.max_parser_bytes)
        signatures = (BUNDLED if args.bundled_signatures else {}) | load_signatures(*args.plugin_signatures_dir, *args.plugin_signatures)
        lineage = ParserLineage(code, dialect=args.dialect, canonical_order=order, patterns=load_libraries(args.grok_patterns_dir), signatures=signatures, max_bytes=args.max_parser_bytes)
    except (OSError, UnicodeDecodeError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    status = None
    if args.list:
        fields = lineage.list_udm_fields()
        print(json.dumps(fields) if args.json or args.compact_json else "\n".join(fields))
    elif args.summary or args.compact_summary:
        print(json.dumps(lineage.analysis_summary(args.compact_summary), indent=None if args.compact_summary else 2, default=str))
    elif args.compat_report:
        print(json.dumps(lineage.compat_report(args.compact_json), indent=2, default=str))
    else:
        result = lineage.query(args.field)
        status = result.status
        if args.json or args.compact_json:
            print(render_json(result, args.compact_json, args.include_pattern_bodies))
        else:
            print(render_text(result, args.verbose, None if args.verbose else 50), end="")
    return 3 if args.strict and is_strict_failure(lineage.diagnostics, status) else 0
