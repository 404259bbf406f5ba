"""The corpus tables against the analysis of single parsers, and sources of parsers."""

import json

from logweave.operators import corpus
from logweave.operators.query import ParserLineage
from logweave.queries import CASES, ROUTING
from logweave.render import audit_markdown


def test_read_and_analyze(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.cbn").write_bytes(b"\xef\xbb\xbf" + ROUTING.encode())
    (tmp_path / "b.cbn").write_text("filter { mystery { } broken")
    (tmp_path / "c.txt").write_text("not a parser")
    parsers = corpus.read_parsers(spark, str(tmp_path))
    assert parsers.count() == 2 and not any(r["code"].startswith("﻿") for r in parsers.collect())
    raw = corpus.stored(corpus.analyze_corpus(parsers, ("secops", "logstash")))
    kinds = {r["kind"] for r in raw.select("kind").distinct().collect()}
    assert {"lineage", "anchor", "diagnostic", "hint"} <= kinds
    assert "unsupported_plugin" in audit_markdown([r.asDict() for r in corpus.audit_totals(raw).collect()])
    for r in raw.collect():
        json.loads(r["payload"])


def test_queries_equal_single_analyses(spark):
    rows = [(name, case.code) for name, case in sorted(CASES.items())[:25]] + [("null", None), ("empty", "")]
    raw = corpus.stored(corpus.analyze_corpus(spark.createDataFrame(rows, "path string, code string")))
    fields = ["who", "security_result.action", "lane", "tags", "nothing"]
    results, _ = corpus.query_fields(raw, fields)
    got = {(r["path"], r["udm_field"]): (r["status"], r["mappings"], r["is_conditional"], r["has_dynamic"], r["has_taints"]) for r in results.collect()}
    for name, code in rows:
        for f in fields:
            q = ParserLineage(code or "").query(f)
            if (name, f) in got:
                assert got[name, f] == (q.status, len(q.mappings), q.is_conditional, q.has_dynamic, q.has_taints), (name, f)
    listed = {(r["path"], r["udm_field"]) for r in corpus.list_udm_fields(raw).collect()}
    assert listed == {(name, f) for name, code in rows for f in ParserLineage(code or "").list_udm_fields()}


def test_failures_are_rows(monkeypatch):
    def broken(*args, **options):
        raise RuntimeError("no")

    monkeypatch.setattr(corpus, "ParserLineage", broken)
    assert json.loads(corpus.analyzed_rows("p", "", "secops", {})[0][4])["code"] == "audit_error"


def test_a_source_that_is_too_large_is_a_diagnostic(spark, tmp_path):
    (tmp_path / "a.cbn").write_text('filter { mutate { replace => { "a" => "1" } } }')
    (tmp_path / "b.cbn").write_text("# " + "x" * 1000)
    found = corpus.read_parsers(spark, str(tmp_path), max_bytes=500)
    rows = {r["path"].rsplit("/", 1)[1]: (r["code"], r["problem"]) for r in found.collect()}
    assert rows["a.cbn"][1] is None and rows["b.cbn"] == (None, "the source has more than 500 bytes")
    told = corpus.corpus_table(corpus.analyze_corpus(found), "diagnostic").where("code = 'source_unreadable'").collect()
    assert [r["path"].rsplit("/", 1)[1] for r in told] == ["b.cbn"]
    assert corpus.corpus_table(corpus.analyze_corpus(found), "diagnostic").where("code = 'audit_error'").count() == 0


def test_compact_queries_and_exports():
    import logweave

    code = "filter { kv { } " + "".join(f'if [k] == "{k}" {{ mutate {{ replace => {{ "t" => "{k}" }} }} }}' for k in range(60)) + " }"
    p = logweave.ParserLineage(code)
    full, few = p.query("t"), p.query("t", compact=True, sample_limit=7)
    assert few.status == full.status and len(few.to_json()["mappings"]) == 7 and few.to_json()["mappings_total"] == len(full.mappings) == len(full.to_json()["mappings"])
    assert len(p.query("t", compact=True, sample_limit=1000).to_json()["mappings"]) == 50
    assert all(getattr(logweave, n) for n in logweave.__all__)
