import json

import pytest

from logweave.cli import main
from logweave.operators import registry
from logweave.operators.query import ParserLineage, candidates
from logweave.queries import ROUTING
from logweave.render import render_json, render_text


def ask(code, field, **options):
    return ParserLineage(f"filter {{ {code} }}", **options).query(field)


def codes(code, **options):
    return {d.code for d in ParserLineage(f"filter {{ {code} }}", **options).diagnostics}


def kinds(result):
    return [s.kind for m in result.mappings for s in m.sources]


def test_conditions_of_a_chain():
    r = ParserLineage(ROUTING).query("security_result.action")
    assert r.status == "conditional" and [m.expression for m in r.mappings] == ["ALLOW", "BLOCK", "UNKNOWN_ACTION"]
    assert r.mappings[2].conditions == ('NOT([action] == "purchase")', 'NOT([action] == "error" or [action] == "signup")')


def test_grok_capture_through_merge():
    r = ask('grok { match => { "message" => "ip=%{IP:addr}" } } mutate { merge => { "event.idm.read_only_udm.target.ip" => "addr" } } mutate { merge => { "@output" => "event" } }', "target.ip")
    assert r.status == "derived" and kinds(r) == ["grok_capture"] and r.mappings[0].transformations == ("merge",)
    assert ask('grok { match => { "message" => "%{IP:addr}" } } mutate { replace => { "x" => "%{addr}" } }', "x").status == "exact_capture"


def test_extractors():
    assert kinds(ask('json { source => "message" } mutate { replace => { "x" => "%{a.b}" } }', "x")) == ["json_path"]
    assert kinds(ask('json { source => "message" target => "doc" } mutate { replace => { "x" => "%{doc.a}" } }', "x")) == ["json_path"]
    assert ask('kv { include_keys => ["a"] } mutate { replace => { "x" => "%{b}" } }', "x").status == "unresolved"
    r = ask('csv { columns => ["c1", "c2"] }', "c2")
    assert r.mappings[0].sources[0].column == 2
    assert kinds(ask('csv { } mutate { replace => { "x" => "%{column3}" } }', "x")) == ["csv_column"]
    assert kinds(ask('xml { xpath => { "/a/b" => "x" } }', "x")) == ["xml_xpath"]
    r = ask('dissect { mapping => { "message" => "%{a} %{+a} %{?s} %{&i}" } }', "a")
    assert r.status == "derived" and r.mappings[0].transformations == ("dissect_append",)
    assert "dissect_indirect" in codes('dissect { mapping => { "message" => "%{&i}" } }')


def test_mutate_operations():
    base = 'kv { } mutate { replace => { "x" => "%{a}" } } '
    for op, label in {'convert => { "x" => "integer" }': "convert(integer)", 'lowercase => ["x"]': "lowercase", 'split => { "x" => "," }': "split(separator=',')", 'join => { "x" => "-" }': "join(separator='-')", 'gsub => ["x", "a", "b"]': "gsub(pattern='a', replacement='b')"}.items():
        assert label in ask(base + f"mutate {{ {op} }}", "x").mappings[0].transformations
    assert ask(base + 'mutate { remove_field => ["x"] }', "x").status == "removed"
    assert ask('mutate { update => { "nope" => "1" } }', "nope").status == "unresolved"
    assert ask(base + 'mutate { rename => { "x" => "y" } }', "y").mappings[0].transformations == ("rename",)
    assert not ask(base + 'mutate { rename => { "x" => "y" } }', "x").mappings or ask(base + 'mutate { rename => { "x" => "y" } }', "x").mappings[0].sources[0].kind == "kv_key"
    assert ask('mutate { replace => { "u.n" => "A" } } mutate { copy => { "u" => "t" } }', "t.n").mappings[0].expression == "A"
    assert ask('mutate { replace => { "a" => "1" "b" => "2" } } mutate { merge => { "l" => "a" } } mutate { merge => { "l" => "b" } }', "l").status == "repeated"


def test_templates_multiply_and_fold():
    r = ask('if [k] == "1" { mutate { replace => { "a" => "x" } } } else { mutate { replace => { "a" => "y" } } } mutate { replace => { "b" => "<%{a}>" } }', "b")
    assert sorted(m.expression for m in r.mappings) == ["<x>", "<y>"] and r.status == "conditional"
    r = ask('mutate { replace => { "n" => "principal" } } mutate { replace => { "event.%{n}.ip" => "1" } }', "event.principal.ip")
    assert r.mappings[0].expression == "1"
    r = ask('kv { } mutate { replace => { "event.%{n}.ip" => "1" } }', "event.target.ip")
    assert r.status == "dynamic"


def test_branches():
    assert "unreachable_branch" in codes('if [a] == "x" { mutate { replace => { "t" => "1" } } } else if [a] == "x" { mutate { replace => { "t" => "2" } } }')
    r = ask('if [a] == "x" { mutate { replace => { "t" => "1" } } }', "t")
    assert r.status == "partial" and any("not assigned on this branch path" in m.notes for m in r.mappings)
    r = ask('if [a] == "x" { drop { } } mutate { replace => { "t" => "1" } }', "t")
    assert r.mappings[0].conditions == ('NOT(drop path: [a] == "x")',)
    assert "unreachable_branch" in codes('grok { match => { "message" => "%{INT:n}" } } if [n] == "abc" { mutate { replace => { "t" => "1" } } }')
    assert "unreachable_branch" in codes('mutate { add_tag => ["x"] } if "y" in [tags] { mutate { replace => { "t" => "1" } } }')


def test_loops():
    r = ask('json { } for a in alerts { mutate { merge => { "names" => "a.name" } } }', "names")
    assert r.mappings[0].sources[0].path == "alerts[*].name" and "for a in alerts" in r.mappings[0].conditions
    r = ask('for x in ["p", "q"] { mutate { replace => { "t.%{x}" => "%{x}" } } }', "t.q")
    assert r.mappings[0].expression == "q" and not r.mappings[0].conditions
    assert "map_key" in kinds(ask('json { } for k, v in m map { mutate { replace => { "t" => "%{k}" } } }', "t"))


def test_failures():
    code = 'grok { match => { "message" => "%{INT:n}" } } if "_grokparsefailure" in [tags] { mutate { replace => { "t" => "1" } } }'
    assert "unreachable_branch" not in codes(code) and "conditional_tag_check" in codes(code, dialect="logstash")
    assert "unreachable_branch" in codes('mutate { add_tag => ["other"] } ' + code)
    assert kinds(ask('json { on_error => "bad" }', "bad")) == ["error_flag"]
    r = ask('json { } on_error { mutate { replace => { "t" => "1" } } }', "t")
    assert any("on_error" in m.conditions for m in r.mappings)


def test_other_plugins():
    assert "date(ISO8601)" in ask('kv { } date { match => ["a", "ISO8601"] target => "t" }', "t").mappings[0].transformations
    assert [m.expression for m in ask('mutate { replace => { "p" => "165" } } syslog_pri { source => "p" }', "p_severity").mappings] == ["notice"]
    assert ask('kv { } translate { field => "a" destination => "t" dictionary => { "x" => "y" } }', "t").status == "derived"
    assert ask('kv { } translate { field => "a" destination => "t" dictionary_path => "f.yml" }', "t").status == "dynamic"
    assert "geoip" in kinds(ask('kv { } geoip { source => "ip" target => "geo" }', "geo"))
    assert "plugin_dialect_disabled" in codes("memcached { }") and "plugin_dialect_disabled" not in codes("memcached { }", dialect="logstash")
    assert "ruby_get" in kinds(ask("ruby { code => \"event.set('t', event.get('a'))\" }", "t"))
    assert {"ruby_event_cancel", "ruby_concurrency_risk"} <= codes('ruby { code => "@@n = 1; event.cancel" }')
    assert "aggregate_state" in codes('aggregate { task_id => "%{id}" code => "map[\'n\'] = 1" }')
    assert sorted(m.expression for m in ask('clone { clones => ["a", "b"] }', "type").mappings if m.status != "unresolved") == ["a", "b"]
    assert "unsupported_plugin" in codes("mystery { }")
    sig = {"mystery": registry.Signature("mystery", source_keys=("source",), dest_keys=("target",))}
    assert ask('mystery { source => "message" target => "t" }', "t", signatures=sig).status == "dynamic"


def test_every_plugin_runs_in_both_dialects():
    for name in registry.CLASS_OF:
        for d in registry.DIALECTS:
            codes(f'{name} {{ source => "message" field => "message" target => "t" match => {{ "message" => "x" }} add_tag => ["y"] add_field => {{ "f" => "1" }} }}', dialect=d)


def test_order_of_dialects():
    code = 'mutate { uppercase => ["x"] replace => { "x" => "a" } }'
    assert not ask('mutate { replace => { "x" => "0" } } ' + code, "x").mappings[0].transformations
    assert ask('mutate { replace => { "x" => "0" } } ' + code, "x", dialect="logstash").mappings[0].transformations == ("uppercase",)


def test_candidates():
    assert candidates("target.ip", ["event1"]) == ["target.ip", "event.target.ip", "event.idm.read_only_udm.target.ip", "event1.target.ip", "event1.idm.read_only_udm.target.ip", "idm.read_only_udm.target.ip"]


def test_bad_input():
    with pytest.raises(TypeError):
        ParserLineage(None)
    with pytest.raises(ValueError):
        ParserLineage("", dialect="other")
    with pytest.raises(ValueError):
        ParserLineage("x" * 100, max_bytes=10)
    with pytest.raises(TypeError):
        ParserLineage("").query(3)


def test_reports_and_renderers():
    p = ParserLineage(ROUTING)
    assert p.list_udm_fields() == ["event.idm.read_only_udm.security_result.action"]
    assert p.analysis_summary()["output_anchors"][0]["anchor"] == "event"
    assert p.compat_report()["status_counts"]["conditional"] == 3
    r = p.query("security_result.action")
    assert "status=conditional" in render_text(r, True) and json.loads(render_json(r))["status"] == "conditional"
    assert json.loads(render_json(p.query("nothing.here")))["hint"]["code"] == "query_no_match"
    assert "\x1b" not in render_text(ask('mutate { replace => { "x" => "\x1b[1m" } }', "x"))


def test_command_line(tmp_path, capsys):
    f = tmp_path / "p.cbn"
    f.write_text(ROUTING)
    assert main([str(f), "security_result.action"]) == 0 and main([str(f), "--list"]) == 0 and main([str(f), "--summary"]) == 0 and main([str(f), "--compat-report"]) == 0
    assert main([str(f)]) == 2 and main([str(tmp_path), "x"]) == 1 and main([str(f), "nothing", "--strict"]) == 3
    assert main([str(f), "x", "--compact-json"]) == 0
    capsys.readouterr()


def test_signature_files(tmp_path):
    (tmp_path / "s.toml").write_text('[lookup]\nname = "lookup"\nsource_keys = ["source"]\ndest_keys = ["target"]\n')
    assert registry.load_signatures(str(tmp_path))["lookup"].dest_keys == ("target",)
    (tmp_path / "t.toml").write_text('[a]\nname = "b"\n')
    with pytest.raises(ValueError):
        registry.load_signatures(str(tmp_path))


def test_scaling_shapes():
    import time

    import bench

    for code in bench.parsers_of(2000).values():
        began = time.time()
        ParserLineage(code).analyze()
        assert time.time() - began < 10


def test_captures_below_plain_references():
    from logweave.functions import grok

    library = {"A": "%{B}%{B}", "B": "%{C}", "C": r"(?<x>\d)%{A}", "LOOP": "%{LOOP}%{LOOP}"} | {f"N{k}": f"%{{N{k + 1}}}%{{N{k + 1}}}" for k in range(31)}
    assert [c.token for c in grok.captures("%{A:y}", library)] == ["y", "x"]
    assert grok.captures("%{LOOP}%{N0}", library) == []


def test_lists_decide_branches():
    from logweave.operators.facts import compatible

    among, single = '[n] in ["A", "B"]', '[n] == "C"'
    assert not compatible((among, single)) and compatible((among, '[n] == "B"')) and compatible((f"NOT({among})", single))
    assert not compatible((f"NOT({among})", '[n] == "B"')) and not compatible(('[n] not in ["A"]', '[n] == "A"')) and not compatible((among, "[n] =~ /^C/"))
