"""Details of the compiled operators that the registered queries do not show."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import grok, patterns, services, transforms
from logweave.plans.predicate import ConditionError, parse_condition, to_column
from logweave.plans.runtime import Runtime, UnsupportedPlugin, run_parser


def run(spark, code, *messages, fields=None, **options):
    events = spark.createDataFrame([(m,) for m in messages], "message string")
    rows = run_parser(f"filter {{ {code} }}", events, Runtime(**options), fields).collect()
    return [r.asDict() for r in rows]


def one(spark, code, message, field, **options):
    return run(spark, code, message, fields=[field], **options)[0][field]


def test_null_and_empty_messages(spark):
    code = 'kv { } json { target => "j" } grok { match => { "message" => "%{INT:n}" } } csv { columns => ["c"] } dissect { mapping => { "message" => "%{d} %{e}" } } date { match => ["message", "ISO8601"] target => "t" }'
    for r in run(spark, code, None, "", fields=["a", "j.x", "n", "d", "t"]):
        assert r["a"] is None and r["j.x"] is None and r["n"] is None and r["d"] is None and r["t"] is None


def test_repeated_keys_and_separators(spark):
    assert one(spark, 'kv { field_split => "&" }', "a=1&a=2&b=3=4", "a") == "2"
    assert one(spark, 'kv { field_split => "&" }', "a=1&a=2&b=3=4", "b") == "3=4"
    assert one(spark, 'kv { prefix => "p_" trim_key => "<>" }', "<a>=1", "p_a") == "1"


def test_values_survive_other_branches(spark):
    code = 'mutate { replace => { "a" => "0" } } if [message] == "x" { mutate { replace => { "a" => "1" } } } else if [message] == "y" { mutate { remove_field => ["a"] } }'
    assert [r["a"] for r in run(spark, code, "x", "y", "z", fields=["a"])] == ["1", None, "0"]


def test_later_conditions_see_earlier_assignments(spark):
    code = 'if [message] == "x" { mutate { replace => { "a" => "1" } } } if [a] == "1" { mutate { replace => { "b" => "seen" } } } else { mutate { replace => { "b" => "no" } } }'
    assert [r["b"] for r in run(spark, code, "x", "y", fields=["b"])] == ["seen", "no"]


@pytest.mark.parametrize(("text", "want"), [('[a] == "1"', [True, False, False]), ("[a] > 1", [False, True, False]), ("![a]", [False, False, True]), ('[a] in ["1", "2"]', [True, True, False]), ("[a] =~ /^[12]$/ and not ([a] == \"2\")", [True, False, False]), ('[a] != "1"', [False, True, True]), ('"x" not in [tags]', [True, True, True]), ('[a] == "1" xor [a] == "2"', [True, True, False])])
def test_conditions(spark, text, want):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "a string")
    read = lambda f: (F.col(f), "string") if f == "a" else (F.lit(None).cast("string"), "string")
    assert [r[0] for r in df.select(to_column(parse_condition(text), read)).collect()] == want


def test_bad_conditions():
    with pytest.raises(ConditionError):
        parse_condition("[a] == ")
    with pytest.raises(ConditionError):
        parse_condition('[a] == "1" )')


def test_grok_library_compiles(spark):
    for name in grok.LIBRARY:
        body = grok.expand(name, grok.LIBRARY)
        assert body is not None or name in patterns.CISCO | patterns.HAPROXY | patterns.FIREWALLS | patterns.WEB | patterns.SERVERS | patterns.SYSLOG
    every = [grok.compile_pattern(f"%{{{name}:x}}", grok.LIBRARY)[0] for name in grok.LIBRARY]
    spark.range(1).select(*[F.lit("x").rlike(r).alias(f"c{k}") for k, r in enumerate(every)]).collect()
    assert grok.expand("A", {"A": "%{B}", "B": "%{A}"}) is None and grok.expand("NOPE", {}) is None
    with pytest.raises(grok.UnknownPattern):
        grok.compile_pattern("%{NOPE:x}", grok.LIBRARY)


#: Texts that a pattern takes whole, and texts that it does not.
TAKEN = {
    "EMAILADDRESS": (["a.b+c@x-y.example.org"], ["a@", "@x.org"]), "INT": (["-12", "+3", "0"], ["1.5", "x"]), "NUMBER": (["1", "-1.50", ".5"], ["1.", "a"]), "BASE16NUM": (["0xFFa", "12"], ["xyz"]),
    "QUOTEDSTRING": (['"a \\" b"', "'x'", "`y`", '""'], ['"a', "a"]), "UUID": (["01234567-89ab-cdef-0123-456789abcdef"], ["01234567-89ab"]), "URN": (["urn:isbn:0451450523"], ["urn:"]),
    "MAC": (["00:1A:2b:3c:4d:5e", "00-1A-2b-3c-4d-5e", "001A.2b3c.4d5e"], ["00:1A:2b"]), "IPV4": (["255.0.10.1"], ["256.1.1.1", "1.2.3"]),
    "IPV6": (["::", "::1", "fe80::1%eth0", "1:2:3:4:5:6:7:8", "1::8", "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3.4", "1:2:3:4:5:6:7::"], ["1:2:3", ":1", "12345::"]),
    "HOSTNAME": (["a", "a-b.example.com", "x1."], ["-a", ".a"]), "PATH": (["/", "/usr/lib/a-b.so", "C:\\x\\y z", "\\\\host\\share"], ["usr"]), "URI": (["https://u:p@h.org:80/a/b?c=d&e=[f]", "ftp://x"], ["//x"]),
    "MONTH": (["Jan", "January", "May", "Sep"], ["Janu", "Mai"]), "DAY": (["Mon", "Sunday"], ["Mo"]), "MONTHDAY": (["1", "09", "31"], ["0", "32"]), "TIME": (["23:59:60", "1:02:03.456"], ["24:00:00", "12:60:00"]),
    "TIMESTAMP_ISO8601": (["2024-01-31T23:59:59.123Z", "2024-01-31 23:59", "2024-01-31T23:59:59+01:00"], ["2024-13-01T00:00"]), "DATESTAMP_RFC2822": (["Mon, 02 Jan 2006 15:04:05 -0700"], ["Mon 02 Jan"]), "HTTPDATE": (["10/Oct/2000:13:55:36 -0700"], ["10/13/2000"]),
    "SYSLOGTIMESTAMP": (["Jan  2 03:04:05"], ["Jan 2024"]), "LOGLEVEL": (["info", "WARNING", "Err", "EMERGENCY"], ["iNFO", "loud"]), "JAVACLASS": (["a.b.C$D", "X"], ["1a"]), "CISCOTAG": (["ASA-4-106023"], ["ASA"]), "MAVEN_VERSION": (["1.2.3-SNAPSHOT", "1.0"], ["1"]),
}


def test_grok_bodies_accept_and_refuse(spark):
    cases = [(n, t, ok) for n, (good, bad) in TAKEN.items() for ok, ts in ((True, good), (False, bad)) for t in ts]
    regex = {n: grok.compile_pattern(f"%{{{n}}}", grok.LIBRARY)[0] for n in TAKEN}
    got = spark.range(1).select(*[F.lit(t).rlike(f"^(?:{regex[n]})$").alias(f"c{k}") for k, (n, t, _) in enumerate(cases)]).first()
    assert [c for c, g in zip(cases, got, strict=True) if g != c[2]] == []


def test_grok_log_lines(spark):
    lines = {
        "SYSLOGLINE": ("Oct 11 22:14:15 host1 su[42]: it failed", {"timestamp": "Oct 11 22:14:15", "logsource": "host1", "program": "su", "pid": "42"}),
        "SYSLOG5424LINE": ('<34>1 2003-10-11T22:14:15.003Z mymachine su 77 ID47 [a b="c"][d] text', {"syslog5424_pri": "34", "syslog5424_host": "mymachine", "syslog5424_app": "su", "syslog5424_sd": '[a b="c"][d]', "syslog5424_msg": "text"}),
        "CISCOFW106023": ('Deny tcp src outside:1.2.3.4/50 dst inside:5.6.7.8/443 by access-group "acl" [0x0, 0x0]', {"action": "Deny", "src_ip": "1.2.3.4", "dst_port": "443", "policy_id": "acl"}),
        "CISCOFW302013_302014_302015_302016": ("Teardown TCP connection 77 for out:1.1.1.1/2 to in:3.3.3.3/4 duration 0:00:30 bytes 55 TCP FINs", {"action": "Teardown", "connection_id": "77", "dst_ip": "3.3.3.3", "bytes": "55", "reason": "TCP FINs"}),
        "HAPROXYHTTP": ('Feb  6 12:14:14 lb haproxy[14389]: 10.0.1.2:33317 [06/Feb/2009:12:14:14.655] http-in static/srv1 10/0/30/69/109 200 2750 - - ---- 1/1/1/1/0 0/0 {www} {} "GET /index.html HTTP/1.1"', {"client_ip": "10.0.1.2", "server_name": "srv1", "http_status_code": "200", "http_request": "/index.html", "captured_request_headers": "www"}),
        "HTTPD24_ERRORLOG": ("[Mon Sep 09 07:08:09 2013] [core:error] [pid 9:tid 8] [client 1.2.3.4:99] AH01: gone", {"module": "core", "loglevel": "error", "pid": "9", "clientip": "1.2.3.4", "errorcode": "AH01"}),
        "ELB_ACCESS_LOG": ('2014-02-15T23:39:43.945958Z lb 1.2.3.4:2817 10.0.0.1:80 0.07 0.1 0.05 200 200 0 57 "GET http://x.com:80/p?q=1 HTTP/1.1"', {"elb": "lb", "backendip": "10.0.0.1", "path": "/p", "params": "?q=1", "verb": "GET"}),
        "SQUID3": ("1525334330.556 3 120.65.1.1 TCP_MISS/200 51 GET http://a.b/c - HIER_DIRECT/1.2.3.4 text/html", {"cache_result": "TCP_MISS", "status_code": "200", "server": "1.2.3.4", "content_type": "text/html"}),
        "RUBY_LOGGER": ("I, [2003-10-11T22:14:15.003 #1]  INFO -- prog: hi", {"pid": "1", "loglevel": "INFO", "progname": "prog"}),
        "REDISMONLOG": ('1470637867.953466 [0 195.168.1.1:52500] "SELECT" "1"', {"database": "0", "command": "SELECT", "params": '"1"'}),
    }
    tab = "\t".join
    lines |= {
        "NAGIOSLOGLINE": ("[1427925600] SERVICE ALERT: web1;HTTP;CRITICAL;HARD;3;timed out; again", {"nagios_epoch": "1427925600", "nagios_type": "SERVICE ALERT", "nagios_hostname": "web1", "nagios_service": "HTTP", "nagios_state": "CRITICAL", "nagios_attempt": "3", "nagios_message": "timed out; again"}),
        "NAGIOS_EC_LINE_SCHEDULE_HOST_DOWNTIME": ("EXTERNAL COMMAND: SCHEDULE_HOST_DOWNTIME;web1;1;2;1;0;60;ann;upgrade", {"nagios_command": "SCHEDULE_HOST_DOWNTIME", "nagios_hostname": "web1", "nagios_end_time": "2", "author": "ann", "comment": "upgrade"}),
        "BRO_CONN": (tab(["1.5", "Cx", "10.0.0.1", "4000", "10.0.0.2", "53", "udp", "dns", "0.1", "30", "60", "SF", "-", "0", "Dd", "1", "58", "1", "88", "(empty)"]), {"uid": "Cx", "resp_p": "53", "service": "dns", "tunnel_parents": "(empty)"}),
        "CLOUDFRONT_ACCESS_LOG": (tab(["2024-05-01", "10:11:12", "LHR3", "512", "10.0.0.9", "GET", "d.example.net", "/a", "200", "-", "ua", "q=1", "-", "Hit", "id1", "h.example", "https", "99", "0.012", "-", "TLSv1.3", "AES", "Hit"]), {"timestamp": "2024-05-01\t10:11:12", "clientip": "10.0.0.9", "cs_uri_stem": "/a", "x_edge_response_result_type": "Hit"}),
        "EXIM": ("2024-05-01 10:11:12 1s1abc-000dEF-Gh <= ann@example.org H=mx.example.org (helo.example) [10.0.0.9]:2525 P=esmtps S=1234 id=x@y", {"exim_msgid": "1s1abc-000dEF-Gh", "exim_sender_email": "ann@example.org", "remote_heloname": "helo.example", "remote_host": "10.0.0.9", "remote_port": "2525", "protocol": "esmtps", "exim_msg_size": "1234", "exim_header_id": "x@y"}),
        "RAILS3": ('Started GET "/users?p=1" for 10.0.0.9 at 2024-05-01 10:11:12 +0000\n  Processing by UsersController#index as HTML\n  Rendered x\nCompleted 200 OK in 35ms (Views: 20.1ms | ActiveRecord: 3.2ms)', {"verb": "GET", "request": "/users?p=1", "controller": "UsersController", "action": "index", "response": "200", "totalms": "35", "viewms": "20.1", "activerecordms": "3.2"}),
        "MCOLLECTIVE": ("I, [2024-05-01T10:11:12.123456 #77]  INFO -- : up", {"pid": "77", "event_level": "INFO"}),
        "SFW2": ("May  1 10:11:12 fw kernel: SFW2-INext-DROP-DEFLT IN=eth0 OUT= MAC=00:11:22:33:44:55:66:77:88:99:aa:bb:08:00 SRC=10.0.0.1 DST=10.0.0.2 LEN=40 PROTO=TCP SPT=1234 DPT=22 WINDOW=1", {"nf_action": "DROP-DEFLT", "nf_src_ip": "10.0.0.1", "nf_dst_ip": "10.0.0.2", "nf_protocol": "TCP", "nf_src_port": "1234", "nf_dst_port": "22"}),
        "CISCOFW313005": ("No matching connection for ICMP error message: icmp src out:10.0.0.1 dst in:10.0.0.2 (type 3, code 1) on out interface. Original IP payload: udp src 10.0.0.2/53 dst 10.0.0.1/999.", {"err_src_ip": "10.0.0.1", "err_icmp_type": "3", "interface": "out", "orig_src_port": "53", "orig_dst_ip": "10.0.0.1"}),
        "BACULA_LOGLINE": ('01-May 10:11 backup-dir JobId 12: Start Backup JobId 12, Job=nightly.2024-05-01_10.11.12_03', {"bts": "01-May 10:11", "hostname": "backup-dir", "jobid": "12", "job": "nightly.2024-05-01_10.11.12_03"}),
    }
    for name, (line, want) in lines.items():
        got = run(spark, f'grok {{ match => {{ "message" => "%{{{name}}}" }} }}', line, fields=list(want))[0]
        assert {k: got[k] for k in want} == want, name


@pytest.mark.parametrize("unit", ['"', "\\", "/", "a.", "a", "1", "1.", "a:", ":", " ", "[", "a/", "A$.", "%", "-", "a b "])
def test_long_lines_end_no_executor(spark, unit):
    """Every pattern of the library against a long line of one unit, alone and within quotes."""
    every = [grok.compile_pattern(f"%{{{name}:x}}", grok.LIBRARY)[0] for name in [*patterns.BASIC, *services.COLUMNS, *services.SENSOR, *services.MAIL, *services.WORKERS, "NAGIOSLOGLINE"] if name not in ("TIMESTAMP_ISO8601",)]
    texts = [unit * (20_000 // len(unit)), '"' + unit * (20_000 // len(unit)) + '"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for k in range(0, len(every), 10):
        df.select(*[F.col("t").rlike("^(?:" + r + ")$").alias(f"c{j}") for j, r in enumerate(every[k : k + 10])]).collect()


def test_unknown_patterns_match_nothing(spark):
    r = run(spark, 'grok { match => { "message" => "%{HAPROXYHTTPX:x} end" } on_error => "bad" }', "nonsense here end", fields=["x", "bad"])[0]
    assert (r["x"], r["bad"]) == (None, "true")


def test_grok_values(spark):
    line = '10.0.0.1 - bob [10/Oct/2000:13:55:36 -0700] "GET /x?y=1 HTTP/1.0" 200 2326'
    r = run(spark, 'grok { match => { "message" => "%{COMMONAPACHELOG}" } }', line, fields=["clientip", "auth", "verb", "request", "response", "timestamp"])[0]
    assert (r["clientip"], r["auth"], r["verb"], r["request"], r["response"]) == ("10.0.0.1", "bob", "GET", "/x?y=1", "200") and r["timestamp"].startswith("10/Oct")
    assert one(spark, 'grok { match => { "message" => "(?<a_b>[[:alpha:]]+)(?P<c>\\\\d+)" } }', "xy12", "a_b") == "xy"


def test_grok_files(tmp_path):
    (tmp_path / "a").write_text("# note\nMINE [a-z]+\n")
    (tmp_path / "b").write_text("MINE [0-9]+\n")
    assert grok.load_libraries([str(tmp_path)]) == {"MINE": "[0-9]+"}


def test_dissect_padding_and_skips():
    regex, fields = transforms.dissect_regex("%{a->} [%{?x}] %{+a} %{&k}")
    assert [f[:2] for f in fields] == [("plain", "a"), ("append", "a"), ("indirect", "k")] and regex.endswith("$")


def test_dates(spark):
    code = 'date { match => ["message", "UNIX_MS", "MMM dd yyyy HH:mm:ss", "ISO8601"] target => "t" timezone => "UTC" }'
    got = [str(r["t"]) for r in run(spark, code, "1000", "Jan 02 2020 03:04:05", "2020-01-02T03:04:05Z", "nonsense", fields=["t"])]
    assert got == ["1970-01-01 00:00:01", "2020-01-02 03:04:05", "2020-01-02 03:04:05", "None"]


def test_unsupported_plugins(spark):
    with pytest.raises(UnsupportedPlugin):
        run(spark, "mystery { }", "x")
    assert run(spark, 'mystery { } mutate { replace => { "a" => "1" } }', "x", skip_unsupported=True)[0]["a"] == "1"
    assert one(spark, "mystery { }", "x", "m", plugins={"mystery": lambda df, config, guard: df.withColumn("m", F.upper("message"))}) == "X"


def test_dialects_and_probability(spark):
    assert one(spark, 'memcached { key => "message" target => "v" }', "x", "v") is None
    kept = len(run(spark, "drop { percentage => 30 }", *["x"] * 1000))
    assert 600 < kept < 800


def test_addresses(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("300.1.1.1",), (None,), ("x",)], "a string")
    assert [r[0] for r in df.select(transforms.ip_number(F.col("a"))).collect()] == [10 * 2**24 + 1 * 65536 + 2 * 256 + 3, None, None, None]
    assert [r[0] for r in df.select(transforms.in_network(F.col("a"), "10.0.0.0/8")).collect()] == [True, False, False, False]


def test_range_lookup_is_an_equi_join(spark):
    from logweave.operators.lookups import range_lookup

    ranges = spark.createDataFrame([(0, 70_000, "low"), (200_000, 200_000, "one")], "low long, high long, name string")
    events = spark.createDataFrame([(0,), (65_536,), (70_000,), (70_001,), (200_000,), (None,)], "n long")
    for limit in (1000, 0):
        out = range_lookup(events, ranges, "n", {"name": "name"}, limit)
        assert {r["n"]: r["name"] for r in out.collect()} == {0: "low", 65_536: "low", 70_000: "low", 70_001: None, 200_000: "one", None: None}
        assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
