from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.plans.syntax import Bare, For, If, Io, Pairs, Plugin, Regex, Unknown, field_name, parse, strip_comments, unescape


def only(code):
    p = parse(code)
    assert not p.diagnostics
    return p.statements[0]


def test_configuration_values():
    c = only('filter { x { a => "q\\"s" b => [1, "two", three] c => { "k" => "v" k => w } flag d = true r => /a\\/b[/]/ } }').config
    assert c.first("a") == 'q"s' and c.first("b") == ["1", "two", "three"] and c.first("c") == Pairs([("k", "v"), ("k", "w")])
    assert c.first("flag") is True and c.first("d") is True and c.first("r") == "a\\/b[/]"


def test_duplicate_keys_are_kept():
    assert only('mutate { replace => { "a" => "1" } replace => { "b" => "2" } }').config.all("replace") == [[("a", "1")], [("b", "2")]]


def test_else_if_forms_are_one():
    a, b = (only(f'if [a] == "1" {{ x {{ }} }} {w} [a] == "2" {{ y {{ }} }} else {{ z {{ }} }}') for w in ("else if", "elsif"))
    assert isinstance(a, If) and [m.condition for m in a.arms] == [m.condition for m in b.arms] == ['[a] == "1"', '[a] == "2"']
    assert a.otherwise[0].name == b.otherwise[0].name == "z"


def test_loops_and_blocks():
    f = only("for i, x in items map { y { } }")
    assert isinstance(f, For) and f.variables == ["i", "x"] and f.is_map and f.iterable == "items"
    io = only('input { kafka { topics => ["a"] } }')
    assert isinstance(io, Io) and io.body[0].name == "kafka"


def test_comments_keep_places():
    text = 'a { # one "\n b => "x # y" // two\n c => "http://h/p" /* three\n */ }'
    assert len(strip_comments(text)) == len(text) and strip_comments(text).count("\n") == text.count("\n")
    assert only(text).config == Pairs([("b", "x # y"), ("c", "http://h/p")])


def test_recovery_goes_on_behind_what_it_cannot_read():
    p = parse('filter { ??? garbage\n mutate { replace => { "a" => "b" } } }')
    assert p.diagnostics and any(isinstance(s, Unknown) for s in p.statements) and any(isinstance(s, Plugin) and s.name == "mutate" for s in p.statements)


def test_lines_are_counted_from_one():
    assert [s.line for s in parse("a { }\n\nb { }").statements] == [1, 3]


def test_field_names():
    for raw, name in {"%{x}": "x", "[a][b]": "a.b", "a[0][n]": "a.0.n", '["a"]["b c"]': "a.b c", "plain.name": "plain.name"}.items():
        assert field_name(raw) == name


def test_escapes():
    assert unescape(r"a\n\x41B\q\\") == "a\nAB\\q\\"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet='abif{}[]()"\'/\\=><~!,# \n%elsrn', max_size=120))
def test_never_raises(text):
    parse(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.from_regex(r"[a-z][a-z_]{0,8}", fullmatch=True), st.text(alphabet=st.characters(codec="ascii", exclude_characters='"\\'), max_size=12), max_size=5))
def test_strings_come_back(values):
    body = " ".join(f'{k} => "{v}"' for k, v in values.items())
    assert dict(only(f"plug {{ {body} }}").config) == values


def test_bare_words():
    assert isinstance(only("x { a => word }").config.first("a"), Bare)


def test_unquoted_paths_are_no_regexes():
    c = only('mutate { replace => { p => /opt_{/data/} q => /opt/log/app r => /spool/app_{day}/ u => https://a:b@h.example:1/x#part "z" => "1" } m => /x[/]y/ } # end').config
    assert c.first("replace") == [("p", "/opt_{/data/}"), ("q", "/opt/log/app"), ("r", "/spool/app_{day}/"), ("u", "https://a:b@h.example:1/x#part"), ("z", "1")]
    assert isinstance(c.first("m"), Regex) and c.first("m") == "x[/]y"


def test_regexes_over_lines():
    s = only("if [m] =~ /one\n  two \\{\n three/ { x { } }")
    assert s.arms[0].condition == "[m] =~ /one\n  two \\{\n three/" and s.arms[0].body[0].name == "x"
    assert only("if [m] =~ /a  b/  and  [n] == 1 { x { } }").arms[0].condition == "[m] =~ /a  b/ and [n] == 1"


def test_paths_that_end_in_a_backslash():
    c = only('mutate { add_field => { "n" => "%{o}" }\n split => { "n" => "\\" }\n join => { "n" => "C:\\dir\\" }\n x => "a\\"b" }').config
    assert c.first("split") == [("n", "\\")] and c.first("join") == [("n", "C:\\dir\\")] and c.first("x") == 'a"b'


def test_loops_over_references():
    f = only("for k, v in %{items} { y { } }")
    assert isinstance(f, For) and f.iterable == "%{items}" and f.body[0].name == "y"


def test_a_block_without_an_end_hides_only_itself():
    p = parse('filter {\n if [a] == "1" {\n mutate { replace => {\n "k" => "v"\n mutate {\n replace => { "b" => "1" }\n }\n}\n')
    assert p.diagnostics and not any(s.diagnostics for s in p.statements if isinstance(s, Plugin))
    assert parse("x {\n" * 3000).diagnostics
