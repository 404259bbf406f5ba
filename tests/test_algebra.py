import re

from hypothesis import given, settings
from hypothesis import strategies as st

from logweave.operators import algebra as A
from logweave.operators.facts import compatible

PIECE = st.sampled_from(["a", "b", "[ab]", "[^a]", ".", "a*", "b+", "a?", "(?:ab|b)", "(a|bc){1,2}", "\\d", "\\w"])
PATTERN = st.tuples(st.sampled_from(["", "^"]), st.lists(PIECE, min_size=1, max_size=4), st.sampled_from(["", "$"])).map(lambda t: t[0] + "".join(t[1]) + t[2])
TEXT = st.text(alphabet="abc1\n", max_size=6)


@settings(max_examples=300, deadline=None)
@given(PATTERN, TEXT)
def test_membership_is_search(pattern, text):
    assert A.contains(pattern, text) == bool(re.search(pattern, text))


@settings(max_examples=150, deadline=None)
@given(PATTERN, PATTERN, TEXT)
def test_relations_agree_with_texts(p, q, text):
    inside = bool(re.search(p, text)), bool(re.search(q, text))
    if A.disjoint(A.language(p), A.language(q)) is True:
        assert inside != (True, True)
    if A.subset(A.language(p), A.language(q)) is True:
        assert inside != (True, False)


def test_known_relations():
    assert A.disjoint(A.language("^a+$"), A.language("^b+$")) is True
    assert A.subset(A.language("^ab$"), A.language("^a")) is True
    assert A.disjoint(A.language("a"), A.language("b")) is False
    assert A.language("(?i)a") is None and A.language("a" * 600) is None
    assert A.contains("^x$", "x\n") is True  # $ admits a final newline


def test_conditions():
    assert not compatible(('[a] == "x"', 'NOT([a] == "x")'))
    assert not compatible(('[a] == "x"', '[a] == "y"'))
    assert not compatible(("[a] =~ /^1/", "[a] =~ /^2/"))
    assert compatible(('[a] == "x" or [b] == "y"', 'NOT([a] == "x")'))
    assert not compatible(('[a] == "x" or [a] == "y"', '[a] != "x"', '[a] != "y"'))
    assert compatible(("something [odd", 'NOT([a] == "x")'))
    assert compatible(('[a] != "x"', '[a] != "y"'))
