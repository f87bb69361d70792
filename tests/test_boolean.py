import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.functions.analysis import LETTERS, LETTERS_PORTER
from quillspark.plans.boolean import Expr, QuerySyntaxError, parse, to_postfix

GOLDEN = [
    ("SpecialAssistants AND SES", "specialassistants ses AND"),
    ("(State AND Department) NOT UNCLASSIFIED", "state department AND unclassified NOT"),
    ("(Benghazi OR Stevens) AND (call OR spoke) AND NOT number", "benghazi stevens OR call spoke OR AND number NOT AND"),
    ("Stevens NOT condolence", "stevens condolence NOT"),
    ("((Mills OR Coleman) AND Steven) NOT condolence", "mills coleman OR steven AND condolence NOT"),
    ("meeting AND schedule", "meeting schedule AND"),
    ("important OR urgent", "imp tant OR urgent OR"),
    ("report AND data", "rep t data AND OR"),
    ("conference AND NOT meeting", "conference meeting NOT AND"),
    ("email", "email"),
    ("apple banana", "apple banana AND"),
    ("foo bar AND baz", "foobar baz AND"),
    ("a (b OR c)", "a b c OR"),
    ("NOT NOT a", "a NOT NOT"),
    ("2012", ""),
    ("", ""),
    ("(foo", "foo ("),
    ("a AND (b", "a b ( AND"),
    ("a OR b) AND c", "a b OR c AND"),
]


@pytest.mark.parametrize("text,postfix", GOLDEN)
def test_postfix(text, postfix):
    assert list(parse(text, LETTERS).postfix) == postfix.split()


@pytest.mark.parametrize("text", ["2012 AND foo", "orange", "android", "and", "(NOT foo)"])
def test_underflow_is_a_syntax_error(text):
    with pytest.raises(QuerySyntaxError):
        parse(text, LETTERS)


def test_bottom_of_the_stack_is_the_result():
    assert parse("a (b OR c)", LETTERS).matches == Expr("TERM", term="a")
    assert parse("Stevens NOT condolence", LETTERS).matches == Expr("TERM", term="stevens")
    assert parse("a AND (b", LETTERS).matches == Expr("TERM", term="a")
    assert parse("2012", LETTERS).matches is None


def test_bag_has_negated_and_repeated_terms():
    assert parse("meetings AND NOT meeting", LETTERS_PORTER).bag == ("meet", "meet")


def test_strict_mode():
    assert parse("orange", LETTERS, "strict").postfix == ("orange",)
    assert parse("apple NOT banana", LETTERS, "strict").postfix == ("apple", "banana", "NOT", "AND")
    assert parse("a (b OR c)", LETTERS, "strict").postfix == ("a", "b", "c", "OR", "AND")
    for bad in ("(a", "a)", "a AND"):
        with pytest.raises(QuerySyntaxError):
            parse(bad, LETTERS, "strict")


words = st.sampled_from(["xx", "yy", "zz"])
trees = st.recursive(words, lambda t: st.one_of(t.map(lambda x: f"NOT ({x})"), st.tuples(t, st.sampled_from(["AND", "OR"]), t).map(lambda x: f"({x[0]}) {x[1]} ({x[2]})")), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(trees, st.sets(words))
def test_modes_agree_and_follow_python(text, present):
    want = eval(text.replace("AND", "and").replace("OR", "or").replace("NOT", "not"), {w: w in present for w in ("xx", "yy", "zz")})
    for mode in ("compat", "strict"):
        # Compat wants a space between a parenthesis and NOT, or it adds an AND to a query of words alone.
        q = parse(text if mode == "strict" else f"{text} OR NOT xx AND xx", LETTERS, mode)
        assert q.matches.holds(present) == want


@settings(max_examples=100, deadline=None)
@given(trees, trees, st.sets(words))
def test_de_morgan_and_double_negation(a, b, present):
    holds = lambda x: parse(x, LETTERS, "strict").matches.holds(present)
    assert holds(f"NOT (({a}) AND ({b}))") == holds(f"NOT ({a}) OR NOT ({b})")
    assert holds(f"NOT NOT ({a})") == holds(a)


def test_precedence():
    assert to_postfix("a OR b AND NOT c".split()) == ["a", "b", "c", "NOT", "AND", "OR"]
