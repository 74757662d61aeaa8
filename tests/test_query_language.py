"""Tokens, postfix order and errors of the query language."""

import pytest

from geoloom.plans.query_language import QuerySyntaxError, to_postfix, tokenise


def postfix(text, compat=False):
    return [t.value for t in to_postfix(tokenise(text), compat)]


def test_postfix():
    assert postfix(".a == 1 and .b > 2") == [("a",), 1, "==", ("b",), 2, ">", "and"]
    assert postfix(".a or .b and .c") == [("a",), ("b",), "or", ("c",), "and"]
    assert postfix(".a and (.b or .c)") == [("a",), ("b",), ("c",), "or", "and"]
    assert postfix(".a exists and .b exists") == [("a",), "exists", ("b",), "exists", "and"]
    assert postfix(".a and .b not", compat=True) == [("a",), ("b",), "and", "not"]
    assert postfix("not .a == 1") == [("a",), 1, "==", "not"]
    assert postfix(".a.[0].\"x y\" in [1, 'b' c]") == [("a", 0, "x y"), (1, "b", "c"), "in"]
    assert postfix(".a =~ /x\\/y/i") == [("a",), "(?i)x/y", "=~"]


@pytest.mark.parametrize("bad", ["(.a", ".a)", ".a ==", ".a in 3", "'x", ".a in [1", "near(1, 2)", ".a =~ /x"])
def test_errors(bad):
    with pytest.raises(QuerySyntaxError):
        to_postfix(tokenise(bad))
