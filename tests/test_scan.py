from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.functions import text as T
from codeloom.functions.scan import evaluate, literal, mask, parse_flag, tokens, variants

CODE = st.text(alphabet="ab'-/*q[]\n\r $\"(){}<>;:=.1Nn", max_size=60)


@settings(max_examples=300, deadline=None)
@given(CODE)
def test_mask_keeps_length_and_lines(s):
    m = mask(s)
    assert len(m) == len(s)
    assert [i for i, c in enumerate(m) if c in "\r\n"] == [i for i, c in enumerate(s) if c in "\r\n"]


@settings(max_examples=300, deadline=None)
@given(CODE)
def test_tokens_and_comments_cover_what_is_not_blank(s):
    found, comments = tokens(s)
    covered = set()
    for x in [*found, *comments]:
        covered |= set(range(x.start, x.end))
    assert all(s[i].isspace() or i in covered for i in range(len(s)))


def test_mask_by_example():
    assert mask("a -- b\nc /* d */ 'x''y' q'[it's]' z") == "a     \nc" + " " * 9 + "'    '" + " " * 11 + "z"
    assert mask(None) is None and mask("") == ""


def test_literals():
    assert [literal(x) for x in ("'a''b'", "N'x'", "q'[it's]'", "nq'{a}'", "''")] == ["a'b", "x", "it's", "a", ""]


def test_variants_keep_lines_and_take_opposite_branches():
    text = "begin\r\n$if $$trace $then\r\n  log;\r\n$else\r\n  skip;\r\n$end\r\nend;"
    one, two = variants(text)
    assert [one.name, two.name] == ["primary", "alternate"]
    assert one.text.count("\n") == two.text.count("\n") == text.count("\n") and len(one.text) == len(text)
    assert "skip" in one.text and "log" not in one.text and "log" in two.text and "skip" not in two.text


def test_decided_conditions_give_one_variant():
    v = variants("$if dbms_db_version.ver_le_10 $then old $else new $end")
    assert len(v) == 1 and v[0].text.split() == ["new"]
    assert len(variants("$if $$x is null or not $$x $then a $end")) == 2
    assert len(variants("$if $$x $then a $else b $end", {"x": False})) == 1
    assert variants("-- $if x\n'$else' y")[0].text == "-- $if x\n'$else' y"


def test_error_directive_and_strays():
    v = variants("$if $$a $then $error 'no' $end x $end y", {"a": True})
    assert v[0].text.split() == ["x", "y"] and v[0].issues
    assert variants("$else a $end")[0].issues


def test_three_valued_conditions():
    assert evaluate("null or true") == (True, True)
    assert evaluate("null and false") == (False, True)
    assert evaluate("$$n > 2", {"n": 3.0}) == (True, True)
    assert evaluate("$$zz") == (None, False) and evaluate("((") == (None, False)
    assert evaluate("not 1 = 1") != (True, True)
    assert [parse_flag(x) for x in ("A", "b=false", "c=3", "d=x")] == [("a", True), ("b", False), ("c", 3.0), ("d", "x")]


def test_comments():
    assert T.clean_comment("/* Purpose: adds one\n * to it.\n *\n * Parameters: none */") == "adds one to it."
    assert T.clean_comment("-- ====\n-- first\n-- Returns: x") == "first"
    assert T.clean_comment(None) == ""
    assert T.to_ascii("a → b … ≥ 3") == "a -> b ... >= 3"
