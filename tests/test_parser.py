import pytest

from keyloom.engine import modifiers
from keyloom.plans.lexer import QuerySyntaxError, lex
from keyloom.plans.parser import postfix_text


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("russia 1764", "russia 1764 |"),
        ("a & b | c", "a b c | &"),
        ("science & year < 1900", "science year 1900 < &"),
        ("a ! b", "a b !"),
        ("g:v(person).has(gender,male).out(father).by(subject)", "person V gender male , HAS father OUT subject BY . . ."),
        ("g:has(type,Sale).in(Buyer).lt(age,21)", "type Sale , HAS Buyer IN age 21 , LT . ."),
        ("g:v(x).where{a / b > -5}", "x V {a b / -5 >} WHERE ."),
        ("(range >= 300) && (price <= 60000)", "range 300 >= price 60000 <= &&"),
        ("'two words' OR one", "two words one OR"),
    ],
)
def test_postfix(query, expected):
    assert postfix_text(query) == expected


@pytest.mark.parametrize("query", ["(a", "a)", "g:v(x).where{a", "g:v(x)}"])
def test_unbalanced(query):
    with pytest.raises(QuerySyntaxError) as error:
        postfix_text(query)
    assert error.value.messages


def test_lexer_signs_and_quotes():
    assert [t.text for t in lex("lt(age,-5)")] == ["lt", "(", "age", ",", "-5", ")"]
    assert [t.kind for t in lex("“a b” 1.5")] == ["literal", "number"]


def test_modifiers():
    text, m = modifiers("science nature OVER 0.5 under 2 ranked")
    assert text == "science nature" and m.ranked and m.over == 0.5 and m.under == 2.0
