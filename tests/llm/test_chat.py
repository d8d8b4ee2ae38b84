import random

import pytest

from tablelens.llm.chat_format import CONTROL, TEMPLATE, escape, format_conversations, read_back, unescape
from tablelens.llm.chat_template import TemplateError, compile_template, fold, parse

COLUMNS = "conv_id long, turn long, role string, text string, formatted string, mask string"


def test_escaping_is_reversible_and_leaves_no_control_string():
    pick = random.Random(2)
    pool = [*CONTROL, "\\", "\\\\", "<", "[", "/", "|", "s>", "INST]", "a", " ", "\n", "é"]
    for _ in range(3000):
        text = "".join(pick.choice(pool) for _ in range(pick.randint(0, 12)))
        safe = escape(text)
        assert unescape(safe) == text and not any(c in safe for c in CONTROL)


def test_round_trip_of_turns_mask_and_length(spark):
    pick = random.Random(4)
    pool = [*CONTROL, "\\", "ok", " ", "\n", "é", "😀", ""]
    talks = {}
    for c in [None, -7, 0, 1, 2, 3, 40]:
        n = 3000 if c == 40 else pick.randint(1, 6)
        talks[c] = [(t, pick.choice(["user", "assistant", "system", "<|end|>"]), "".join(pick.choice(pool) for _ in range(6))) for t in range(n)]
    rows = [(c, t, role, text, "x", "y") for c, turns in talks.items() for t, role, text in turns]
    pick.shuffle(rows)
    made = format_conversations(spark.createDataFrame(rows, COLUMNS).repartition(4))
    back = {r.conv_id: r for r in read_back(made).collect()}
    assert set(back) == set(talks)
    for c, turns in talks.items():
        assert [tuple(t) for t in back[c].turns] == [(role, text) for _, role, text in turns]
        assert back[c].loss_text == "".join(text for _, role, text in turns if role == "assistant")
    whole = {r.conv_id: r for r in made.collect()}
    assert all(back[c].formatted_chars == len(whole[c].formatted) for c in talks)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None, "user", "last", "", ""), (1, 0, None, None, "", ""), (1, 0, "user", "b", "", ""), (1, 0, "user", "a", "", ""), (1, 0, "user", "a", "", "")]
    [r] = read_back(format_conversations(spark.createDataFrame(rows, COLUMNS))).collect()
    assert [tuple(t) for t in r.turns] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b"), ("user", "last")]
    assert format_conversations(spark.createDataFrame([], COLUMNS)).count() == 0


def test_template_language():
    render = compile_template("{% set n = 'x' ~ 1 %}{% for m in ms %}{{ loop.index }}{% if m.a == n and not loop.last %}!{% elif loop.last %}.{% else %}-{% endif %}{{ m['b'] | upper }}{% endfor %}{{ n }}")
    assert render(ms=[{"a": "x1", "b": "é"}, {"a": "y", "b": None}, {"a": "x1", "b": "z"}]) == ("1!É2-3.Zx1", [])
    text, spans = compile_template("a{% generation %}b{{ c }}{% endgeneration %}d{% generation %}{% endgeneration %}")(c="éé")
    assert text == "abééd" and spans == [(1, 4), (5, 5)]


def test_constants_are_folded():
    filters = {"upper": str.upper}
    tree = fold(parse("a{{ 'b' ~ 1 | upper if_ }}" .replace(" if_", "").replace("1 | upper", "'c' | upper")), filters)
    assert [p.parts[0].value for p in tree.parts] == ["abC"]
    assert fold(parse("{% if 1 == 2 %}x{% else %}y{% endif %}z"), filters).parts[0].parts[0].value == "yz"
    assert [p.kind for p in fold(parse(TEMPLATE), {"escape": escape}).parts] == ["write", "for", "write"]


@pytest.mark.parametrize("source", ["{% for x in %}{% endfor %}", "{% if a %}", "{{ a | nothing }}", "{{ a( }}", "{% import os %}", "{{ a b }}", "{{ 1 + 'x' }}"])
def test_wrong_templates_are_refused(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_templates_reach_nothing_but_what_they_are_given():
    with pytest.raises(TemplateError):
        compile_template("{{ a.__class__ }}")(a="text")
    with pytest.raises(TemplateError):
        compile_template("{{ open }}")()
    assert compile_template("{{ a.__class__ }}")(a={}) == ("", [])
