"""Chat formatting: the grammar round trip and the table form against plain Python."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fixtures import LONG
from tablegauge.llm import chatformat as C

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "<", "[", "\\", "/", " ", "]", ">", "s>", "INST]", "\n", "a", "漢", "😀", "[\\INST]", "<\\\\/s>"]
texts = st.lists(st.sampled_from(PIECES), max_size=9).map("".join)
turns = st.lists(st.tuples(st.one_of(st.sampled_from(["user", "system", "assistant", "tool", ""]), texts), texts), max_size=6)


@given(turns)
@settings(max_examples=400, deadline=None)
def test_round_trip(given_turns):
    text, places = C.render(given_turns)
    read = list(C.parse(text))
    assert [t[:2] for t in read] == given_turns
    assert [(a, b) for role, _, a, b in read if role == "assistant"] == places
    assert [C.unescape(text[a:b]) for a, b in places] == [t for r, t in given_turns if r == "assistant"]


@given(texts)
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text and not C._BARE.search(C.escape(text))


def test_only_conflicting_texts_are_escaped():
    text, places = C.render([("user", "a [INST b"), ("assistant", "x</s>[INST] y [/INST] z"), ("user", "[\\INST]")])
    assert text == "[INST] a [INST b [/INST] x<\\/s>[\\INST] y [\\/INST] z</s>[INST] [\\\\INST] [/INST]"
    assert C.render([("tool", "r"), ("assistant", "")]) == ("[ROLE] tool [/ROLE] r</s> </s>", [(26, 26)])


@pytest.mark.parametrize("text", ["[INST] a", "[INST] a[/INST]", "x", " a", "[ROLE] user [/ROLE] x</s>", "[INST] a </s>", "[ROLE] t [/ROLE]x</s>"])
def test_what_is_not_in_the_grammar(text):
    with pytest.raises(C.NotInGrammar):
        list(C.parse(text))


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, (role or ""), (text or "")))
    out = {}
    for conv, own in by.items():
        own = [(r, t) for _, _, r, t in sorted(own, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))]
        loss = "".join(t for r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        chars = sum(len(C.render([t])[0]) for t in own)
        out[conv] = (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)), len(loss), sha(loss), chars)
    return out


@pytest.mark.parametrize("limit", [1, 60, 1 << 20])
def test_parts_against_brute_force(spark, limit):
    rows = [(i % 40, i // 40, ["user", "assistant", "system", "tool"][i % 4], f"said {i} " + "<s>" * (i % 3)) for i in range(400)]
    # one conversation holds half of the rows
    rows += [(7, 100 + i, "user" if i % 2 else "assistant", f"long talk {i} </s>") for i in range(400)]
    rows += [(None, 1, "user", "no id"), (None, None, None, None), (50, 0, "user", LONG), (50, 0, "user", LONG), (50, 1, "assistant", ""), (51, 0, None, "x"),
             (-5, 3, "assistant", "two"), (-5, 3, "assistant", "one"), (-5, 3, "assistant", "two")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS part", "1 AS conv", "2 AS task").repartition(9)
    parts = C.format_chats(df, part_chars=limit)
    got = {r[0]: tuple(r)[1:] for r in C.digests(parts).collect()}
    assert got == brute(rows)
    assert C.digests(parts).count() == len(got)
    # the texts of a conversation's parts make its text
    mine = "".join(r.text for r in parts.where("conv = 3").orderBy("part").collect())
    assert mine == C.render([(r, t) for c, _, r, t in sorted((x for x in rows if x[0] == 3), key=lambda x: x[1])])[0]
    if limit == 1:
        assert parts.where("conv = 7").count() == 410 and not parts.where("conv = 7 and alone").count()


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert C.digests(C.format_chats(none)).count() == 0
    names = spark.createDataFrame([("b", 1, "user", "x"), ("a", 1, "user", "y")], none.schema)
    assert sorted(r.conv for r in C.digests(C.format_chats(names)).collect()) == ["a", "b"]
