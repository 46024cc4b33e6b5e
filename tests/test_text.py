"""Golden and property tests of text predicates, extraction and scores."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import extract as X
from tessera.functions import scores as S
from tessera.functions import text as T
from tessera.operators import documents as D


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(("line", "is_heading"), [("CHAPTER IV.", True), ("Part 12", True), ("IX.", True), ("3.", True), ("THE LAST HARBOUR", True), ("By the time he arrived, the sun had set.", False), ("", False), ("Chapter of accidents", False), ("12", False), ("CHAPTER I\nThe old mill by the river stood there.", True), ("Book 2\r\nof three", True), ("It began.\nCHAPTER I", False), ("IV.\n\nThe boat", True), ("12.\nand more", True)])
def test_heading(spark, line, is_heading):
    assert one(spark, line, T.is_chapter_heading) is is_heading


@pytest.mark.parametrize(("line", "is_front"), [("Contents:", True), ("by George Meredith", True), ("PREFACE", True), ("All rights reserved", True), ("Contents may shift in transit", False)])
def test_front_matter(spark, line, is_front):
    assert one(spark, line, T.is_metadata) is is_front


def test_heading_alike_in_both_forms(spark):
    for p in ("CHAPTER I\nThe old mill by the river stood there and nobody came near it for a year or more.", "Part 2\nshort", "It began.\nCHAPTER I and then nothing at all happened for a very long while indeed to us", "1.\nhe said that the boat was late and that it did not matter to anyone here"):
        assert D.narrative(p, 5) is bool(one(spark, p, lambda c: T.is_narrative(c, 5)))


def test_truncated():
    text = "One two three.\n\nFour five six seven.\n\nEight nine."
    assert D.truncated(text, 100) == (text, 12) and D.truncated(text, 7) == ("One two three.", 12) and D.truncated(text, 2) == ("", 12) and D.truncated(None) == (None, 0) and D.truncated("") == ("", 0)


def test_scores_with_slop_and_tool_rows(spark):
    m = one(spark, {"Clarity": 3.0, "Slop": 1.0}, lambda c: S.with_slop(c, F.lit(8.0)), "map<string,double>")
    assert m == {"Clarity": 3.0, "Slop": 42.0} and one(spark, None, lambda c: S.with_slop(c, F.lit(8.0)), "map<string,double>") is None
    assert one(spark, "User: q\nCall: f()\nResult: 3\nAgent: done", X.tool_row).agent_output == "done" and one(spark, "User: q", X.tool_row) is None


def test_snake_case(spark):
    plain = lambda t: "".join("_" + c if k and c.isupper() and c.isascii() else c for k, c in enumerate(t)).lower()
    for t in ("TheOldMill", "USA Today", "aBC", "X", "", "THE END"):
        assert one(spark, t, T.snake_case) == plain(t)


def test_narrative_needs_words(spark):
    assert one(spark, "He went on and on through the rain until the lamps of the town came into view.", T.is_narrative)
    assert not one(spark, "He went on.", T.is_narrative)


def test_paragraph_kinds(spark):
    assert one(spark, "see plate.png", T.is_image)
    assert one(spark, "[Footnote 3: so]", T.is_footnote)
    assert one(spark, "write to a.b@c.org", T.is_email)
    assert one(spark, "a   b   c   d   e   f", T.is_table)
    assert one(spark, "== Heading ==", T.is_table)
    assert one(spark, "APPENDIX B", T.is_title_or_other)
    assert one(spark, "** note", T.starts_formatted)
    assert not one(spark, "The rain fell on the roof all night long.", T.is_boilerplate)


def test_counts(spark):
    assert one(spark, "  a  b\n c ", T.count_words) == 3
    assert one(spark, "", T.count_words) == 0
    assert one(spark, "Élan été naïve", lambda c: F.size(T.words(c))) == 3
    assert one(spark, "a b", lambda c: F.size(T.ngrams(T.words(c), 3))) == 0


def test_messages_and_names(spark):
    assert one(spark, " a\n\nb\tc<|endoftext|> ", T.clean_message) == "abc"
    assert one(spark, None, T.clean_message) == ""
    assert one(spark, "True", T.clean_message) == "true"
    assert one(spark, "abcdef", lambda c: T.clean_message(c, 3)) == "abc..."
    assert one(spark, "Old Mill & Co", T.slug) == "old_mill__co"
    assert one(spark, "MyTaskName", T.snake_case) == "my_task_name"
    assert one(spark, "Élan “vital”", T.ascii_normal) == 'elan "vital"'
    assert one(spark, "a\n\nb\n\nc", T.without_last_paragraph) == "a\n\nb"


def test_fences_and_tags(spark):
    text = "x\n```python\na = 1\n```\ny\n```python\nb = 2\n```\n<t>one</t><t>two"
    assert one(spark, text, lambda c: X.code_fences(c, "python")) == ["a = 1", "b = 2"]
    assert one(spark, text, lambda c: X.between_tags(c, "t")) == ["one", "two"]
    assert one(spark, text, lambda c: X.last_in_tag(c, "t")) == "two"
    assert one(spark, "<instruction><g>x</g> <t> y </t></instruction>", X.instruction_tags) == {"g": "x", "t": "y"}
    assert X.xml_tags("<A>x</a><b>y</b>", ["A"]) == {"A": "x", "b": "y"}
    assert X.xml_tags("<b>y</b>", ["A"]) is None


def test_answers(spark):
    assert one(spark, "a<answer> 12 </answer>", X.xml_answer) == "12"
    assert one(spark, "plain", X.xml_answer) == "plain"
    assert one(spark, "so #### $1,200", X.hash_answer) == "1200"
    assert one(spark, "none", X.hash_answer) is None
    assert one(spark, "Not Narrative Fiction", X.fiction_label) == 0
    assert one(spark, "It is Narrative Fiction", X.fiction_label) == 1
    assert one(spark, "unsure", X.fiction_label) is None


def test_judge_scores(spark):
    assert one(spark, "Pace: 7\nTone: Score 8.5\nPace: [9]", X.judge_scores) == {"Pace": 9.0, "Tone": 8.5}
    assert X.literal_map("{'a': 1, 'b': None}") == {"a": 1.0, "b": None}
    assert X.literal_map('{"a": "2.5"}') == {"a": 2.5}
    assert X.literal_map("broken") is None


def test_notations(spark):
    assert one(spark, "2d6+1", X.dice).asDict() == {"n": 2, "sides": 6, "modifier": 1}
    assert one(spark, "d20", X.dice).asDict() == {"n": 1, "sides": 20, "modifier": 0}
    assert one(spark, "six", X.dice) is None
    assert one(spark, "Cat: a; Cat: b; prize", X.bookshelves) == {"Cat": ["a", "b"], "Other": ["prize"]}
    assert one(spark, "[Sea] A. B -- Tide", X.title_parts).title == "Tide"
    assert X.call_parts("f(1, x='a')") == ("f", ["1"], {"x": '"a"'})
    assert X.call_parts("f(g())") is None
    assert X.markdown_parts("- one\n- two\n```\n- no\n```") == (["one", "two"], "- no")
    assert X.json_types('{"a": 1, "b": []}') == {"a": "int", "b": "list"}


def test_slop(spark):
    docs = spark.createDataFrame([(1, "Alpha beta gamma"), (2, ""), (3, None)], "doc_id int, text string")
    phrases = spark.createDataFrame([(1, "alpha"), (2, "alpha beta"), (3, "alpha beta gamma"), (1, "alpha")], "n int, phrase string")
    got = {r.doc_id: r.slop for r in S.slop_index(docs, phrases).collect()}
    assert got == {1: pytest.approx(1000 * 11 / 3), 2: 0.0, 3: 0.0}


def test_rewards(spark):
    df = spark.createDataFrame([("<reasoning>\na\n</reasoning>\n<answer>\n4\n</answer>\n",)], "c string")
    r = df.select(S.correctness(F.col("c"), F.lit("4")).alias("a"), S.integer_reward(F.col("c")).alias("b"), S.xml_count(F.col("c")).alias("c"), S.soft_format(F.col("c")).alias("d"), S.strict_format(F.col("c")).alias("e")).first()
    assert (r.a, r.b, r.d, r.e) == (2.0, 0.5, 0.5, 0.25)
    assert r.c == pytest.approx(0.5 - 0.001 * 13, abs=0.02)


def test_group_scores(spark):
    df = spark.createDataFrame([([["a", "b", "c", "d"], ["e", "f", "g", "h"]], [["d", "c", "b", "a"], ["e", "f", "x", "y"]])], "s array<array<string>>, g array<array<string>>")
    r = df.select(S.hard_groups(F.col("s"), F.col("g")).alias("h"), S.soft_groups(F.col("s"), F.col("g")).alias("o"), S.group_sizes(F.col("g")).alias("z"), S.group_count(F.col("g")).alias("n")).first()
    assert (r.h, r.o, r.z, r.n) == (0.5, 1.5, 1.0, 0.0)


def test_bands_and_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], 0.5), ([0.0, 0.0], [1.0, 0.0], -9.0)], "a array<double>, b array<double>, x double")
    rows = df.select(S.cosine(F.col("a"), F.col("b")).alias("c"), S.percentile_label(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("p")).collect()
    assert rows[0].c == pytest.approx(2**-0.5)
    assert [r.c for r in rows][1] is None
    assert [r.p for r in rows] == ["50-90", None]


def test_headers_are_stripped():
    body = [f"line {k}" for k in range(120)]
    text = "\n".join(["preamble", "*** START OF THIS PROJECT GUTENBERG EBOOK ***", *body, "End of the Project Gutenberg EBook", "licence"])
    assert D.strip_headers(text).split("\n") == body
    assert D.strip_headers("") == ""


words = st.lists(st.sampled_from(["rain", "fell", "softly", "on", "roofs"]), min_size=0, max_size=12).map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(words, max_size=30), st.integers(1, 20))
def test_chunks_are_full(paragraphs, least):
    chunks = D.paragraph_chunks(paragraphs, least)
    assert all(sum(map(D.rough_count, c)) >= least for c in chunks)
    flat = iter(paragraphs)
    assert all(p in flat for c in chunks for p in c)  # in order, nothing put in


def test_chunk_drops_the_paragraph_that_closes_it():
    assert D.paragraph_chunks(["a b", "c d", "e f", "g h"], 2) == [["a b"], ["e f"]]


def test_continuations():
    p = " ".join(["word"] * 60)
    got = D.continuations([p] * 6, D.ContinuationSizes(summary_tokens=120, prefix_tokens=60))
    assert got and all(passage.startswith(prefix) for prefix, passage, _ in got)
    assert D.continuations([p]) == []


def test_screenplay():
    text = "TITLE\n\nINT. HALL - DAY\n\nRain falls.\nIt stops.\n\nANNA\n(softly)\nHello there.\nAgain.\n\nCUT TO:\n\nEXT. YARD\n\nBEN\nYes."
    scenes = D.parse_screenplay(text)
    assert [s["heading"] for s in scenes] == ["INT. HALL - DAY", "EXT. YARD"]
    a = scenes[0]["elements"]
    assert [e["type"] for e in a] == ["action", "dialogue", "transition"]
    assert a[0]["content"] == "Rain falls. It stops."
    assert (a[1]["character"], a[1]["parenthetical"], a[1]["content"]) == ("ANNA", "(softly)", "Hello there. Again.")
    assert D.parse_screenplay(None) == []


@pytest.mark.parametrize("turned", [False, True])
def test_latest_books(spark, turned):
    rows = [(1, "old", "2024-01-01"), (1, "new", "2024-03-01"), (1, None, "2024-04-01"), (1, "undated", None), (2, "a", "2024-01-01"), (2, "b", "2024-01-01"), (3, None, "2024-01-01")]
    df = spark.createDataFrame([(i, x, "t", "a", at) for i, x, at in rows[:: -1 if turned else 1]], "id long, text string, title string, author string, fetched_at string").coalesce(1)
    by_hash = spark.createDataFrame([("a",), ("b",)], "text string").orderBy(F.xxhash64("text", F.lit("t"), F.lit("a"))).first().text
    assert {(r.id, r.text) for r in D.latest_books(df).collect()} == {(1, "new"), (2, by_hash)}
