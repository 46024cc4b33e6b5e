"""Operators for training data against brute force, round trips and edge cases: nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from datetime import datetime
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import leaks, packing, pairs, pieces, queries, spam, splits, truncation
from tessera.llm.components import components
from tessera.llm.language import language
from tessera.llm.normal import words
from tessera.llm.trees import fit_bag, vote

WORDS = "amber barrel candle drift ember fable garden harbour island jasper kettle lantern meadow needle orchard pepper quarry ribbon saddle timber".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return ". ".join(" ".join(["The", r.choice(WORDS), "was", "near", "a", r.choice(WORDS), "and", "it", "had", r.choice(WORDS)]) for _ in range(n)) + "."


# --- pieces --------------------------------------------------------------------------------------------------------


@settings(max_examples=120, deadline=None)
@given(st.text(alphabet="ab .\n字。", max_size=400), st.integers(20, 80), st.integers(0, 15))
def test_pieces_give_the_text_back(text, most, overlap):
    got = pieces.cuts(text, most, overlap)
    assert "".join(text[a:b] for a, b in got) == text
    assert all(b - a + (overlap if k else 0) <= most for k, (a, b) in enumerate(got))
    assert all(b - a + (overlap if k else 0) >= overlap for k, (a, b) in enumerate(got[:-1]))


def test_pieces_prefer_high_boundaries():
    text = "One two. Three four.\n\nFive six. Seven eight.\n\nCHAPTER II\n\nNine ten eleven twelve."
    (a, b), *_ = pieces.cuts(text, 60, 5)
    assert text[b:].startswith("CHAPTER II")
    (a, b), *_ = pieces.cuts(text, 40, 5)
    assert text[b:].startswith("Five six")
    text = "abcdefghij"
    assert [text[a:b] for a, b in pieces.cuts(text, 4, 1)] == ["abcd", "efg", "hij"]


def test_pieces_of_tables(spark):
    long = prose(400, 1)
    books = spark.createDataFrame([(1, long, datetime(2024, 1, 1), "c"), (1, "short", datetime(2024, 1, 2), "c"), (2, "old", datetime(2024, 1, 1), "c"), (2, long, datetime(2024, 1, 3), "c"), (3, None, None, "c"), (4, "", None, "c"), (5, long, None, None)], "id long, text string, fetched_at timestamp, record_id string")
    el = "array<struct<type:string,content:string,line_number:int>>"
    scenes = spark.createDataFrame([(1, [("a", "second" * 300, 5), ("a", "first" * 300, 1), ("a", None, 2)], None), (1, [("a", "second" * 300, 5), ("a", "first" * 300, 1), ("a", None, 2)], None), (2, None, None), (3, [], None)], f"scene_id long, elements {el}, created_at timestamp")
    limits = spark.createDataFrame([("books", 900, 60), ("scenes", 1000, 50)], "applies_to string, max_size long, overlap long")
    got = pieces.split_books_and_scenes(books, scenes, limits).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r.piece_no):
        by[r.record_kind, r.record_id].append(r)
    assert set(by) == {("book", 1), ("book", 2), ("book", 5), ("scene", 1)} and len(by["book", 1]) == 1
    for (kind, _), own in by.items():
        most, over = (900, 60) if kind == "book" else (1000, 50)
        assert all(len("".join(r.parts)) == r.n_chars <= most for r in own)
        assert all(r.overlap == over and "".join(r.parts)[:over] == "".join(q.parts)[-over:] for q, r in zip(own, own[1:]))
    assert "".join("".join(r.parts)[r.overlap :] for r in by["book", 2]) == long
    assert "".join("".join(r.parts)[r.overlap :] for r in by["scene", 1]) == "first" * 300 + "second" * 300
    assert pieces.split_books_and_scenes(books.limit(0), scenes.limit(0), limits).count() == 0


# --- truncation ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "kind", "is_cut"),
    [("The end.", "stop", None), ('{"a": 1}', "json", False), ('{"a": "x', "json", True), ("a\n```\nb", "fence", True), ("a\n```\nb\n```", "closed", False), ("<t>\nabc.", "tag", True), ("x [truncated]", "mark", True), ("caf�", "mark", True), ('She said, "come.', "quote", True), ("and so on…", "dots", None), ("Yours,\nAnna", "sign", False), ("Text.\n\nFinal answer: 42", "figure", False), ("- a\n- b", "entry", None), ("seven", "short", None), ("没有人知道", "open", True), ("没有人知道。", "stop", False), ("", "none", False), ("   ", "none", False)],
)
def test_endings(text, kind, is_cut):
    k, c, *_ = truncation.ending(text)
    assert (k, c) == (kind, is_cut)


def test_cut_texts_are_found(spark):
    rows = [(f"w{k}", prose(8, k)) for k in range(60)]
    full = prose(30, 999)
    rows += [("full", full), ("copy", full[:-37].rstrip(".")), ("null", None), ("blank", " \n"), ("mid", prose(5, 77)[:-4]), ("long", prose(4000, 5)), ("same1", prose(3, 3)[:-9]), ("same2", prose(3, 3)[:-9])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id string, text string, cut string")
    got = {r.id: r.cut for r in truncation.find_truncated(df).collect()}
    assert "null" not in got and "blank" not in got
    assert got["copy"] and got["mid"] and got["same1"] and got["same2"] and not got["full"] and not got["long"] and not any(got[f"w{k}"] for k in range(60))
    assert truncation.find_truncated(df.limit(0)).count() == 0


def test_near_copy_shows_the_cut(spark):
    full = prose(40, 7)
    df = spark.createDataFrame([("full", full), ("cut", full[: int(len(full) * 0.9)]), ("other", prose(40, 8))], "id string, text string")
    assert [r.id for r in truncation.near_copies(df).collect()] == ["cut"]


def test_copy_cut_to_a_fraction(spark):
    entries = lambda seed: "\n".join(f"- {' '.join(random.Random(seed * 100 + k).sample(WORDS, 2))}" for k in range(60))
    full = entries(1)
    short = full[: full.index(" ", full.index("\n", int(len(full) * 0.4)) + 4)]
    df = spark.createDataFrame([("full", full), ("cut", short)] + [(f"o{k}", entries(k)) for k in range(2, 8)], "id string, text string")
    assert len(short.split("\n")[-1].split()) == 2 and len(short) < 0.45 * len(full)
    got = {r.id: (r.how, r.cut) for r in truncation.find_truncated(df).collect()}
    assert got == {"full": ("entry", False), "cut": ("copy", True)} | {f"o{k}": ("entry", False) for k in range(2, 8)}


def test_hot_bucket_of_copies(spark):
    full = prose(40, 7)
    rows = [(f"c{k}", full + f" tail{k}.") for k in range(200)] + [("cut", full[: int(len(full) * 0.9)])]
    assert [r.id for r in truncation.near_copies(spark.createDataFrame(rows, "id string, text string")).collect()] == ["cut"]


def test_bucket_of_many_unlike_texts(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    template = [word() for _ in range(60)]
    texts = [" ".join(template + [word() for _ in range(60)]) for _ in range(400)]
    variant = texts[7].split()
    rows = [(f"t{k}", t + ".") for k, t in enumerate(texts)] + [("cut", " ".join(variant[:3] + ["other"] + variant[4:110]))]
    # a longer text that is like the next ones but differs where they were cut
    base = [word() for _ in range(200)]
    changed = base[:180] + [word() for _ in range(30)]
    rows += [("leader", " ".join(changed) + "."), ("variant", " ".join(base) + "."), ("cut2", " ".join(base[:5] + ["other"] + base[6:190]))]
    assert {x.id for x in truncation.near_copies(spark.createDataFrame(rows, "id string, text string")).collect()} == {"cut", "cut2"}


def test_filter_of_many_keys_keeps_out_others(spark):
    keys = spark.range(3_000_000).select(F.xxhash64("id").alias("key"))
    others = np.random.default_rng(1).integers(0, 2**64, 200_000, dtype=np.uint64)
    own = np.array([r.key for r in keys.limit(1000).collect()], np.int64).view(np.uint64)
    bits = truncation.key_filter(keys)
    assert truncation.passes(own, bits).all()
    assert truncation.passes(others, bits).mean() < 0.02
    assert not truncation.passes(others, truncation.key_filter(keys.limit(0))).any()


def test_recall_of_planted_near_copies(spark):
    """Lists of entries without full stops, cut between words after edits elsewhere: only the longer copy shows the cut."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows, planted = [], set()
    for k in range(120):
        full = [word() for _ in range(220)]
        edited = list(full)
        for at in r.sample(range(150), 3):
            edited[at] = word()
        if k % 3 == 0:
            edited[190 + k % 8] = word()  # an edit near the cut
        rows.append((f"full{k}", " ".join(full) + "."))
        if k < 100:
            planted.add(f"cut{k}")
            rows.append((f"cut{k}", " ".join(edited[:205])))
        else:
            rows.append((f"whole{k}", " ".join(edited) + "."))
    got = {x.id for x in truncation.near_copies(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert got <= planted and len(got) >= 0.9 * len(planted)


def test_alignment_of_cut_copies():
    full = "the old mill stood by the river and the miller kept a lamp in the window. he slept badly that year. nobody came."
    early = truncation.ends_early
    assert early("the old mill stood by a river and the miller kept a la", full) and early("the old mill stood by the river and the quiet miller kept a lamp in the", full)
    assert early("the old mill stood by the river and the miller kept a lamp in the window", full)
    assert not early(full, full) and not early(full[:-1], full) and not early("the old mill stood by the river and the miller kept a lamp in the window.", full)
    assert not early("a ship went down in the storm and none of the crew was found", full)


def test_shortened_beside_a_line_break(spark):
    t = "The old mill was near a harbour and it had"
    rows = [("t", t), ("line", t + "\nNew heading"), ("more", t + " more words."), ("short", "The old"), ("short2", "The older mill was here.")]
    assert [r.id for r in truncation.shortened(spark.createDataFrame(rows, "id string, text string")).collect()] == ["t"]


def test_verdicts_do_not_hang_on_the_size(spark):
    one = [prose(6, k) for k in range(40)] + [prose(6, 50)[:-6], prose(3, 51) + " It was of the", prose(3, 52) + "\n\nEND OF PART II", prose(3, 53) + "\n\nEND OF THE CANDL"]
    df = spark.createDataFrame([(f"{k}", t) for k, t in enumerate(one)], "id string, text string")
    many = spark.createDataFrame([(f"{k}", t) for k, t in enumerate(one)] + [(f"x{k}", prose(6, 1000 + k)) for k in range(1500)], "id string, text string")
    small = {r.id: r.cut for r in truncation.find_truncated(df).collect()}
    large = {r.id: r.cut for r in truncation.find_truncated(many).collect()}
    assert {k for k, v in small.items() if v} == {"40", "41", "43"} and all(large[k] == v for k, v in small.items()) and not any(v for k, v in large.items() if k[0] == "x")


def test_rates(spark):
    schema = "gen_id long, source string, content string"
    df = spark.createDataFrame([(1, "a", prose(5, 1)), (1, "a", prose(5, 1)), (2, "a", prose(5, 2) + " The old"), (3, None, prose(5, 3)), (4, "b", None)], schema)
    assert {r.source: (r.n_texts, r.n_cut) for r in truncation.truncation_rates(df).collect()} == {"a": (2, 1), None: (1, 0)}


# --- pairs ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("q", "a", "defect"),
    [
        ("Explain rain.", None, "empty"), ("Explain rain.", "​ ", "empty"), ("Explain rain.", "N/A", "empty"), ("Explain rain.", "```\n```", "empty"), ("Explain rain.", "<answer></answer>", "empty"), ("How many?", "39", None), ("How many?", "None at all.", None),
        ("Explain how rain falls in spring.", "I'm sorry, but I can't help with that.", "refusal"), ("How do I turn down a guest?", 'You could write: "I\'m sorry, but I can\'t come." Then send it early.', None), ("Explain rain.", "I can't promise it is easy, but here is a way. Rain falls from clouds.", None),
        ("Explain how rain falls in spring.", "**explain how rain falls in spring**", "copy"), ("Explain how rain falls in spring.", "Sure! Explain how rain falls in the spring.", "copy"), ("Correct the spelling: The rain fell on the old road at noon.", "The rain fell on the old road at noon.", None),
        ("Explain how rain falls in spring.", "Le matin, la pluie tombe sur la route et le vent ne cesse pas.", "language"), ("Translate into French: The rain falls.", "La pluie tombe sur la route et le vent ne cesse pas.", None),
        ("Explain how rain falls in spring.", 'The rain falls. As they say there: "La pluie tombe sur la route et le vent ne cesse pas." It is so.', None), (None, "Rain falls.", None),
    ],
)
def test_pair_rules(q, a, defect):
    assert pairs.rule(q, a, False) == defect


DECLINED = """I am afraid I can't assist with this one.|Sorry, but that is a request I have to refuse.|We are unable to provide instructions of that kind.|I'd rather not talk about it. Thank you for your understanding.|As an AI language model, I cannot give advice on that.
I must decline. I hope you understand.|Unfortunately, I won't be able to help.|This question cannot be answered here.|I do not feel able to comment on that.|My guidelines do not let me discuss this.|Your request has been denied.|I'm not comfortable writing that.
I refuse to take part in this.|That topic is outside my remit.|It would not be right for me to reply.|This could harm somebody, so I will not say more.|Some matters are better left unsaid. Let us talk about something else.|I'm sorry. I'm not allowed to share that.
Lo siento, pero no puedo ayudar con eso.|Je ne peux pas répondre à cette question.|Dabei kann ich nicht helfen.|Mi dispiace, non posso rispondere.|К сожалению, я не могу с этим помочь.|对不起，我无法回答。|Daar kan ik niet op antwoorden.""".replace("\n", "|").split("|")
ANSWERED = """She could not help laughing, and the boat went on.|He refused the offer and walked home through the rain.|You can't write a villain without knowing his fears. Start with what he loves.|The miller would not answer, so they asked the baker.|I can't say it is easy, but here is how: cut the board first.
Prefer oak to pine. Oak lasts.|It is not a matter of luck. Keep the ink dry and the nib clean.|"I cannot help you," said the guard. The door stayed shut.|No.|Three steps are needed. Do not skip the second.|My answer is short: rye, water and salt.|Das kann nicht wahr sein, rief der Wirt und lief hinaus.
The request was simple and the reply was long.|He was declined twice before the harbour took him.|A storm can't be told in one word. Begin with the light going green.""".replace("\n", "|").split("|")


def test_refusals_in_words_not_seen_before():
    found = [t for t in DECLINED if pairs.is_refusal(t)]
    assert len(found) >= 0.85 * len(DECLINED), set(DECLINED) - set(found)
    assert not [t for t in ANSWERED if pairs.is_refusal(t)]


def test_rules_have_no_limit_of_length():
    no = "I'm sorry, but I can't help with that. "
    assert pairs.is_refusal(no * 5) and pairs.is_refusal(no * 200) and not pairs.is_refusal(no * 200 + "Rain falls from clouds.")
    q = "Explain how rain falls in spring."
    assert all(pairs.is_copy(q, " ".join([q] * k)) for k in (1, 2, 3, 6, 60, 500)) and pairs.is_copy(q, " ".join(["Explain how the rain falls in spring."] * 50)) and not pairs.is_copy(q, prose(60, 1))
    assert pairs.is_empty("<answer></answer>" + " " * 500) and pairs.is_empty("<p></p>" * 80 + "\n") and pairs.is_empty("N/A" + "\n" * 300) and not pairs.is_empty("None of them came. " * 20)


def test_order_of_defects(spark):
    pr = spark.createDataFrame([(1, "Write of rain.", "The"), (1, "Write of rain.", ""), (2, "Tell me of the sea and of the ships on it.", "Tell me of the sea and of the ships on it."), (2, "Tell me of the sea and of the ships on it.", "I'm sorry, but I can't help with that.")], "row_id long, prompt string, text string")
    none = spark.createDataFrame([], "row_id long, instruction string, response string"), spark.createDataFrame([], "result_id long, prompt string, model_response string")
    assert {r.pair_id: r.defect for r in pairs.find_defects(pairs.pair_rows(*none, pr)).collect()} == {1: "empty", 2: "refusal"}


def test_languages_of_doubtful_questions():
    la = "Spiegami cosa vuole fare la custode in cantina con la mappa."
    assert pairs.foreign(la, "People in the street have managed it with nothing but a map. Keep the door shut and it will be dry.")
    assert not pairs.foreign("Describe cleaning a lantern under a tall door.", "Ask a neighbour to hold the glass while you clean it. Work slowly and let it settle before you touch the wick.")


def test_defects_over_tables(spark):
    goody = spark.createDataFrame([(k, "Tell me of the sea", prose(6, k)) for k in range(50)] + [(90, "Tell me of the sea", prose(6, 3)[:-12]), (90, "Tell me of the sea", prose(6, 3)[:-12]), (91, "Tell me of the sea", ""), (92, None, prose(2, 1))], "row_id long, instruction string, response string")
    ev = spark.createDataFrame([(1, "Tell me of the sea", "Tell me of the sea")], "result_id long, prompt string, model_response string")
    pr = spark.createDataFrame([(1, "-", prose(3, 1)), (2, "Write of it", prose(3, 2))], "row_id long, prompt string, text string")
    got = sorted((r.pair_table, r.pair_id, r.defect) for r in pairs.find_defects(pairs.pair_rows(goody, ev, pr)).collect())
    assert got == [("eval_results", 1, "copy"), ("goody", 90, "truncated"), ("goody", 91, "empty"), ("processed_rows", 1, "empty")]
    assert pairs.find_defects(pairs.pair_rows(goody.limit(0), ev.limit(0), pr.limit(0))).count() == 0


def test_shortened_against_brute_force(spark):
    r = random.Random(4)
    texts = [prose(3, k % 40)[: r.randrange(30, 130)] for k in range(120)]
    df = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")
    inside = lambda t: not re.search(r"[.!?。！？…][\"”'’)\]*_`]*$", t)
    want = {str(k) for k, t in enumerate(texts) if inside(t.rstrip()) and any(u.rstrip() != t.rstrip() and u.startswith(t.rstrip()) for u in texts)}
    want = {k for k in want if len(texts[int(k)].split()) >= 5}
    assert {x.id for x in truncation.shortened(df).collect()} == want


def test_ranges_of_the_sort_against_brute_force(spark, monkeypatch):
    r = random.Random(11)
    for k, v in {"RANGE": 400, "RANGES": 150, "SAMPLE": 60_000}.items():
        monkeypatch.setattr(truncation, k, v, raising=False)
    same = prose(2, 5)  # a long beginning that most texts share, and one text that is repeated
    texts = [same * r.randrange(2) + prose(3, k % 60)[: r.randrange(30, 130)].rstrip() + r.choice(["", "\nLine", " 字", " 🙂"]) for k in range(900)] + [same[:-9]] * 300
    rows = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string")
    keyed = rows.select(F.xxhash64("text").alias("h"), F.length("text").alias("n"), "text")
    bounds = truncation.range_bounds(keyed)
    assert 90 < len(bounds) < 150 and bounds == sorted(set(bounds)) and truncation.range_bounds(keyed.limit(0)) == []
    for some in (bounds, bounds[:1], bounds[:2], bounds[:7], []):
        got = rows.select("text", truncation.range_of(F.col("text"), some).alias("at")).collect()
        assert all(x["at"] == sum(b <= x["text"] for b in some) for x in got)
    ordered = sorted({t.replace("\n", truncation.LAST) for t in texts})
    want = {a for a, b in zip(ordered, ordered[1:]) if truncation.continued(a, b)}
    found = {x.id for x in truncation.shortened(rows).collect()}
    assert len(want) > 20 and found == {str(k) for k, t in enumerate(texts) if t.replace("\n", truncation.LAST) in want}


def test_sort_sends_the_driver_few_texts(spark, monkeypatch):
    for k, v in {"RANGE": 2**20, "SAMPLE": 2**18}.items():
        monkeypatch.setattr(truncation, k, v, raising=False)
    df = spark.range(0, 2000, 1, 4).select(F.col("id").cast("string").alias("id"), F.concat(F.sha2(F.col("id").cast("string"), 256), F.repeat(F.lit(" amber."), 600)).alias("text"))
    sc = spark.sparkContext

    def received() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return sum(stages.apply(k).resultSize() for k in range(stages.size()))

    before = received()
    assert truncation.shortened(df).count() == 0
    assert received() - before < 2_000_000  # whole texts of a sample of Spark's own are 5 MB


def test_words_that_close_more_often_than_they_stand(spark):
    texts = [f'{prose(2, k)} "It was a quokka."' for k in range(30)] + ["The quokka had a lamp.", "The lamp was near a quokka"]
    got = {r.id: r.cut for r in truncation.find_truncated(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "id string, text string"), copies=False).collect()}
    assert len(got) == len(texts) and not any(got[str(k)] for k in range(30))


def test_deeply_nested_json():
    assert truncation.ending("[" * 200_000 + "]" * 200_000)[:2] == ("json", False) and truncation.ending('[["]", ' + "[" * 200_000)[:2] == ("json", True)


def test_language():
    assert [language(t) for t in ("The rain is on the road", "Der Regen ist auf der Straße", "La pluie est sur la route", "没有人知道", "Это было осенью", "12", "")] == ["en", "de", "fr", "zh", "ru", None, None]


# --- splits --------------------------------------------------------------------------------------------------------


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(f"n{r.randrange(80)}", f"n{r.randrange(80)}") for _ in range(50)] + [("hub", f"h{k}") for k in range(40)] + [(f"c{k}", f"c{k + 1}") for k in range(12)] + [("a", None)]
    parent: dict[str, str] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        parent[find(a)] = find(b)
    got = {x.v: x.label for x in components(spark.createDataFrame(edges, "a string, b string")).collect() if x.v != "a"}
    assert set(got) == set(parent)
    one, two = defaultdict(set), defaultdict(set)
    for v in got:
        one[got[v]].add(v), two[find(v)].add(v)
    assert sorted(map(sorted, one.values())) == sorted(map(sorted, two.values()))


def test_names():
    for v in ("Ada Marlow", "ADA MARLOW", "Marlow, Ada", "Marlow, Ada, 1868-1931", "Dr. Ada Marlow", "by Ada Marlow", "ada_marlow", "Ada  Márlow "):
        assert splits.person(v) == ("ada", "marlow")
    assert splits.person("A. Marlow") == splits.person("Marlow, A.") == ("a", "marlow")
    assert all(splits.person(v) is None for v in ("", "Unknown", "Various", "-", "  ", "None"))
    for v in ("The Old Mill", "Old Mill, The", "the_old_mill.txt", "the-old-mill", "THE OLD MILL - SHOOTING SCRIPT", "The Old Mill (1994)", "The Old Mill (draft 2)", "The Old Mill [2nd ed.]", "The Old Mill: A Novel", "The Old Mill.", "The The Old Mill"):
        assert splits.work(v) == "old mill"
    assert splits.work("The Old Mill, Book II") == splits.work("The Old Mill, Vol. 2") == "old mill #2" != splits.work("The Old Mill, Book III")
    assert splits.work("Salt & Wind") == splits.work("Salt and Wind") and splits.work("Untitled") is None


def test_one_edit(spark):
    near = [("marlow", "marrlow"), ("marlow", "malrow"), ("marlow", "marlo"), ("marlow", "marlow"), ("ab", "ba"), ("marlow", "arlow")]
    far = [("marlow", "morlew"), ("marlow", "mawlor"), ("abcd", "badc"), ("marlow", "mar"), ("a", "bc")]
    df = spark.createDataFrame([(*p, True) for p in near] + [(*p, False) for p in far], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.select("want", splits.one_edit(F.col("a"), F.col("b")).alias("got")).collect())


def tables(spark):
    rows = [(1, "Ada Marlowe", "The Old Mill"), (2, "Marlowe, Ada", "Salt"), (3, "A. Marlowe", None), (4, "Ben Marlowe", "Rain"), (5, "Ada Marlwoe", "Fog"), (6, None, "SALT"), (7, "Unknown", "Untitled"), (8, "Unknown", None), (9, None, None), (1, "Ada Marlowe", "The Old Mill")]
    rows += [(100 + k, f"Person{chr(97 + k % 26)} Family{chr(97 + k // 26)}x", f"Work number {k} of many") for k in range(400)]
    pr = spark.createDataFrame([(*r, "x") for r in rows], "row_id long, author string, title string, label string")
    sc = spark.createDataFrame([(1, "Old Mill, The (draft 3)"), (2, "Rain"), (3, None), (3, None)], "scene_id long, name string")
    return pr, sc


def test_entities(spark):
    pr, sc = tables(spark)
    got = {(r.value_a, r.value_b) for r in splits.same_entity_pairs(pr.filter("row_id < 100"), sc).collect()}
    people = ["A. Marlowe", "Ada Marlowe", "Ada Marlwoe", "Marlowe, Ada"]
    want = {(a, b) for a in people for b in people if a < b} | {("Old Mill, The (draft 3)", "The Old Mill"), ("SALT", "Salt")}
    assert got == want
    assert splits.same_entity_pairs(pr.limit(0), sc.limit(0)).count() == 0


def test_splits_keep_entities_together(spark):
    pr, sc = tables(spark)
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, share double")
    got = {(r.row_table, r.row_id): r.split_name for r in splits.assign_splits(pr, sc, shares).collect()}
    assert len(got) == pr.select("row_id").distinct().count() + 3
    p = lambda k: got["processed_rows", k]
    assert p(1) == p(2) == p(3) == p(5) == p(6) == got["scenes", 1] and p(4) == got["scenes", 2]
    n = defaultdict(int)
    for s in got.values():
        n[s] += 1
    assert abs(n["train"] / len(got) - 0.8) < 0.06 and set(n) == {"train", "validation", "test"}
    assert splits.assign_splits(pr.limit(0), sc.limit(0), shares).count() == 0


def test_hub_and_rows_without_names(spark):
    hub = [(k, "Ada Marlowe", f"Work {chr(97 + k % 26)}{chr(97 + k // 26)} of many") for k in range(600)]
    none = [(1000 + k, None, None) for k in range(300)] + [(2000, None, None), (2000, "Ada Marlowe", None)]
    pr = spark.createDataFrame(hub + none, "row_id long, author string, title string")
    sc = spark.createDataFrame([(k, None) for k in range(200)] + [(900, "Work aa of many (draft 1)")], "scene_id long, name string")
    shares = spark.createDataFrame([("train", 0.5), ("test", 0.5)], "split_name string, share double")
    got = splits.assign_splits(pr, sc, shares).collect()
    assert len(got) == 600 + 302 + 201
    by = defaultdict(set)
    for r in got:
        by[r.row_table, r.row_id].add((r.component, r.split_name))
    one = by["processed_rows", 0]
    assert all(by["processed_rows", k] == one for k in range(600)) and by["scenes", 900] == by["processed_rows", 2000] == one
    assert len({next(iter(v))[0] for v in by.values()}) == 1 + 300 + 200
    edges = spark.createDataFrame([("hub", f"leaf{k}") for k in range(3000)], "a string, b string")
    assert components(edges).agg(F.count("*").alias("n"), F.count_distinct("label").alias("k")).first() == (3001, 1)


def test_classes_and_pairs_agree(spark):
    pr = spark.createDataFrame([(k, None, "The Old Mill" + " " * k) for k in range(40)] + [(99, None, "Salt")], "row_id long, author string, title string")
    sc = spark.createDataFrame([], "scene_id long, name string")
    classes = {r.value: (r.entity, r.n_values) for r in splits.entity_classes(splits.entity_values(pr, sc)).collect()}
    assert len(classes) == 41 and len({v for v in classes.values()}) == 2 and classes["Salt"][1] == 1
    pairs_ = {(r.value_a, r.value_b) for r in splits.same_entity_pairs(pr, sc, part=4).collect()}
    mills = sorted(v for v in classes if v != "Salt")
    assert pairs_ == {(a, b) for a in mills for b in mills if a < b}


# --- packing -------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=200), st.integers(1, 8))
def test_open_containers(sizes, most):
    bins = packing.OpenContainers(50, most)
    used: dict[int, int] = defaultdict(int)
    for s in sizes:
        used[bins.put(s)] += s
        assert bins.n <= most + 1 and bins.n == sum(map(len, bins.by.values()))
    assert all(v <= 50 for v in used.values()) and sum(used.values()) == sum(sizes)


def test_packing(spark):
    texts = [prose(k % 7 + 1, k) for k in range(80)] + [None, "", "字" * 900, prose(200, 5), "x" * 5000]
    docs = spark.createDataFrame([(k, t, "c") for k, t in enumerate(texts)], "doc_id long, text string, start string").coalesce(2)
    got = packing.pack(docs, 256).collect()
    enc = packing.encoder(Path(packing.TOKENIZER).read_bytes())
    load, own = defaultdict(int), defaultdict(list)
    for r in got:
        load[r.container_id] += r.n_tokens
        own[r.doc_id].append(r)
    assert max(load.values()) <= 256 and set(own) == set(range(len(texts)))
    for k, t in enumerate(texts):
        rs = sorted(own[k], key=lambda r: r.piece_no)
        assert "".join((t or "")[r.start : r.end] for r in rs) == (t or "")
        assert all(len(enc.encode_ordinary((t or "")[r.start : r.end])) == r.n_tokens for r in rs)
        assert len(rs) == 1 or len(enc.encode_ordinary(t)) > 256
    report = packing.fill_report(packing.pack(docs, 256), 256).first()
    assert report.n_containers >= report.least_containers and report.filled > 0.8
    assert packing.pack(docs.limit(0), 256).count() == 0
    with pytest.raises(ValueError, match="at least one"):
        packing.pack(docs, 0)


def test_tokens_of_long_texts_without_spaces(spark):
    enc = packing.encoder(Path(packing.TOKENIZER).read_bytes())
    texts = ["没有人知道字" * 9000, "ab" * 30000, "x y " * 12000]
    for r in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1_000_000).collect():
        assert r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) and r.piece_no == 0
    got = packing.pack(spark.createDataFrame([(0, texts[0])], "doc_id long, text string"), 4000).collect()
    assert "".join(texts[0][r.start : r.end] for r in sorted(got, key=lambda r: r.piece_no)) == texts[0]
    assert all(r.n_tokens == len(enc.encode_ordinary(texts[0][r.start : r.end])) <= 4000 for r in got)


# --- leaks ---------------------------------------------------------------------------------------------------------


def varied(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [f"{r.choice(WORDS)}{r.choice('aeiou')}{r.choice(WORDS)[:3]}" for _ in range(n)]


def test_alignment_against_a_plain_one():
    r = random.Random(1)
    for _ in range(30):
        a = [r.randrange(12) for _ in range(r.randrange(3, 25))]
        b = a[: len(a) // 2] + [r.randrange(12)] * r.randrange(7) + a[len(a) // 2 :] + [r.randrange(12) for _ in range(4)]
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1][j + 1] = max(0, h[i][j] + (1 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
        got = leaks.align([np.array(a, np.int32)], [np.array(b, np.int32)])[0]
        assert got[0] == max(map(max, h))


def test_leaks(spark):
    passage = varied(60, 1)
    stock = "Read the passage and answer."
    items = [(1, f"{stock}\n{' '.join(passage)}\nWho was it?"), (2, f"{stock}\n{' '.join(varied(50, 2))}"), (3, None), (4, " ".join(varied(10, 3)))]
    edited = list(passage)
    edited[7::9] = ["other"] * len(edited[7::9])
    shown = " ".join(passage[5:45])
    marked = re.sub(r"(\w{4})(\w{4})", r"\1-\n\2", shown.replace("a", "а"), count=1).upper().replace(" ", "\xa0", 3)
    docs = [
        (1, prose(5, 1) + " " + " ".join(passage) + ". " + prose(5, 2)), (2, prose(9, 3)), (3, " ".join(edited)), (4, "<p>" + " <b>".join(passage[10:42]) + "</p>"), (5, "\n> ".join(" ".join(passage[k : k + 6]) for k in range(0, 60, 6))),
        (6, marked), (7, " ".join(passage[:25])), (8, stock + " " + prose(30, 4)), (9, None), (10, ""), (11, prose(8000, 6) + " " + shown), (1, prose(5, 1)),
    ]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i).collect()}
    assert got == {(k, 1) for k in (1, 3, 4, 5, 6, 11)}
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i, block_chars=1).collect()} == got
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_verbatim_runs_beside_changed_blocks():
    passage, other = varied(100, 11), [f"x{w}" for w in varied(100, 12)]
    docs = [
        passage[:40] + other[40:60] + passage[60:], passage[:35] + [w for k in range(35, 100, 3) for w in (passage[k], passage[k + 1 if k < 99 else k], other[k])],
        [other[k] if k % 5 == 4 else w for k, w in enumerate(passage)], passage[:20] + other[20:30] + passage[30:50] + other[50:], passage[:25] + other[25:30] + passage[30:55] + other[55:], [other[k] if k % 3 == 2 else w for k, w in enumerate(passage)],
    ]
    index = leaks.build_index([(1, " ".join(passage))])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(docs))), "text": [" ".join(d) for d in docs]})
    got = {r["doc_id"]: r for b in leaks.search(index, 6, 24, 30, 0.82)([batch]) for r in b.to_pylist()}
    assert {0, 1, 2} <= set(got) and not {3, 5} & set(got)
    assert got[0]["span"] == 40 and got[0]["matched"] == 40


def test_alignment_over_a_long_insertion():
    a = np.arange(60, dtype=np.int32)
    b = np.concatenate([a[:30], np.full(9, -1, np.int32), a[30:]])
    score, i0, i1, j0, m = leaks.align([a], [b])[0].tolist()
    assert (score, i0, i1, j0, m) == (60 - 9, 0, 59, 0, 60)


def test_seeds_are_rare_among_all_items_whatever_the_blocks(spark):
    shared = varied(12, 50)
    items = [(k, " ".join(varied(40, 100 + k) + shared)) for k in range(12)] + [(5, " ".join(varied(40, 400)))]
    docs = [(k, " ".join(varied(5, 900) + t.split()[:34] + varied(5, 901))) for k, (_, t) in enumerate(items)] + [(50, " ".join(shared * 3))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(k, item) for k, (item, _) in enumerate(items)}
    for chars in (300, 8_000_000):
        assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(d, i, block_chars=chars).collect()} == want
    assert len(leaks.item_blocks(i, 300)) > 1 and len(leaks.common_grams(i, 4, 0.01, 12)) == 9


def test_words_as_read():
    assert words("Ca​fé  mis-\ntook &amp; <i>Тhе</i> “End”") == ["cafe", "mistook", "the", "end"]
    assert words(None) == [] and words("") == []


# --- spam ----------------------------------------------------------------------------------------------------------


def test_trees_learn_held_out_rows():
    r = np.random.default_rng(0)
    x = r.random((600, 5))
    y = ((x[:, 0] > 0.5) & (x[:, 2] < 0.7)).astype(float)
    p = vote(fit_bag(x[:400], y[:400], depth=4), x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.93
    assert vote(fit_bag(x[:10], np.ones(10)), x[:2]).tolist() == [1.0, 1.0]


def test_spam(spark):
    good = [(k, prose(12, k), f"h{k % 3}.example") for k in range(60)]
    good += [(70, "Contents\n\n" + "\n".join(f"I. The {w} of the {v} ..... {k}" for k, (w, v) in enumerate(zip(WORDS, WORDS[5:]))), "h1.example"), (71, prose(10, 3) + "\n\n#sea #salt #rain", "h1.example")]
    bad = [(100 + k, " ".join(f"cheap {WORDS[k]} buy" for _ in range(60)), "h4.example") for k in range(12)] + [(120, "\n".join(f'<a href="//x{k}.example/{k}">{w}</a>' for k, w in enumerate(WORDS)), None), (121, " ".join(f"#{a}{b}" for a in WORDS[:6] for b in WORDS[:6]), "h4.example"), (122, ", ".join(f"{WORDS[3]} in {w}" for w in WORDS * 3) + ". " + prose(1, 1), "h4.example")]
    odd = [(200, None, "h4.example"), (201, "", None), (202, " \n", "h4.example"), (203, prose(4000, 1), "h4.example")]
    df = spark.createDataFrame([(*r, 1.0) for r in good + bad + odd], "doc_id long, text string, source string, score double")
    got = {r.doc_id: r.is_spam for r in spam.find_spam(df).collect()}
    assert {k for k, v in got.items() if v} == {r[0] for r in bad} and len(got) == len(good + bad + odd)
    assert spam.find_spam(df.limit(0)).count() == 0
    assert spam.find_spam(df.drop("source").filter("doc_id < 50")).filter("is_spam").count() == 0


# --- queries -------------------------------------------------------------------------------------------------------


def test_queries_over_the_smallest_tables(spark):
    folder = "/root/testdata/sf0.001"
    want = {"p1_found": ["record_kind", "record_id"], "p3_found": ["gen_id"], "p4_found": ["pair_table", "pair_id", "defect"], "p5_found": ["entity_kind", "value_a", "value_b"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"]}
    for name, columns in want.items():
        df = queries.queries()[name](spark, folder)
        assert df.columns == columns
        rows = df.collect()
        assert len(rows) == len(set(rows)), name
