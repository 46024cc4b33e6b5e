"""Conversations: merging, context, rendering, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import conversation as C

CONV = [("system", "S"), ("user", "a"), ("user", "b"), ("assistant", "c")]


def frame(spark, conv=CONV):
    return spark.createDataFrame([(1, conv)], f"id int, c {C.CONVERSATION}")


def test_merged(spark):
    got = frame(spark).select(C.merged(F.col("c")).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == [("system", "S"), ("user", "ab"), ("assistant", "c")]
    assert frame(spark, []).select(C.merged(F.col("c")).alias("m")).first().m == []


def test_merge_turns_keeps_text_and_leaves_no_equal_neighbours(spark):
    rows = [(1, k, r, t) for k, (r, t) in enumerate(CONV)] + [(2, 0, None, "x"), (2, 1, None, "y")]
    got = C.merge_turns(spark.createDataFrame(rows, "k int, i int, role string, text string"), "k", ["i"], "role", "text").orderBy("k", "run").collect()
    assert [(r.role, r.text, r.n_turns) for r in got] == [("system", "S", 1), ("user", "ab", 2), ("assistant", "c", 1), (None, "xy", 2)]


def test_context(spark):
    r = frame(spark).select(F.size(C.last_k(F.col("c"), 2)).alias("two"), F.size(C.last_k(F.col("c"), 9)).alias("all"), F.size(C.all_but_last(F.col("c"))).alias("but"), C.last_of(F.col("c"))["content"].alias("last")).first()
    assert (r.two, r["all"], r.but, r.last) == (2, 4, 3, "c")
    e = frame(spark, []).select(F.size(C.last_k(F.col("c"), 2)).alias("n"), C.last_of(F.col("c")).alias("last")).first()
    assert (e.n, e.last) == (0, None)


def test_rendering(spark):
    c = F.col("c")
    r = frame(spark).select(C.render_im(c).alias("im"), C.render_header(c, prompt=True).alias("h"), C.render_inst(c).alias("i")).first()
    assert r.im.startswith("<|im_start|>system\nS<|im_end|>\n") and r.im.count("<|im_start|>") == 4
    assert r.h.endswith("<|start_header_id|>assistant<|end_header_id|>\n\n")
    assert r.i == "<s>[INST]a[/INST][INST]b[/INST]c</s>"  # the system message is lost: the last message is no user's
    u = frame(spark, [("system", "S"), ("user", "a")]).select(C.render_inst(c).alias("i"), C.render_im(F.slice(c, 2, 1)).alias("d")).first()
    assert u.i == "<s>[INST]S\n\na[/INST]"
    assert "You are a helpful assistant." in u.d


def test_alternation(spark):
    ok = frame(spark, [("system", "S"), ("user", "a"), ("assistant", "b")]).select(C.alternates(F.col("c")).alias("ok")).first().ok
    assert ok and not frame(spark).select(C.alternates(F.col("c")).alias("ok")).first().ok


def test_from_chat(spark):
    df = spark.createDataFrame([("USER: hi \n ASSISTANT: yes\n FUNCTION RESPONSE: {}", "SYSTEM: Be kind.")], "c string, s string")
    got = df.select(C.from_chat(F.col("c"), F.col("s")).alias("m")).first().m
    assert [(m.role, m.content) for m in got] == [("system", "Be kind."), ("user", "hi"), ("assistant", "yes"), ("tool", "{}")]


def test_perspective_opens_with_a_user(spark):
    df = frame(spark, [("dm", "a"), ("player", "b")])
    got = df.select(C.perspective(F.col("c"), "dm", 8, "Begin.").alias("m")).first().m
    assert [m.role for m in got] == ["user", "assistant", "user"]


def test_labels(spark):
    df = spark.createDataFrame([([5, 6, 7], [0, 1, 1])], "ids array<int>, mask array<int>")
    r = df.select(C.masked_labels(F.col("ids"), F.col("mask")).alias("l"), C.prompt_masked(F.col("ids"), F.lit(1), 5).alias("p"), *C.fixed_length(F.col("ids"), 5), C.unpadded(F.array(*map(F.lit, (1, 2, 0, 0)))).alias("u"), C.unpadded(F.array(F.lit(0))).alias("z")).first()
    assert r.l == [-100, 6, 7] and r.p == [-100, 6, 7, -100, -100]
    assert r.input_ids == [5, 6, 7, 0, 0] and r.attention_mask == [1, 1, 1, 0, 0]
    assert r.u == [1, 2] and r.z == []


def test_masking_is_stable(spark):
    df = spark.createDataFrame([(1, list(range(200)))], "k int, ids array<int>")
    f = lambda: df.select(*C.word_masked(F.col("ids"), F.col("k"), 999, 50)).first()
    a, b = f(), f()
    assert a == b
    hit = [i for i, x in enumerate(a.labels) if x != -100]
    assert 10 < len(hit) < 60 and all(a.labels[i] == i for i in hit)


def test_finish_reasons(spark):
    df = spark.createDataFrame([("stop",), ("length",), (None,), ("refusal",)], "r string")
    assert [r.x for r in df.select(C.finish_reason(F.col("r")).alias("x")).collect()] == ["end_turn", "max_tokens", "end_turn", "refusal"]
