"""Queries that put columns into a notation and read them back with the operators; the SQL gives the columns themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code as R
from ..functions import conversation as C
from ..functions import extract as X
from ..functions import interpreter as I
from ..functions import scores as S
from ..functions import text as T
from ..generation import tasks
from ..operators import datasets as D
from ..operators import select as L
from ..sources.readers import Source, load
from ..sources.sinks import html_page, markdown_row, write_csv, write_parquet
from .registry import query, table


def texts(*parts: str | Column) -> Column:
    """The parts as one text; a part that is no column is a literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.coalesce("source", F.lit("none")).alias("s"), F.col("n_chars").alias("n"), F.coalesce("kind", F.lit("?")).alias("k"))


DOCS = "d AS (SELECT doc_id, coalesce(source, 'none') AS s, n_chars AS n, coalesce(kind, '?') AS k FROM documents)"


@query(f"""WITH {DOCS} SELECT doc_id, 'x = ' || n AS python, 2 AS n_fences, 'x = ' || n || chr(10) || '{{"n": ' || n || '}}' || chr(10) || s AS code, n AS json_n, 'not json' AS kept FROM d""")
def fenced_blocks(spark: SparkSession, folder: str) -> DataFrame:
    c, bad = F.col("c"), F.lit("```json\nnot json\n```")
    d = documents(spark, folder).withColumn("c", texts("Intro\n```python\nx = ", F.col("n"), "\n```\nthen\n```json\n{\"n\": ", F.col("n"), "}\n```\n<code> ", F.col("s"), " </code>"))
    one = texts("```json\n{\"n\": ", F.col("n"), "}\n```")
    value = lambda b, path, kind: F.try_variant_get(F.try_element_at(X.json_blocks(b), F.lit(1)), path, kind)
    return d.select("doc_id", F.try_element_at(X.code_fences(c, "python"), F.lit(1)).alias("python"), F.size(X.code_fences(c)).alias("n_fences"), X.code_blocks(c).alias("code"), value(one, "$.n", "long").alias("json_n"), value(bad, "$.text", "string").alias("kept"))


@query(f"WITH {DOCS} SELECT doc_id, s AS topic, n::VARCHAR AS size, '- ' || s || chr(10) || '- ' || n AS bullets, k AS last_summary, 2 AS n_summaries, 'a' AS first_summary, s AS topic_tag, NULL::VARCHAR AS without FROM d")
def tag_values(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c")
    d = documents(spark, folder).withColumn("c", texts("<instruction><topic> ", F.col("s"), " </topic><size>", F.col("n"), "</size></instruction>\n<summary>a</summary> <summary>", F.col("k")))
    m, x = X.instruction_tags(c), X.xml_tags_udf(c)
    needed = F.udf(lambda t: (X.xml_tags(t, ["absent"]) or {}).get("absent"), "string", useArrow=True)
    return d.select("doc_id", m["topic"].alias("topic"), m["size"].alias("size"), X.bullet_list(m).alias("bullets"), X.last_in_tag(c, "summary").alias("last_summary"), F.size(X.between_tags(c, "summary")).alias("n_summaries"), x["summary"].alias("first_summary"), x["topic"].alias("topic_tag"), needed(c).alias("without"))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 23 AS a, n_chars % 27 AS b, doc_id % 7 AS e FROM documents), c AS (SELECT *, least(a, 20) + least(b, 20) + least(e, 20) AS t FROM d)
       SELECT doc_id, a::DOUBLE AS clarity, b::DOUBLE AS tone, e::DOUBLE AS pacing, (a + b + e)::DOUBLE AS total, round(t / 60.0, 2)::DOUBLE AS reward, a::DOUBLE AS first_of_two FROM c"""
)
def judged_lines(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", (F.col("doc_id") % 23).alias("a"), (F.col("n_chars") % 27).alias("b"), (F.col("doc_id") % 7).alias("e"))
    m = X.judge_scores(texts("clarity: ", F.col("a"), "\n tone : Score ", F.col("b"), "\npacing: [", F.col("e"), "]"))
    other = F.create_map(F.lit("clarity"), F.lit(1.0), F.lit("depth"), F.lit(2.0))
    both = L.common_pair_scores(F.col("m"), other)
    d = d.withColumn("m", m)
    return d.select("doc_id", *[F.col("m")[c].alias(c) for c in ("clarity", "tone", "pacing")], S.total(F.col("m")).alias("total"), S.judge_reward(F.col("m")).alias("reward"), both["clarity"]["a"].alias("first_of_two"))


@query(f"WITH {DOCS} SELECT doc_id, 'ask ' || s || '|f(' || n || ')|ok|done' AS parts, 'f(' || n || ')' AS tool_call, (doc_id % 2 = 0) AS four FROM d")
def prefixed_parts(spark: SparkSession, folder: str) -> DataFrame:
    d = documents(spark, folder).withColumn("c", texts("User: ask ", F.col("s"), "\nCall: f(", F.col("n"), ")\nResult: ok\nAgent: done"))
    more = F.when(F.col("doc_id") % 2 == 0, F.col("c")).otherwise(texts(F.col("c"), "\nTask: more"))
    return d.select("doc_id", F.array_join(X.prefixed_lines(F.col("c")), "|").alias("parts"), X.tool_row(F.col("c"))["tool_call"].alias("tool_call"), X.tool_row(more).isNotNull().alias("four"))


@query(
    f"""WITH {DOCS} SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END::INT AS fiction, s AS doc, 'f' || n AS asserted, '1' || n AS hashed, 'cat' AS category, s || ' Lee' AS author, 't_' || n AS title,
        'a_b_' || doc_id || '_x_m_l' AS snake, (doc_id % 2 = 0) AS parses, 'f' AS called, n::VARCHAR AS argument, n AS given FROM d"""
)
def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    s, n, i = F.col("s"), F.col("n"), F.col("doc_id")
    label = F.when(i % 3 == 0, "It is Narrative Fiction.").when(i % 3 == 1, "This is not narrative fiction, I think").otherwise("No label")
    title = X.title_parts(texts("[cat] ", s, " Lee -- t_", n))
    call = X.call_parts_udf(texts("f(", n, ", 'x', k=[1])"))
    program = F.when(i % 2 == 0, texts("x = ", n)).otherwise(texts("x = = ", n))
    given = F.try_variant_get(X.tool_input(texts('{"v": ', n, "}")), "$.v", "long")
    return documents(spark, folder).select(
        "doc_id", X.fiction_label(label).alias("fiction"), X.docstring(texts('def f():\n    """', s, '"""\n    return 1')).alias("doc"), X.asserted_function(texts("x = 1\nassert f", n, " (1) == 2")).alias("asserted"),
        X.hash_answer(texts("so\n#### $1,", n)).alias("hashed"), title["category"].alias("category"), title["author"].alias("author"), title["title"].alias("title"), T.snake_case(texts("aB_", i, "XML")).alias("snake"),
        X.python_parses_udf(program).alias("parses"), call["name"].alias("called"), call["args"][0].alias("argument"), given.alias("given"),
    )


@query("SELECT id, 'Fantasy|' || title AS category, 'loose' AS other, (id % 2 = 0) AS wanted FROM (SELECT DISTINCT id, title FROM books WHERE title IS NOT NULL AND NOT contains(title, ';') AND NOT contains(title, ':'))")
def shelf_maps(spark: SparkSession, folder: str) -> DataFrame:
    """Shelves of every title that has none of the notation's own marks."""
    b = table(spark, folder, "books").filter("title is not null").filter(~F.col("title").contains(";") & ~F.col("title").contains(":")).select("id", "title").distinct()
    m = X.bookshelves(texts("Category: Fantasy ; Category: ", F.col("title"), ";loose; ", F.when(F.col("id") % 2 == 1, "Category: Poetry").otherwise("Topic: x")))
    return b.withColumn("m", m).select("id", F.array_join(F.slice(F.col("m")["Category"], 1, 2), "|").alias("category"), F.array_join(F.col("m")["Other"], "|").alias("other"), D.wanted_shelves(F.col("m")).alias("wanted"))


@query(
    """SELECT doc_id, (CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE 0.5 END)::DOUBLE AS hard, (CASE WHEN doc_id % 2 = 0 THEN 2.0 ELSE 1.5 END)::DOUBLE AS soft, 1.0::DOUBLE AS sizes, 0.0::DOUBLE AS four, 'w' || doc_id || '|b|c|d' AS first FROM documents"""
)
def group_scores(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("doc_id")
    w = texts("w", i)
    solution = F.array(F.array(w, F.lit("b"), F.lit("c"), F.lit("d")), F.array(*map(F.lit, "efgh")))
    given = S.parsed_groups(texts("<group>", w, ", b,c , d</group> then <group>e, f, ", F.when(i % 2 == 0, "g, h").otherwise("x, y"), "</group>"))
    return table(spark, folder, "documents").select("doc_id", given.alias("g")).select("doc_id", S.hard_groups(solution, F.col("g")).alias("hard"), S.soft_groups(solution, F.col("g")).alias("soft"), S.group_sizes(F.col("g")).alias("sizes"), S.group_count(F.col("g")).alias("four"), F.array_join(F.col("g")[0], "|").alias("first"))


@query(
    """SELECT doc_id, (CASE WHEN doc_id % 5 = 0 THEN 0.0 ELSE 2.0 END)::DOUBLE AS correct, 0.5::DOUBLE AS whole, (CASE WHEN doc_id % 3 = 0 THEN 0.25 ELSE 0.0 END)::DOUBLE AS strict, 0.5::DOUBLE AS soft,
              round(0.5 - CASE WHEN doc_id % 3 = 0 THEN 0.001 * (length(n_chars::VARCHAR) + 11) ELSE 0.001 * (length(n_chars::VARCHAR) + 16) + 0.001 * 5 END, 6)::DOUBLE AS marks FROM documents"""
)
def answer_rewards(spark: SparkSession, folder: str) -> DataFrame:
    """Rewards of answers in the tagged form, a third of them exactly in it."""
    i, n = F.col("doc_id"), F.col("n_chars")
    c = texts("<reasoning>\nr\n</reasoning>\n<answer>\n", n, "\n</answer>\n", F.when(i % 3 == 0, "").otherwise("extra"))
    gold = F.when(i % 5 == 0, "none").otherwise(n.cast("string"))
    return table(spark, folder, "documents").select("doc_id", S.correctness(c, gold).alias("correct"), S.integer_reward(c).alias("whole"), S.strict_format(c).alias("strict"), S.soft_format(c).alias("soft"), F.round(S.xml_count(c), 6).alias("marks"))


@query(
    """WITH e AS (SELECT event_id, value AS v, (event_id % 10)::DOUBLE / 2 AS w FROM events WHERE value IS NOT NULL)
       SELECT event_id, round(ln(1 + exp(-0.1 * (v - w))), 6) AS loss, (v > w)::INT::DOUBLE AS accuracy, round(0.1 * (v - w), 6) AS margin, round(1 / (1 + exp(w - v)), 6) AS likely, round(abs(v - w), 6) AS gap, round(50 - w, 6) AS slop_score FROM e"""
)
def preference_terms(spark: SparkSession, folder: str) -> DataFrame:
    v, w = F.col("value"), (F.col("event_id") % 10) / 2
    loss, accuracy, margin = S.preference_metrics(v, w)
    scored = S.with_slop(F.create_map(F.lit("Clarity"), F.lit(1.0)), w)
    return table(spark, folder, "events").filter("value is not null").select("event_id", F.round(loss, 6).alias("loss"), accuracy, F.round(margin, 6).alias("margin"), F.round(S.pair_probability(v, w), 6).alias("likely"), F.round(F.abs(v - w), 6).alias("gap"), F.round(scored["Slop"], 6).alias("slop_score"))


@query("SELECT doc_id, '-100,' || n_chars || ',-100' AS labels, '7,' || n_chars AS bare, 0 AS none FROM documents")
def unmasked_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = F.array(F.lit(7), F.col("n_chars").cast("int"), F.lit(9))
    bare = C.unpadded(F.array(F.lit(7), F.col("n_chars").cast("int"), F.lit(0), F.lit(0)))
    return table(spark, folder, "documents").select("doc_id", F.array_join(C.masked_labels(ids, F.array(F.lit(0), F.lit(1), F.lit(0))).cast("array<string>"), ",").alias("labels"), F.array_join(F.when(F.col("n_chars") == 0, F.array(F.lit(7), F.col("n_chars").cast("int"))).otherwise(bare).cast("array<string>"), ",").alias("bare"), F.size(C.unpadded(F.array(F.lit(0)))).alias("none"))


GOODY = "g AS (SELECT DISTINCT row_id, instruction AS q, response AS a FROM goody WHERE instruction IS NOT NULL AND response IS NOT NULL AND NOT regexp_matches(instruction || response, '(USER|ASSISTANT|FUNCTION RESPONSE): '))"


@query(
    rf"""WITH {GOODY}, s AS (SELECT row_id, regexp_replace(q, '^\s+|\s+$', '', 'g') AS q, regexp_replace(a, '^\s+|\s+$', '', 'g') AS a FROM g)
        SELECT row_id, 'system: Be kind.' || chr(10) || 'user: ' || q || chr(10) || 'assistant: ' || a || chr(10) || 'tool: ok' AS from_chat, 4 AS n_messages FROM s"""
)
def chat_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs written as one chat text and read back as messages; the few that hold a turn mark themselves are left to chat_logs."""
    g = table(spark, folder, "goody").filter("instruction is not null and response is not null").filter(~F.concat("instruction", "response").rlike("(USER|ASSISTANT|FUNCTION RESPONSE): ")).select("row_id", "instruction", "response").distinct()
    m = C.from_chat(texts("USER: ", F.col("instruction"), " ASSISTANT: ", F.col("response"), " FUNCTION RESPONSE: ok"), F.lit("SYSTEM: Be kind."))
    return g.select("row_id", m.alias("m")).select("row_id", C.transcript(F.col("m")).alias("from_chat"), F.size("m").alias("n_messages"))


PAIRS = "g AS (SELECT DISTINCT row_id, instruction AS q, response AS a FROM goody WHERE instruction IS NOT NULL AND response IS NOT NULL)"


@query(
    f"""WITH {PAIRS} SELECT row_id, 'Context: ' || a || chr(10) || 'Question: ' || q || chr(10) || 'Answer:' AS prompt, CASE WHEN row_id % 2 = 0 THEN a ELSE 'Cannot answer this question' END AS label,
        'user: ' || q || chr(10) || 'assistant: <thought>one</thought>' || chr(10) || '<thought>two</thought>' || chr(10) || '<solution>' || chr(10) || a || chr(10) || '</solution>' AS thoughts,
        'system: S' || chr(10) || 'user: ' || q || chr(10) || 'assistant: ' || a AS instruction, '42' AS marked, 'user: ' || q || chr(10) || 'assistant: ' || a AS valued,
        'user: S' || chr(10) || 'assistant: T' AS summarised, 'assistant: Bot: ' || a AS prefixed, 'dungeon_master=' || q || '|player=' || a AS roles FROM g"""
)
def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    q, a = F.col("instruction"), F.col("response")
    g = table(spark, folder, "goody").filter("instruction is not null and response is not null").select("row_id", "instruction", "response").distinct()
    prompt, label = D.question_row(a, q, F.when(F.col("row_id") % 2 == 0, F.array(a)).otherwise(F.array().cast("array<string>")))
    pairs = F.array(F.struct(F.lit("human").alias("from"), q.alias("value")), F.struct(F.lit("gpt").alias("from"), a.alias("value")))
    _, marked = D.arithmetic_row(q, texts("work\n#### 4", F.lit("2")))
    roles = F.transform(D.alternating_roles(F.array(q, a)), lambda m: F.concat(m["role"], F.lit("="), m["content"]))
    return g.select(
        "row_id", prompt, label, C.transcript(D.thought_row(q, F.array(F.lit("one"), F.lit("two")), a)).alias("thoughts"), C.transcript(D.instruction_row(q, a, "S")).alias("instruction"), marked.alias("marked"),
        C.transcript(C.from_pairs(pairs)).alias("valued"), C.transcript(D.summary_row(F.lit("S"), F.lit("T"))).alias("summarised"), C.transcript(D.character_row(F.array(C.message("Bot", a)), "Bot")).alias("prefixed"), F.array_join(roles, "|").alias("roles"),
    )


@query(
    """WITH s AS (SELECT DISTINCT scene_id, elements FROM scenes), c AS (SELECT scene_id, len(elements) AS n, len(list_filter(elements, lambda e: e.type = 'action')) AS a, len(list_filter(elements, lambda e: e.type = 'dialogue')) AS d FROM s)
       SELECT scene_id, coalesce(n >= 5 AND a >= 2 AND d >= 2, FALSE) AS rich FROM c"""
)
def rich_scenes(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "scenes").select("scene_id", "elements").distinct()
    return s.select("scene_id", D.scene_is_rich(F.to_json("elements")).alias("rich"))


@query(
    """WITH m AS (SELECT DISTINCT gen_id, added_messages FROM generations), b AS (SELECT gen_id, bool_or(coalesce(contains(lower(b.text), 'the'), FALSE)) AS has FROM (SELECT gen_id, unnest(m.content) AS b FROM (SELECT gen_id, unnest(added_messages) AS m FROM m)) GROUP BY gen_id)
       SELECT m.gen_id, coalesce(b.has, FALSE) AS has_the FROM m LEFT JOIN b USING (gen_id) WHERE added_messages IS NOT NULL"""
)
def messages_with_a_word(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "generations").filter("added_messages is not null").select("gen_id", "added_messages").distinct()
    return g.select("gen_id", D.any_part_contains(F.col("added_messages"), "the").alias("has_the"))


@query(
    """SELECT doc_id, CASE WHEN kind = 'roleplay' THEN 'roleplay' WHEN lang IS NOT NULL THEN 'conversation' ELSE 'generic' END AS row_kind, CASE WHEN doc_id % 2 = 1 THEN 1 ELSE 0 END AS winner, CASE doc_id % 7 WHEN 2 THEN 'CODEFORCES' WHEN 5 THEN 'ATCODER' ELSE 'other' END AS code,
              coalesce(lang, source) AS message, 2 AS passed, 3 AS total, 'a1' AS solutions FROM documents"""
)
def row_kinds(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", F.when(F.col("kind") == "roleplay", F.lit("x")).alias("actions"), F.when(F.col("lang").isNotNull(), F.array(F.col("lang"))).alias("messages"), F.array("source").alias("trajectory"))
    name = D.code_name(F.col("doc_id") % 7, D.CONTEST_SOURCES)
    passed, total = D.pass_counts(F.array(F.array(F.lit(True), F.lit(False)), F.array(F.lit(True))))
    solutions = D.solutions_in(F.struct(F.array(F.lit(2), F.lit(3)).alias("language"), F.array(F.lit("c"), F.lit("a1"), F.lit("b")).alias("solution")), 3)
    kind = D.row_kind(d.select("doc_id", "actions", "messages"))
    return d.select("doc_id", kind.alias("row_kind"), D.winner_label(F.col("doc_id") % 2).alias("winner"), F.when(name.isin("CODEFORCES", "ATCODER"), name).otherwise("other").alias("code"), D.messages_of(d)[0].alias("message"), passed, total, F.array_join(solutions, "|").alias("solutions"))


@query(
    """WITH p AS (SELECT lang AS t, kind AS g, count(*) AS n FROM documents WHERE lang IS NOT NULL AND kind IS NOT NULL GROUP BY 1, 2), x AS (SELECT CASE WHEN t IN ('en', 'de') THEN t ELSE 'z' END AS t, CASE WHEN g = 'page' THEN 'en' WHEN g = 'chapter' THEN 'de' ELSE 'z' END AS g, n FROM p),
            r AS (SELECT t AS k, sum(n) AS real, sum(CASE WHEN t = g THEN n ELSE 0 END) AS hit FROM x GROUP BY 1), s AS (SELECT g AS k, sum(n) AS said FROM x GROUP BY 1),
            c AS (SELECT coalesce(r.k, s.k) AS k, coalesce(real, 0) AS real, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM r FULL JOIN s ON r.k = s.k), f AS (SELECT CASE WHEN said > 0 THEN hit / said ELSE 0 END AS p, CASE WHEN real > 0 THEN hit / real ELSE 0 END AS q FROM c)
       SELECT round(avg(p), 6) AS "precision", round(avg(q), 6) AS recall, round(avg(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END), 6) AS f1 FROM f"""
)
def macro_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Languages guessed from the kind, as a measured classifier."""
    d = table(spark, folder, "documents").filter("lang is not null and kind is not null")
    d = d.select(F.when(F.col("lang").isin("en", "de"), F.col("lang")).otherwise("z").alias("t"), F.when(F.col("kind") == "page", "en").when(F.col("kind") == "chapter", "de").otherwise("z").alias("g"))
    return D.macro_scores(d, "t", "g").select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    """WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS hi, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS lo, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE value IS NOT NULL)
       SELECT a.user_id, a.event_id AS event_id_chosen, b.event_id AS event_id_rejected FROM r a JOIN r b ON a.user_id = b.user_id AND a.hi = 1 AND b.lo = 1 WHERE a.n > 1 AND a.value > 0"""
)
def best_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id", "value")
    return L.best_of_n(e, "user_id", "value", "event_id", ["event_id"]).select("user_id", "event_id_chosen", "event_id_rejected")


@query("SELECT event_type, round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS mean FROM events GROUP BY 1")
def means_without_nan(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("v"))
    return e.groupBy("event_type").agg(F.round(L.nan_mean("v"), 6).alias("mean"))


@query(
    """SELECT g.row_id, 'Use a tool: ' || g.q AS prompt, 'f(' || g.row_id || ')' AS chosen, 'f(' || (g.row_id + g.row_id % 2) || ')' AS rejected FROM (SELECT DISTINCT row_id, instruction AS q FROM goody WHERE instruction IS NOT NULL) g WHERE g.row_id % 2 = 1"""
)
def call_preferences(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "goody").filter("instruction is not null").select("row_id", F.concat(F.lit("Use a tool: "), "instruction").alias("prompt")).distinct()
    expected = g.withColumn("call", texts("f(", F.col("row_id"), ")"))
    submitted = g.withColumn("call", texts(" f(", F.col("row_id") + F.col("row_id") % 2, ")")).select("row_id", "call")
    return D.call_preferences(expected, submitted, "row_id").withColumn("rejected", F.trim("rejected"))


@query("SELECT DISTINCT row_id, instruction FROM goody WHERE instruction <> '' AND NOT contains(instruction, chr(10)) AND len(string_split(instruction, ' ')) <= 10 AND length(instruction) <= 128")
def short_instructions(spark: SparkSession, folder: str) -> DataFrame:
    """Instructions of one line, ten words and 128 characters at most."""
    return table(spark, folder, "goody").select("row_id", "instruction").distinct().filter(tasks.short_prompt(F.col("instruction")))


@query("SELECT n_nationkey, TRUE AS ok, (2 * n_nationkey)::VARCHAR AS printed, 1 AS passed, 2 AS total, (n_nationkey % 2 = 0) AS case_holds, n_nationkey + 1 AS interpreted FROM nation")
def run_programs(spark: SparkSession, folder: str) -> DataFrame:
    """Programs made of numbers: run, tested, held against expected output, and interpreted."""
    k = F.col("n_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", R.best_snippet_udf(texts("Here:\n```python\nprint(2 * ", k, ")\n```")).alias("code"))
    r, t = R.run_code_udf("code"), R.run_tests_udf(texts("def f(x):\n    return x + ", k), texts("assert f(0) == ", k, "\nassert f(1) == ", k), F.lit(None).cast("string"))
    c = R.run_cases_udf(F.lit("print(int(input()) * 2)"), F.array(k.cast("string")), F.array((2 * k + k % 2).cast("string")))
    value = I.interpret_udf(texts("x = 0\nfor i in range(", k, " + 1):\n    x += 1\nx"))
    return n.select("n_nationkey", r.alias("r"), t.alias("t"), c.alias("c"), value.alias("v")).select("n_nationkey", "r.ok", F.trim(F.replace("r.stdout", F.lit("\n"), F.lit(""))).alias("printed"), "t.passed", "t.total", F.col("c")[0].alias("case_holds"), F.col("v.value").cast("long").alias("interpreted"))


@query(
    """WITH p AS (SELECT DISTINCT row_id, prompt, text, category, author, title FROM processed_rows) SELECT row_id, 'user: ' || prompt || chr(10) || 'assistant: ' || text AS conversation FROM p
       WHERE prompt IS NOT NULL AND text IS NOT NULL AND category IS NOT NULL AND author IS NOT NULL AND title IS NOT NULL AND category NOT IN ('Gothic', 'Satire')"""
)
def complete_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without any null, but for two categories, as conversations."""
    p = table(spark, folder, "processed_rows").select("row_id", "prompt", "text", "category", "author", "title").distinct().na.drop("any").filter(~F.col("category").isin("Gothic", "Satire"))
    return p.select("row_id", C.transcript(F.array(C.message("user", F.col("prompt")), C.message("assistant", F.col("text")))).alias("conversation"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines FROM documents WHERE len(string_split(text, chr(10))) >= 10")
def long_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of ten lines and more."""
    return table(spark, folder, "documents").filter(D.has_lines(F.col("text"), 10)).select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"))


@query(
    """WITH e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(response, '&', '&amp;', 'g'), '<', '&lt;', 'g'), '>', '&gt;', 'g'), '"', '&quot;', 'g') AS r FROM (SELECT DISTINCT row_id, model_id, response FROM goody))
       SELECT row_id, '## ' || row_id || CASE WHEN model_id IS NULL THEN '' ELSE chr(10) || chr(10) || '**model**' || chr(10) || chr(10) || model_id END || CASE WHEN response IS NULL THEN '' ELSE chr(10) || chr(10) || '**response**' || chr(10) || chr(10) || response END AS markdown,
              '<!doctype html><html><head><title>' || row_id || '</title></head><body>' || chr(10) || '<div class="bot"><b>bot</b> ' || coalesce(replace(r, chr(10), '<br>'), '') || '</div>' || chr(10) || '</body></html>' AS page FROM e"""
)
def report_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What the Markdown and HTML reports write for each row."""
    g = table(spark, folder, "goody").select("row_id", "model_id", "response").distinct()
    turns = F.array(F.struct(F.lit("bot").alias("role"), F.col("response").alias("content")))
    return g.select("row_id", markdown_row(F.col("row_id"), {"model": F.col("model_id"), "response": F.col("response")}).alias("markdown"), html_page(F.col("row_id").cast("string"), turns).alias("page"))


@query(
    """WITH n AS (SELECT n_nationkey AS k, n_name AS name FROM nation) SELECT 'tree' AS what, 'north' AS source, count(*)::BIGINT AS n, sum(k)::BIGINT AS keys FROM n WHERE k % 2 = 0 UNION ALL SELECT 'tree', 'south', count(*), sum(k) FROM n WHERE k % 2 = 1
       UNION ALL SELECT 'shards', 'first two', count(*), sum(k) FROM n WHERE k < 20 UNION ALL SELECT 'newest', 'last', count(*), sum(k) FROM n WHERE k >= 20 UNION ALL SELECT 'phrases', 'two', count(DISTINCT lower(name)), 2 FROM n UNION ALL SELECT 'phrases', 'missing', 0, 0"""
)
def loaded_files(spark: SparkSession, folder: str) -> DataFrame:
    """The nations in trees, shards and lists of files, read back by the readers that are more than a format."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources import readers

    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    at = f"{checkpoint_dir(spark)}/files/{uuid.uuid4().hex}"
    for name, rest in (("north", 0), ("south", 1)):
        n.filter(F.col("k") % 2 == rest).write.option("header", True).csv(f"{at}/tree/{name}")
    fs = spark._jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    path = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    for k, (lo, hi) in enumerate(((0, 10), (10, 20), (20, 99))):
        n.filter(F.col("k").between(lo, hi - 1)).coalesce(1).write.parquet(f"{at}/part{k}")
        (file,) = [f.getPath() for f in fs.listStatus(path(f"{at}/part{k}")) if f.getPath().getName().endswith(".parquet")]
        fs.mkdirs(path(f"{at}/shards"))
        fs.rename(file, path(f"{at}/shards/s{k}.parquet"))
    n.agg(F.to_json(F.collect_list(F.array("name"))).alias("value")).coalesce(1).write.text(f"{at}/phrases")  # 25 rows
    sums = lambda df, what, source: df.agg(F.count("*").alias("n"), F.sum(F.col("k").cast("long")).alias("keys")).select(F.lit(what).alias("what"), F.lit(source).alias("source"), "n", "keys")
    tree = readers.csv_tree(spark, f"{at}/tree", "k long, name string").groupBy(F.lit("tree").alias("what"), "source").agg(F.count("*").alias("n"), F.sum("k").alias("keys"))
    phrases = readers.phrases(spark, f"{at}/phrases", 2).withColumnRenamed("n", "k")
    counted = phrases.agg(F.count("*").alias("n"), F.max("k").cast("long").alias("keys")).select(F.lit("phrases").alias("what"), F.lit("two").alias("source"), "n", "keys")
    none = readers.phrases(spark, f"{at}/none", 3).agg(F.count("*").alias("n")).select(F.lit("phrases").alias("what"), F.lit("missing").alias("source"), "n", F.lit(0).cast("long").alias("keys"))
    return tree.unionByName(sums(readers.first_shards(spark, f"{at}/shards", 2), "shards", "first two")).unionByName(sums(spark.read.parquet(f"{at}/shards/s2.parquet"), "newest", "last")).unionByName(counted).unionByName(none)


@query(
    """WITH n AS (SELECT n_nationkey AS k, n_name AS name FROM nation) SELECT format, count(*)::BIGINT AS n, sum(k)::BIGINT AS keys, min(name) AS first_name FROM n, (VALUES ('parquet'), ('orc'), ('csv'), ('tsv'), ('jsonl'), ('json_map'), ('custom'), ('parquet_sink'), ('csv_sink')) f(format) GROUP BY format"""
)
def loaded_formats(spark: SparkSession, folder: str) -> DataFrame:
    """The nations written in each format and read back through the one dispatch."""
    import uuid

    from ..session import checkpoint_dir
    from ..sources import readers

    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    at = f"{checkpoint_dir(spark)}/formats/{uuid.uuid4().hex}"
    n.write.parquet(f"{at}/parquet"), n.write.orc(f"{at}/orc"), n.write.json(f"{at}/jsonl")
    n.write.option("header", True).csv(f"{at}/csv"), n.write.option("header", True).option("sep", "\t").csv(f"{at}/tsv")
    n.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("k").cast("string"), F.struct("k", "name"))))).alias("value")).coalesce(1).write.text(f"{at}/json_map")  # 25 rows
    write_parquet(n, f"{at}/parquet_sink", per_file=10), write_csv(n, f"{at}/csv_sink")
    readers.CUSTOM["nations"] = lambda s: table(s, folder, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    schema = "k long, name string"
    sources = {f: Source(f, f"{at}/{f}", schema) for f in ("parquet", "orc", "csv", "tsv", "jsonl")} | {"json_map": Source("json_map", f"{at}/json_map", schema), "custom": Source("custom", "nations"), "parquet_sink": Source("parquet", f"{at}/parquet_sink"), "csv_sink": Source("csv", f"{at}/csv_sink", schema)}
    parts = [load(spark, s).select(F.lit(f).alias("format"), F.col("k").cast("long").alias("k"), "name") for f, s in sources.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("format").agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.min("name").alias("first_name"))
