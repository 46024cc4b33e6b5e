"""Queries of conversations: messages of generations, turns of scenes, rendering and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions.text import stripped
from .registry import query, table

MSG = "g AS (SELECT DISTINCT gen_id, added_messages FROM generations WHERE added_messages IS NOT NULL), m AS (SELECT gen_id, unnest(added_messages) AS m, generate_subscripts(added_messages, 1) AS i FROM g)"
TEXT = r"regexp_replace(coalesce(array_to_string(list_transform(list_filter(coalesce(m.content, []), lambda b: b.type = 'text' AND b.text IS NOT NULL AND b.text <> ''), lambda b: b.text), chr(10)), ''), '^\s+|\s+$', '', 'g')"


def generations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "generations").filter("added_messages is not null").select("gen_id", "added_messages").distinct()


def simple(c: Column) -> Column:
    """Messages with their text blocks as content."""
    return F.transform(c, lambda m: C.message(m["role"], C.block_text(F.coalesce(m["content"], F.array()))))


@query(f"WITH {MSG} SELECT coalesce(m.role, '?') || '_' || coalesce(b.type, '?') AS kind, count(*)::BIGINT AS n, count(DISTINCT gen_id)::BIGINT AS n_rows FROM (SELECT gen_id, m, unnest(m.content) AS b FROM m) GROUP BY 1")
def role_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    b = generations(spark, folder).select("gen_id", F.explode(C.flat_messages(F.col("added_messages"))).alias("b"))
    kind = F.concat_ws("_", F.coalesce("b.role", F.lit("?")), F.coalesce("b.type", F.lit("?")))
    return b.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("gen_id").alias("n_rows"))


@query(f"WITH {MSG} SELECT gen_id, count(*)::INT AS n_messages, string_agg({TEXT}, '|' ORDER BY i) AS texts FROM m GROUP BY gen_id")
def message_texts(spark: SparkSession, folder: str) -> DataFrame:
    g = generations(spark, folder).select("gen_id", simple(F.col("added_messages")).alias("c")).filter("size(c) > 0")
    return g.select("gen_id", F.size("c").alias("n_messages"), F.array_join(F.transform("c", lambda m: m["content"]), "|").alias("texts"))


@query(
    """SELECT coalesce(CASE finish_reason WHEN 'stop' THEN 'end_turn' WHEN 'length' THEN 'max_tokens' WHEN 'tool_calls' THEN 'tool_use' WHEN 'function_call' THEN 'tool_use' WHEN 'content_filter' THEN 'refusal' ELSE finish_reason END, 'end_turn') AS reason,
       count(*)::BIGINT AS n FROM generations GROUP BY 1"""
)
def finish_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "generations").groupBy(C.finish_reason(F.col("finish_reason")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {MSG}, t AS (SELECT gen_id, i, m.role AS role, {TEXT} AS text FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY gen_id ORDER BY i DESC) AS k FROM t WHERE role = 'assistant') SELECT gen_id, text AS last_answer FROM r WHERE k = 1")
def last_answers(spark: SparkSession, folder: str) -> DataFrame:
    g = generations(spark, folder).select("gen_id", C.last_of(simple(F.col("added_messages"))).alias("m")).filter("m is not null")
    return g.select("gen_id", F.col("m.content").alias("last_answer"))


TURNS = """t AS (SELECT DISTINCT scene_id, e.line_number AS line, i, e.dialogue_data.character AS who, coalesce(e.content, '') AS said
    FROM (SELECT scene_id, unnest(elements) AS e, generate_subscripts(elements, 1) AS i FROM scenes) WHERE e.type = 'dialogue')"""


def turns(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "scenes").select("scene_id", F.posexplode("elements").alias("i", "e")).filter("e.type = 'dialogue'")
    return e.select("scene_id", F.col("e.line_number").alias("line"), (F.col("i") + 1).alias("i"), F.col("e.dialogue_data.character").alias("who"), F.coalesce("e.content", F.lit("")).alias("said")).distinct()


@query(
    f"""WITH {TURNS}, c AS (SELECT *, CASE WHEN who IS NOT DISTINCT FROM lag(who) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY scene_id ORDER BY line NULLS FIRST, i)),
        r AS (SELECT *, sum(new) OVER (PARTITION BY scene_id ORDER BY line NULLS FIRST, i) AS run FROM c)
        SELECT scene_id, run::BIGINT AS run, min(who) AS who, string_agg(said, '' ORDER BY line NULLS FIRST, i) AS said, count(*)::BIGINT AS n_turns FROM r GROUP BY scene_id, run"""
)
def merged_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Successive lines of one character as one turn."""
    return C.merge_turns(turns(spark, folder), "scene_id", ["line", "i"], "who", "said")


@query(
    f"""WITH {TURNS}, n AS (SELECT scene_id, who, said, row_number() OVER (PARTITION BY scene_id ORDER BY line DESC NULLS LAST, i DESC) AS k FROM t)
        SELECT scene_id, string_agg(coalesce(who, '?') || ': ' || said, chr(10) ORDER BY k DESC) AS context, count(*)::INT AS n FROM n WHERE k <= 8 GROUP BY scene_id"""
)
def last_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The last eight turns of each scene."""
    t = turns(spark, folder).groupBy("scene_id").agg(F.array_sort(F.collect_list(F.struct("line", "i", "who", "said"))).alias("c"))
    conv = F.transform(F.col("c"), lambda x: C.message(F.coalesce(x["who"], F.lit("?")), x["said"]))
    last = C.last_k(conv, 8)
    return t.select("scene_id", C.transcript(last).alias("context"), F.size(last).alias("n"))


IM = """'<|im_start|>' || {r} || chr(10) || {c} || '<|im_end|>' || chr(10)"""
CHAT = "c AS (SELECT DISTINCT row_id, instruction, coalesce(response, '') AS response, model_id FROM goody WHERE instruction IS NOT NULL)"


def chats(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "goody").filter("instruction is not null").select("row_id", "instruction", F.coalesce("response", F.lit("")).alias("response"), "model_id").distinct()
    return g.select("row_id", "instruction", "response", F.array(C.message("user", F.col("instruction")), C.message("assistant", F.col("response"))).alias("c"))


@query(f"WITH {CHAT} SELECT row_id, {IM.format(r="'system'", c="'You are a helpful assistant.'")} || {IM.format(r="'user'", c='instruction')} || {IM.format(r="'assistant'", c='response')} AS rendered FROM c")
def rendered_im(spark: SparkSession, folder: str) -> DataFrame:
    return chats(spark, folder).select("row_id", C.render_im(F.col("c")).alias("rendered"))


@query(
    rf"""WITH {CHAT} SELECT row_id, '<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || regexp_replace(instruction, '^\s+|\s+$', '', 'g') || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)
        || regexp_replace(response, '^\s+|\s+$', '', 'g') || '<|eot_id|>' AS rendered FROM c"""
)
def rendered_header(spark: SparkSession, folder: str) -> DataFrame:
    return chats(spark, folder).select("row_id", C.render_header(F.col("c")).alias("rendered"))


@query(f"WITH {CHAT} SELECT row_id, '<s>[INST]' || instruction || '[/INST]' || response || '</s>' AS rendered FROM c")
def rendered_inst(spark: SparkSession, folder: str) -> DataFrame:
    return chats(spark, folder).select("row_id", C.render_inst(F.col("c")).alias("rendered"))


@query(f"WITH {CHAT} SELECT row_id, 'user: Begin.' || chr(10) || 'assistant: ' || instruction || chr(10) || 'user: ' || response AS seen, TRUE AS alternates FROM c")
def perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """The pair as the asking side sees it, with an opening turn."""
    seen = C.perspective(F.col("c"), "user", 8, "Begin.")
    return chats(spark, folder).select("row_id", C.transcript(seen).alias("seen"), C.alternates(seen).alias("alternates"))


@query(
    """WITH m AS (SELECT gen_id, i, m FROM (SELECT gen_id, unnest(added_messages[greatest(len(added_messages) - 7, 1):]) AS m, generate_subscripts(added_messages[greatest(len(added_messages) - 7, 1):], 1) AS i FROM (SELECT DISTINCT gen_id, added_messages FROM generations WHERE added_messages IS NOT NULL))),
            b AS (SELECT gen_id, i, m.role AS role, k, CASE b.type WHEN 'text' THEN b.text WHEN 'tool_use' THEN '<tool_call>' || '{' || concat_ws(',', '"name":' || to_json(b.name)::VARCHAR, '"input":' || to_json(b.input)::VARCHAR) || '}' || '</tool_call>' WHEN 'tool_result' THEN '<tool_result>' || coalesce(b.text, b.input, '') || '</tool_result>' END AS t
                  FROM (SELECT gen_id, i, m, unnest(m.content) AS b, generate_subscripts(m.content, 1) AS k FROM m)),
            t AS (SELECT gen_id, i, role, string_agg(t, chr(10) ORDER BY k) AS t FROM b WHERE t <> '' GROUP BY gen_id, i, role)
       SELECT gen_id, string_agg(CASE role WHEN 'assistant' THEN 'assistant: ' ELSE 'user: ' END || t, chr(10) ORDER BY i) AS seen FROM t GROUP BY gen_id"""
)
def block_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    """The last eight messages as the assistant sees them, tools as text; rows that leave nothing are left out."""
    g = table(spark, folder, "generations").select("gen_id", "added_messages").filter("added_messages is not null").distinct()
    return g.select("gen_id", C.transcript(C.block_perspective(F.col("added_messages"), "assistant")).alias("seen")).filter("seen <> ''")


@query(
    """WITH g AS (SELECT instruction, row_id, response, row_number() OVER (PARTITION BY instruction ORDER BY length(response) DESC, row_id) AS a, row_number() OVER (PARTITION BY instruction ORDER BY length(response), row_id) AS z, count(*) OVER (PARTITION BY instruction) AS n
            FROM (SELECT DISTINCT row_id, instruction, response FROM goody WHERE instruction IS NOT NULL AND response IS NOT NULL))
       SELECT x.instruction, 'system: Be brief.' || chr(10) || 'user: ' || x.instruction AS prompt, x.response AS chosen, y.response AS rejected FROM g x JOIN g y ON x.instruction = y.instruction AND x.a = 1 AND y.z = 1 WHERE x.n > 1"""
)
def dpo_triplets(spark: SparkSession, folder: str) -> DataFrame:
    """The longest answer to an instruction against the shortest, as prompt, chosen and rejected."""
    from ..operators.select import best_and_worst

    g = table(spark, folder, "goody").filter("instruction is not null and response is not null").select("row_id", "instruction", "response").distinct().withColumn("score", F.length("response"))
    p = best_and_worst(g, "instruction", "score", "row_id", ["response"])
    conv = lambda c: F.array(C.message("user", F.col("instruction")), C.message("assistant", F.col(c)))
    prompt, chosen, rejected = C.triplet(conv("response_chosen"), conv("response_rejected"), "Be brief.")
    return p.select("instruction", prompt, chosen, rejected).withColumn("prompt", C.transcript(F.col("prompt")))


@query(
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '(dungeon_master|player): ', 1) AS r, list_transform(regexp_split_to_array(text, '(?:dungeon_master|player): ')[2:], lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS p FROM documents WHERE regexp_matches(text, '(dungeon_master|player): '))
        SELECT doc_id, len(r)::INT AS n_turns, array_to_string(list_transform(range(1, len(r) + 1), lambda i: r[i] || '=' || p[i]), '|') AS turns FROM d"""
)
def chat_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with turns, cut into them."""
    rx = "(dungeon_master|player): "
    d = table(spark, folder, "documents").filter(F.col("text").rlike(rx)).select("doc_id", F.regexp_extract_all("text", F.lit(rx), F.lit(1)).alias("r"), F.split("text", "(?:dungeon_master|player): ").alias("p"))
    both = F.zip_with("r", F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))), lambda r, p: F.concat(r, F.lit("="), stripped(p)))
    return d.select("doc_id", F.size("r").alias("n_turns"), F.array_join(both, "|").alias("turns"))


@query(
    """SELECT row_id, array_to_string(list_transform(range(1, 25), lambda i: CASE WHEN i <= len(q) OR i > len(q) + len(a) THEN -100 ELSE length(a[i - len(q)]) END), ',') AS labels FROM (
        SELECT DISTINCT row_id, string_split(instruction, ' ') AS q, string_split(response, ' ') AS a FROM goody WHERE instruction IS NOT NULL AND response IS NOT NULL)"""
)
def prompt_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels that leave out the prompt and the padding; ids are word lengths."""
    g = table(spark, folder, "goody").filter("instruction is not null and response is not null").select("row_id", "instruction", "response").distinct()
    ids = lambda c: F.transform(F.split(c, " "), F.length)
    labels = C.prompt_masked(F.concat(ids("instruction"), ids("response")), F.size(ids("instruction")), 24)
    return g.select("row_id", F.array_join(labels.cast("array<string>"), ",").alias("labels"))


@query()
def masked_words(spark: SparkSession, folder: str) -> DataFrame:
    """Masked-word training rows of the prompts; ids are word lengths."""
    g = table(spark, folder, "processed_rows").filter("prompt is not null").select("row_id", "prompt").distinct()
    return g.select("row_id", *C.word_masked(F.transform(F.split("prompt", " "), F.length), F.col("row_id"), 999, 100))
