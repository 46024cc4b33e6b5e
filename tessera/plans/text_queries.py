"""Queries of the text operators: slop, words, paragraphs, headings, extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import scores as S
from ..functions import text as T
from ..operators import documents as D
from ..operators import select as L
from .registry import query, table

W = "[\\p{L}\\p{N}_]+"

#: Phrases of one to three long words of the held-out items.
PHRASES = f"""
    items AS (SELECT item_id, regexp_extract_all(lower(text), '{W}') AS t FROM eval_items),
    phrases AS (
        SELECT DISTINCT 1 AS n, 1.0 AS weight, w AS phrase FROM (SELECT unnest(t) AS w FROM items) WHERE length(w) >= 9
        UNION ALL SELECT DISTINCT 2, 2.0, a || ' ' || b FROM (SELECT unnest(t[1:len(t) - 1]) AS a, unnest(t[2:]) AS b FROM items) WHERE length(a) >= 6 AND length(b) >= 6
        UNION ALL SELECT DISTINCT 3, 8.0, a || ' ' || b || ' ' || c FROM (SELECT unnest(t[1:len(t) - 2]) AS a, unnest(t[2:len(t) - 1]) AS b, unnest(t[3:]) AS c FROM items)
                  WHERE length(a) >= 5 AND length(b) >= 5 AND length(c) >= 5)"""
SLOP = f"""{PHRASES},
    toks AS (SELECT doc_id, lang, source, regexp_extract_all(lower(coalesce(text, '')), '{W}') AS t FROM documents),
    flat AS (
        SELECT doc_id, 1 AS n, unnest(t) AS phrase FROM toks
        UNION ALL SELECT doc_id, 2, unnest(t[1:len(t) - 1]) || ' ' || unnest(t[2:]) FROM toks WHERE len(t) >= 2
        UNION ALL SELECT doc_id, 3, unnest(t[1:len(t) - 2]) || ' ' || unnest(t[2:len(t) - 1]) || ' ' || unnest(t[3:]) FROM toks WHERE len(t) >= 3),
    hits AS (SELECT doc_id, sum(weight) AS w FROM flat JOIN phrases USING (n, phrase) GROUP BY doc_id),
    slop AS (SELECT toks.doc_id, lang, source, len(t) AS n_tokens, CASE WHEN len(t) > 0 THEN 1000.0 * coalesce(w, 0.0) / len(t) ELSE 0.0 END AS slop FROM toks LEFT JOIN hits USING (doc_id))"""


def phrase_list(spark: SparkSession, folder: str) -> DataFrame:
    toks = table(spark, folder, "eval_items").select(T.words(F.col("text")).alias("t"))
    kinds = []
    for n, least in ((1, 9), (2, 6), (3, 5)):
        g = toks.select(F.explode(T.ngrams(F.col("t"), n)).alias("phrase")).distinct()
        kinds.append(g.filter(F.array_min(F.transform(F.split("phrase", " "), F.length)) >= least).select(F.lit(n).alias("n"), "phrase"))
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


def slop(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return S.slop_index(docs, phrase_list(spark, folder))


@query(f"WITH {SLOP} SELECT coalesce(lang, '?') AS lang, count(*)::BIGINT AS n_docs, round(avg(slop), 6) AS mean_slop, round(max(slop), 6) AS max_slop FROM slop GROUP BY 1")
def slop_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang", "text").withColumn("k", F.struct("doc_id", "lang"))
    s = S.slop_index(docs, phrase_list(spark, folder), key="k")
    return s.groupBy(F.coalesce("k.lang", F.lit("?")).alias("lang")).agg(F.count("*").alias("n_docs"), F.round(F.avg("slop"), 6).alias("mean_slop"), F.round(F.max("slop"), 6).alias("max_slop"))


@query(f"WITH {SLOP} SELECT doc_id, n_tokens::INT AS n_tokens, round(slop, 6) AS slop FROM slop ORDER BY round(slop, 6) DESC, doc_id LIMIT 20")
def slop_top_docs(spark: SparkSession, folder: str) -> DataFrame:
    return slop(spark, folder).select("doc_id", "n_tokens", F.round("slop", 6).alias("slop")).orderBy(F.desc("slop"), "doc_id").limit(20)


@query(f"WITH {SLOP} SELECT source, round(avg(greatest(100.0 - slop, 0.0)), 6) AS mean_reward, count(*)::BIGINT AS n FROM slop GROUP BY source")
def antislop_reward(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text").withColumn("k", F.struct("doc_id", "source"))
    s = S.slop_index(docs, phrase_list(spark, folder), key="k").select("k.source", S.antislop(F.col("slop")).alias("r"))
    return s.groupBy("source").agg(F.round(F.avg("r"), 6).alias("mean_reward"), F.count("*").alias("n"))


@query(
    r"""SELECT kind, count(*)::BIGINT AS n, round(avg(w), 6) AS mean_words, round(stddev_samp(w), 6) AS sd_words, round(stddev_pop(w), 6) AS sd_all, sum(w)::BIGINT AS words
    FROM (SELECT coalesce(kind, '?') AS kind, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w FROM documents) GROUP BY kind"""
)
def word_stats(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.coalesce("kind", F.lit("?")).alias("kind"), T.count_words(F.col("text")).alias("w"))
    return d.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("mean_words"), F.round(F.stddev_samp("w"), 6).alias("sd_words"), F.round(F.stddev_pop("w"), 6).alias("sd_all"), F.sum("w").cast("long").alias("words"))


PARAGRAPHS = r"p AS (SELECT id, unnest(string_split(text, chr(10) || chr(10))) AS p FROM books WHERE text IS NOT NULL), s AS (SELECT id, p, regexp_replace(p, '^\s+|\s+$', '', 'g') AS s FROM p)"
FLAGS_SQL = r"""
    regexp_matches(lower(p), '\.png|\.jpg|\.jpeg|\.gif|picture:') AS image,
    (contains(lower(s), 'footnote') AND length(replace(s, ' ', '')) < 50) OR regexp_matches(s, '^\{.+\}|^\[.+\]') AS footnote,
    regexp_matches(p, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+') AS email,
    regexp_matches(p, '[0-9]* copies|copyright') AND length(replace(p, ' ', '')) < 500 AS copies,
    ((n3 > 3 OR nt > 2) AND (j3 > 3 OR jt > 2)) OR length(s) - length(replace(s, '*', '')) > 3 OR length(s) - length(replace(s, '=', '')) > 2 AS tabular,
    length(s) = 0
      OR (length(s) < 5 AND NOT (q = 2 OR length(s) - length(replace(s, '''', '')) = 2 OR ends_with(s, ':')))
      OR len(regexp_extract_all(s, '[\p{Lu}\p{Nd}!#$%&''()*+,./:;<=>?@\[\\\]^_`{|}~-]'))::DOUBLE / greatest(length(replace(s, ' ', '')), 1) > 0.6
      OR starts_with(lower(s), 'appendix') OR regexp_matches(s, '^[%_<>*]')
      OR (c > 3 AND 2 * c - q > 3) OR (contains(s, '@') AND length(s) < 100) OR (contains(lower(s), 'printed in') AND length(s) < 200)
      OR contains(lower(s), 'inc.') OR (contains(lower(s), 'original title') AND length(s) < 200) AS title,
    regexp_matches(p, '^\s*[*_>=+-]+') AS formatted"""
FLAGGED = rf"""{PARAGRAPHS}, t AS (SELECT *, length(s) - length(replace(s, '"', '')) AS q, length(s) - length(replace(s, ':', '')) AS c,
        (length(s) - length(replace(s, '   ', ''))) // 3 AS n3, length(s) - length(replace(s, chr(9), '')) AS nt,
        array_to_string(list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' ') AS j FROM s),
    u AS (SELECT *, (length(j) - length(replace(j, '   ', ''))) // 3 AS j3, length(j) - length(replace(j, chr(9), '')) AS jt FROM t),
    f AS (SELECT id, p, {FLAGS_SQL} FROM u)"""


@query(f"WITH {FLAGGED} SELECT count(*)::BIGINT AS n, count_if(image)::BIGINT AS image, count_if(footnote)::BIGINT AS footnote, count_if(email)::BIGINT AS email, count_if(copies)::BIGINT AS copies, count_if(tabular)::BIGINT AS tabular, count_if(title)::BIGINT AS title, count_if(formatted)::BIGINT AS formatted FROM f")
def paragraph_flags(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "books").filter("text is not null").select("id", F.explode(F.split("text", "\n\n")).alias("p"))
    c = F.col("p")
    flags = {"image": T.is_image(c), "footnote": T.is_footnote(c), "email": T.is_email(c), "copies": T.is_copies_note(c), "tabular": T.is_table(c), "title": T.is_title_or_other(c), "formatted": T.starts_formatted(c)}
    return p.agg(F.count("*").alias("n"), *[F.count_if(v).alias(k) for k, v in flags.items()])


@query(f"WITH {FLAGGED} SELECT id, count(*)::BIGINT AS kept, sum(length(p))::BIGINT AS chars FROM f WHERE NOT (image OR footnote OR email OR copies OR tabular OR title OR formatted) GROUP BY id")
def clean_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "books").filter("text is not null").select("id", F.explode(T.clean_paragraphs(F.col("text"))).alias("p"))
    return b.groupBy("id").agg(F.count("*").alias("kept"), F.sum(F.length("p")).alias("chars"))


HEADING_SQL = r"(?m)\A(?:(?:CHAPTER|PART|BOOK|ACT|SCENE)\s+[IVXLCDM0-9]+\.?|(?:Chapter|Part|Book|Act|Scene)\s+[IVXLCDMivxlcdm0-9]+\.?|[IVXLCDM]+\.|[0-9]+\.)\s*$"
FRONT_MATTER_SQL = (
    r"(?i)\A(?:by\s+[a-z]+(?:\s+[a-z]+)*|contents:?|table\s+of\s+contents|introduction|preface|foreword|dedication|acknowledgements?|copyright|published\s+by|first\s+published|all\s+rights\s+reserved|isbn|illustrated\s+by|edited\s+by|translated\s+by)\s*\z"
)
BLOCKS = r"l AS (SELECT doc_id, coalesce(kind, '?') AS kind, regexp_replace(unnest(string_split(text, chr(10) || chr(10))), '^\s+|\s+$', '', 'g') AS s FROM documents WHERE text IS NOT NULL), w AS (SELECT *, len(list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')) AS n FROM l)"
HEAD_SQL = f"((length(s) < 100 AND regexp_matches(s, '{HEADING_SQL}')) OR (length(s) < 80 AND upper(s) = s AND lower(s) <> s AND n <= 6))"
FRONT_SQL = f"(length(s) < 50 AND regexp_matches(s, '{FRONT_MATTER_SQL}'))"


@query(f"WITH {BLOCKS} SELECT kind, count_if{HEAD_SQL}::BIGINT AS headings, count_if{FRONT_SQL}::BIGINT AS front_matter, count_if(n >= 15 AND NOT {HEAD_SQL} AND NOT {FRONT_SQL})::BIGINT AS narrative FROM w GROUP BY kind")
def headings(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs by what they are."""
    d = table(spark, folder, "documents").filter("text is not null").select(F.coalesce("kind", F.lit("?")).alias("kind"), F.explode(F.split("text", "\n\n")).alias("p"))
    c = F.col("p")
    return d.groupBy("kind").agg(F.count_if(T.is_chapter_heading(c)).alias("headings"), F.count_if(T.is_metadata(c)).alias("front_matter"), F.count_if(T.is_narrative(c)).alias("narrative"))


@query(f"WITH {BLOCKS} SELECT kind, s AS heading, count(*)::BIGINT AS n FROM w WHERE {HEAD_SQL} GROUP BY kind, s")
def heading_frequency(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").filter("text is not null").select(F.coalesce("kind", F.lit("?")).alias("kind"), F.explode(F.split("text", "\n\n")).alias("p"))
    return d.filter(T.is_chapter_heading(F.col("p"))).groupBy("kind", T.stripped(F.col("p")).alias("heading")).agg(F.count("*").alias("n"))


@query(r"SELECT count_if(regexp_matches(text, '[一-鿿]+'))::BIGINT AS with_han, count_if(regexp_matches(text, '[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+'))::BIGINT AS with_email, count(*)::BIGINT AS n, coalesce(lang, '?') AS lang FROM documents GROUP BY 4")
def scripts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(F.count_if(T.has_han(F.col("text"))).alias("with_han"), F.count_if(T.is_email(F.col("text"))).alias("with_email"), F.count("*").alias("n"))


@query(
    r"""SELECT gen_id, CASE WHEN length(c) > 80 THEN left(c, 80) || '...' ELSE c END AS line FROM (
        SELECT DISTINCT gen_id, regexp_replace(replace(regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g'), '<|endoftext|>', ''), '\n+|\t+', '', 'g') AS c FROM generations)"""
)
def message_lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "generations").select("gen_id", T.clean_message(F.col("content"), 80).alias("line")).distinct()


@query(r"SELECT id, left(regexp_replace(replace(lower(title), ' ', '_'), '[^a-z0-9_]', '', 'g'), 20) AS slug, left(sha256(title), 8) AS short_hash, lower(array_to_string(list_transform(string_split(title, ''), lambda x, i: CASE WHEN i > 1 AND regexp_matches(x, '[A-Z]') THEN '_' || x ELSE x END), '')) AS snake FROM books WHERE title IS NOT NULL")
def title_names(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("title")
    return table(spark, folder, "books").filter("title is not null").select("id", T.slug(t).alias("slug"), T.short_hash(t).alias("short_hash"), T.snake_case(t).alias("snake"))


@query(
    r"""SELECT id, regexp_replace(replace(regexp_replace(lower(strip_accents(text)), '[ \t]+', ' ', 'g'), chr(10), '\n'), '^\s+|\s+$', '', 'g') AS line FROM books WHERE text IS NOT NULL AND regexp_full_match(text, '[\x00-\x7F\x{00C0}-\x{017F}’‘“”–—…]*')"""
)
def latin_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Books in Latin letters as single corpus lines; the other scripts, where SQL folds accents another way, are in folded_lines."""
    b = table(spark, folder, "books").filter("text is not null").filter(F.col("text").rlike(r"\A[\x00-\x7F\x{00C0}-\x{017F}’‘“”–—…]*\z"))
    return b.select("id", T.corpus_line(F.col("text")).alias("line"))


@query()
def folded_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Books as single corpus lines, and in plain ASCII."""
    return table(spark, folder, "books").filter("text is not null").select("id", T.corpus_line(F.col("text")).alias("line"), F.length(T.ascii_normal(F.col("text"))).alias("ascii_chars"))


@query(
    r"""WITH g AS (SELECT DISTINCT gen_id, content FROM generations WHERE content IS NOT NULL),
        e AS (SELECT gen_id, regexp_extract_all(content, '(?s)```[A-Za-z0-9_+-]*\n(.*?)\n```', 1) AS code, regexp_extract_all(content, '(?s)<summary>(.*?)(?:</summary>|$)', 1) AS summaries,
              regexp_extract_all(content, '(?s)<answer>(.*?)(?:</answer>|$)', 1) AS answers FROM g)
        SELECT gen_id, len(code)::INT AS n_code, length(array_to_string(code, '|'))::INT AS code_chars, len(summaries)::INT AS n_summary, coalesce(summaries[-1], '') AS summary, len(answers)::INT AS n_answer FROM e
        WHERE len(code) + len(summaries) + len(answers) > 0"""
)
def tagged_parts(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "generations").filter("content is not null").select("gen_id", "content").distinct()
    c = F.col("content")
    e = g.select("gen_id", X.code_fences(c).alias("code"), X.between_tags(c, "summary").alias("summaries"), X.between_tags(c, "answer").alias("answers"))
    e = e.filter(F.size("code") + F.size("summaries") + F.size("answers") > 0)
    return e.select("gen_id", F.size("code").alias("n_code"), F.length(F.array_join("code", "|")).alias("code_chars"), F.size("summaries").alias("n_summary"), F.coalesce(F.try_element_at("summaries", F.lit(-1)), F.lit("")).alias("summary"), F.size("answers").alias("n_answer"))


@query(
    r"""WITH g AS (SELECT DISTINCT gen_id, content FROM generations WHERE content IS NOT NULL),
        a AS (SELECT gen_id, regexp_replace(string_split(string_split(content, '<answer>')[-1], '</answer>')[1], '^\s+|\s+$', '', 'g') AS answer, contains(content, '<answer>') AS tagged FROM g)
        SELECT tagged, count(*)::BIGINT AS n, sum(length(answer))::BIGINT AS chars, count_if(regexp_matches(answer, '^[0-9]+$'))::BIGINT AS whole_numbers FROM a GROUP BY tagged"""
)
def xml_answers(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "generations").filter("content is not null").select("gen_id", "content").distinct()
    a = g.select(X.xml_answer(F.col("content")).alias("answer"), F.col("content").contains("<answer>").alias("tagged"))
    return a.groupBy("tagged").agg(F.count("*").alias("n"), F.sum(F.length("answer")).alias("chars"), F.count_if(F.col("answer").rlike("^[0-9]+$")).alias("whole_numbers"))


@query(
    r"""WITH m AS (SELECT row_id, regexp_extract_all(text, '(?i)(said|asked) ([A-Z][a-z]+)', 2) AS speakers FROM (SELECT DISTINCT row_id, text FROM processed_rows WHERE text IS NOT NULL))
        SELECT speaker, count(*)::BIGINT AS n, count(DISTINCT row_id)::BIGINT AS n_rows FROM (SELECT row_id, unnest(speakers) AS speaker FROM m) GROUP BY speaker"""
)
def speakers(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "processed_rows").filter("text is not null").select("row_id", "text").distinct()
    s = r.select("row_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?i)(said|asked) ([A-Z][a-z]+)"), F.lit(2))).alias("speaker"))
    return s.groupBy("speaker").agg(F.count("*").alias("n"), F.count_distinct("row_id").alias("n_rows"))


@query(
    r"""SELECT step, n::INT AS n, sides::INT AS sides, modifier::INT AS modifier, count(*)::BIGINT AS rolls FROM (
        SELECT m AS step, coalesce(nullif(regexp_extract(m, '^([0-9]*)d([0-9]+)([+-][0-9]+)?$', 1), '')::INT, 1) AS n, regexp_extract(m, '^([0-9]*)d([0-9]+)([+-][0-9]+)?$', 2)::INT AS sides,
               coalesce(nullif(regexp_extract(m, '^([0-9]*)d([0-9]+)([+-][0-9]+)?$', 3), '')::INT, 0) AS modifier
        FROM (SELECT unnest(regexp_extract_all(text, '[0-9]*d[0-9]+(?:[+-][0-9]+)?')) AS m FROM documents WHERE text IS NOT NULL)) GROUP BY ALL"""
)
def dice_rolls(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]*d[0-9]+(?:[+-][0-9]+)?"), F.lit(0))).alias("step"))
    p = d.select("step", X.dice(F.col("step")).alias("d"))
    return p.groupBy("step", "d.n", "d.sides", "d.modifier").agg(F.count("*").alias("rolls"))


@query(
    r"""WITH d AS (SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(string_split(text, ','), lambda x: trim(x, ' ')), lambda x: x <> ''))) AS s FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, len(s)::INT AS n, array_to_string(s, '|') AS parts FROM d"""
)
def comma_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The stretches between the commas of each document as a set."""
    d = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.col("text").alias("c"))
    s = F.array_sort(F.array_distinct(F.filter(F.transform(F.split("c", ","), lambda x: F.trim(x)), lambda x: x != "")))
    return d.select("doc_id", F.size(s).alias("n"), F.array_join(s, "|").alias("parts"))


#: The latest text of each book with one kind of line break (no book of the tables has a licence header to strip), its kept paragraphs in order with their size in words and punctuation marks, and the fold over them.
CHUNKS = rf"""latest AS (SELECT id, title, author, regexp_replace(regexp_replace(text, '\r\n|[\r\x0B\x0C\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]', chr(10), 'g'), '\n$', '') AS text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST) AS k FROM books WHERE text IS NOT NULL) WHERE k = 1),
    p AS (SELECT id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM latest),
    s AS (SELECT *, regexp_replace(p, '^\s+|\s+$', '', 'g') AS s FROM p),
    t AS (SELECT *, length(s) - length(replace(s, '"', '')) AS q, length(s) - length(replace(s, ':', '')) AS c, (length(s) - length(replace(s, '   ', ''))) // 3 AS n3, length(s) - length(replace(s, chr(9), '')) AS nt,
        array_to_string(list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' ') AS j FROM s),
    u AS (SELECT *, (length(j) - length(replace(j, '   ', ''))) // 3 AS j3, length(j) - length(replace(j, chr(9), '')) AS jt FROM t),
    f AS (SELECT id, i, p, {FLAGS_SQL} FROM u),
    kept AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS i, p, len(regexp_extract_all(p, '[\p{{L}}\p{{N}}_]+|[^\s\p{{Z}}\p{{L}}\p{{N}}_]'))::INT AS n FROM f WHERE NOT (image OR footnote OR email OR copies OR tabular OR title OR formatted)),
    walk AS (SELECT id, 0::BIGINT AS i, 0 AS size, 0 AS chunk, FALSE AS taken FROM latest
             UNION ALL SELECT w.id, w.i + 1, CASE WHEN w.size >= 300 THEN 0 ELSE w.size + k.n END, CASE WHEN w.size >= 300 THEN w.chunk + 1 ELSE w.chunk END, w.size < 300 FROM walk w JOIN kept k ON k.id = w.id AND k.i = w.i + 1),
    chunks AS (SELECT w.id, w.chunk, string_agg(k.p, chr(10) || chr(10) ORDER BY k.i) AS text, sum(k.n)::INT AS tokens FROM walk w JOIN kept k ON k.id = w.id AND k.i = w.i WHERE w.taken GROUP BY w.id, w.chunk HAVING sum(k.n) >= 300)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT id, c.chunk AS chunk_no, c.text, c.tokens, title, author FROM chunks c JOIN latest USING (id) WHERE c.tokens < 10000")
def book_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of at least 300 tokens of cleaned paragraphs."""
    b = D.latest_books(table(spark, folder, "books"))
    return D.book_chunks(b, "id", least=300).join(b.select("id", "title", "author"), "id")


@query()
def continuations(spark: SparkSession, folder: str) -> DataFrame:
    b = D.latest_books(table(spark, folder, "books"))
    return D.continuation_rows(b, "id", D.ContinuationSizes(summary_tokens=300, prefix_tokens=120))


@query()
def screenplays(spark: SparkSession, folder: str) -> DataFrame:
    """Scenes and dialogue of every document that has scene headings, and which have enough of both."""
    p = D.parse_screenplays(table(spark, folder, "documents"), "doc_id").filter("size(scenes) > 0")
    return p.select("doc_id", F.size("scenes").alias("n_scenes"), F.array_join(F.transform("scenes", lambda s: D.dialogue_text(s["elements"])), "\n\n").alias("dialogue"), D.screenplay_passes(F.col("scenes"), 3, 3).alias("passes"))


@query()
def lines_by_character(spark: SparkSession, folder: str) -> DataFrame:
    p = D.parse_screenplays(table(spark, folder, "documents"), "doc_id")
    e = p.select("doc_id", F.explode(F.flatten(F.transform("scenes", lambda s: s["elements"]))).alias("e")).filter("e.type = 'dialogue'")
    return e.groupBy("doc_id", F.col("e.character").alias("character")).agg(F.count("*").alias("n_lines"))


@query(
    """SELECT scene_id, string_agg(e.dialogue_data.character || ': ' || CASE WHEN e.dialogue_data.parenthetical IS NOT NULL THEN e.dialogue_data.parenthetical || chr(10) ELSE '' END || coalesce(e.content, ''), chr(10) ORDER BY i) AS dialogue
       FROM (SELECT scene_id, unnest(elements) AS e, generate_subscripts(elements, 1) AS i FROM (SELECT DISTINCT scene_id, elements FROM scenes))
       WHERE e.type = 'dialogue' AND e.dialogue_data.character IS NOT NULL GROUP BY scene_id"""
)
def scene_dialogue(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "scenes").select("scene_id", "elements").distinct()
    own = F.transform(F.filter("elements", lambda e: (e["type"] == "dialogue") & e["dialogue_data"]["character"].isNotNull()), lambda e: F.struct(e["type"].alias("type"), e["content"].alias("content"), e["dialogue_data"]["character"].alias("character"), e["dialogue_data"]["parenthetical"].alias("parenthetical")))
    return s.select("scene_id", own.alias("own")).filter("size(own) > 0").select("scene_id", D.dialogue_text(F.col("own")).alias("dialogue"))


@query(
    """WITH f AS (SELECT gen_id, CASE WHEN content IS NULL OR trim(content) = '' THEN 'no_output' WHEN NOT contains(content, '```') THEN 'no_code_block' WHEN regexp_matches(content, '[一-鿿]+') THEN 'chinese_found'
            WHEN len(regexp_extract_all(content, '(?s)```[A-Za-z0-9_+-]*\\n(.*?)\\n```', 1)) > 1 THEN 'multiple_outputs' ELSE 'kept' END AS reason FROM (SELECT DISTINCT gen_id, content FROM generations))
       SELECT reason, count(*)::BIGINT AS n FROM f GROUP BY reason"""
)
def extraction_funnel(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("content")
    reason = F.when(c.isNull() | (F.trim(c) == ""), "no_output").when(~c.contains("```"), "no_code_block").when(T.has_han(c), "chinese_found").when(F.size(X.code_fences(c)) > 1, "multiple_outputs").otherwise("kept")
    return table(spark, folder, "generations").select("gen_id", "content").distinct().groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query()
def markdown_thoughts(spark: SparkSession, folder: str) -> DataFrame:
    """List items and the first code block of generated texts."""
    g = table(spark, folder, "generations").filter("content is not null").select("gen_id", "content").distinct()
    return g.select("gen_id", X.markdown_parts_udf("content").alias("m")).filter("size(m.thoughts) > 0 or m.code is not null").select("gen_id", F.size("m.thoughts").alias("n_thoughts"), F.array_join("m.thoughts", "\n").alias("thoughts"), "m.code")


@query(
    r"""SELECT doc_id, list_aggregate(list_transform(range(1, greatest(len(t), 1)::BIGINT + 1), lambda i: CASE WHEN i <= 16 AND i <= len(t) THEN length(t[i]) ELSE 0 END), 'sum')::BIGINT AS sum_ids, least(len(t), 16)::BIGINT AS sum_mask
        FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL)"""
)
def padded_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Word lengths as ids, padded or cut to 16 with a mask."""
    from ..functions.conversation import fixed_length

    d = table(spark, folder, "documents").filter("text is not null").select("doc_id", F.transform(T.tokens(F.col("text")), F.length).alias("ids"))
    p = d.select("doc_id", *fixed_length(F.col("ids"), 16))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("doc_id", add(F.col("input_ids")).alias("sum_ids"), add(F.col("attention_mask")).alias("sum_mask"))


@query(
    """SELECT row_id, prompt, text, author, title FROM (SELECT *, row_number() OVER (ORDER BY left(sha256('s' || row_id::VARCHAR), 8), row_id) AS n FROM
        (SELECT DISTINCT row_id, prompt, text, author, title FROM processed_rows)) WHERE n <= 50"""
)
def sampled_rows(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "processed_rows").select("row_id", "prompt", "text", "author", "title").distinct()
    return L.sample_rows(r, "row_id", 50, "s")


@query(
    """SELECT doc_id, text FROM documents WHERE text <> '' AND NOT contains(text, chr(10)) AND len(string_split(text, ' ')) <= 400 AND length(text) <= 2000"""
)
def short_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """One-line documents of bounded size."""
    c = F.col("text")
    return table(spark, folder, "documents").select("doc_id", "text").filter((c != "") & ~c.contains("\n") & (F.size(F.split(c, " ")) <= 400) & (F.length(c) <= 2000))
