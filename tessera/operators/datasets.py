"""Row filters and formats of particular datasets: catalogues, contest problems, puzzles, questions, preference rows, evaluations."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code as R
from ..functions import conversation as C
from ..functions import extract as X
from ..functions.text import clean_message
from .select import hash_share

# Shelves that a book of the wanted kinds must not stand on.
EXCLUDED_SHELVES = (
    "Romance", "Crime, Thrillers and Mystery", "Essays, Letters & Speeches", "Poetry", "British Literature", "Biographies", "Mythology, Legends & Folklore",
    "Travel Writing", "Plays/Films/Dramas", "Classics of Literature", "History - American", "Journals", "Sports/Hobbies", "Philosophy & Ethics",
    "Religion/Spirituality", "History - Warfare", "Politics", "History - Modern (1750+)", "Journalism/Media/Writing", "Gender & Sexuality Studies",
)
# Codes of a contest collection.
CONTEST_SOURCES = {0: "UNKNOWN_SOURCE", 1: "CODECHEF", 2: "CODEFORCES", 3: "HACKEREARTH", 4: "CODEJAM", 5: "ATCODER", 6: "AIZU"}
CONTEST_LANGUAGES = {0: "UNKNOWN_LANGUAGE", 1: "PYTHON", 2: "CPP", 3: "PYTHON3", 4: "JAVA"}


def code_name(c: Column, names: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c.cast("int")]


def code_of(name: str, names: dict[int, str]) -> int:
    return next(k for k, v in names.items() if v == name)


def wanted_shelves(shelves: Column, parts: tuple[str, ...] = ("Science-Fiction", "Fantasy"), whole: str = "American Literature", excluded: tuple[str, ...] = EXCLUDED_SHELVES) -> Column:
    """A shelf map with a Category that names one of the parts or is the whole, and none that is excluded."""
    c = F.coalesce(shelves["Category"], F.array().cast("array<string>"))
    named = F.exists(c, lambda v: F.lit(False) | (v == whole) | v.contains(parts[0]) | (v.contains(parts[1]) if len(parts) > 1 else F.lit(False)))
    return (F.size(c) > 0) & named & ~F.arrays_overlap(c, F.array(*map(F.lit, excluded)))


def catalogue(df: DataFrame, language: str = "en") -> DataFrame:
    """id and shelves of the catalogue's books in a language that stand on wanted shelves. df: 'Text#', Language, Bookshelves."""
    own = df.filter(F.col("Bookshelves").isNotNull() & (F.col("Language") == language))
    return own.select(F.col("`Text#`").alias("id"), X.bookshelves(F.col("Bookshelves")).alias("shelves")).filter(wanted_shelves(F.col("shelves")))


def solutions_in(df_solutions: Column, language: int) -> Column:
    """Solutions in a language from parallel arrays of language and solution, as far as both go."""
    both = F.zip_with(df_solutions["language"], df_solutions["solution"], lambda a, b: F.struct(a.alias("l"), b.alias("s")))
    n = F.least(F.size(df_solutions["language"]), F.size(df_solutions["solution"]))
    return F.transform(F.filter(F.slice(both, 1, n), lambda x: x["l"] == language), lambda x: x["s"])


def contest_problems(df: DataFrame, most: int | None = 2501, source: str = "CODEFORCES", language: str = "PYTHON3") -> DataFrame:
    """Problems of a source with private tests and a solution in a language, neither translated nor reading files; the first by name up to `most` (null: all), with their first solution."""
    sols = F.transform(F.filter(F.arrays_zip(F.col("solutions.language").alias("l"), F.col("solutions.solution").alias("s")), lambda x: x["l"] == code_of(language, CONTEST_LANGUAGES)), lambda x: x["s"])
    kept = df.filter(F.col("source") == code_of(source, CONTEST_SOURCES)).filter("not coalesce(is_description_translated, false) and coalesce(input_file, '') = '' and coalesce(output_file, '') = '' and size(private_tests.input) > 0")
    kept = kept.withColumn("python_solution", F.try_element_at(sols, F.lit(1))).filter("python_solution is not null")
    return kept if most is None else kept.orderBy("name").limit(most)


def scene_is_rich(items: Column, least: int = 5, each: int = 2) -> Column:
    """A JSON array of {type, ..} with enough items and enough actions and dialogues; text that is no such array is not."""
    a = F.from_json(items, "array<struct<type:string>>", {"mode": "PERMISSIVE"})
    n = lambda t: F.size(F.filter(a, lambda x: x["type"] == t))
    return F.coalesce((F.size(a) >= least) & (n("action") >= each) & (n("dialogue") >= each), F.lit(False))


def has_lines(c: Column, least: int = 10) -> Column:
    """At least so many lines; a null text has none."""
    return F.coalesce(F.size(F.split(c, "\n")) >= least, F.lit(False)) & c.isNotNull()


def any_part_contains(messages: Column, what: str) -> Column:
    """Any text block of any message has the string."""
    return F.exists(messages, lambda m: F.exists(F.coalesce(m["content"], F.array()), lambda b: F.coalesce(F.contains(F.lower(b["text"]), F.lit(what)), F.lit(False))))


def row_kind(df: DataFrame) -> Column:
    """roleplay where there are actions, conversation where there are messages, else generic; by the columns a table has."""
    kind: Column = F.lit("generic")
    for c in ("trajectory", "conversations", "messages", "conversation"):
        if c in df.columns:
            full = F.size(c) > 0 if dict(df.dtypes)[c].startswith("array") else F.col(c).isNotNull()
            kind = F.when(full, "conversation").otherwise(kind)
    return F.when(F.col("actions").isNotNull(), "roleplay").otherwise(kind) if "actions" in df.columns else kind


def messages_of(df: DataFrame) -> Column:
    """The first of conversation, messages, conversations and trajectory that a row has."""
    own = [F.col(c) for c in ("conversation", "messages", "conversations", "trajectory") if c in df.columns]
    return F.coalesce(*own) if own else F.lit(None).cast(C.CONVERSATION)


def winner_label(winner_model_a: Column) -> Column:
    return F.when(winner_model_a == 1, 1).otherwise(0)


def alternating_roles(texts: Column, first: str = "dungeon_master", second: str = "player") -> Column:
    """Messages of texts without roles, taking turns."""
    return F.transform(texts, lambda t, i: C.message(F.when(i % 2 == 0, first).otherwise(second), t))


def pass_counts(results: Column) -> list[Column]:
    """passed and total of nested arrays of booleans."""
    flat = F.flatten(results)
    return [F.size(F.filter(flat, lambda x: x)).alias("passed"), F.size(flat).alias("total")]


def macro_scores(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """precision, recall and f1 averaged over the classes that occur on either side; a class without guesses has precision 0. Counts by pair of classes are aggregated first."""
    pairs = df.filter(F.col(truth).isNotNull() & F.col(guess).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(guess).alias("g")).agg(F.count("*").alias("n"))
    side = lambda c, name: pairs.select(F.col(c).alias("k"), F.col("n").alias(name), F.when(F.col("t") == F.col("g"), F.col("n")).otherwise(0).alias("hit"))
    real = side("t", "n").groupBy("k").agg(F.sum("n").alias("real"), F.sum("hit").alias("hit"))
    said = side("g", "n").groupBy("k").agg(F.sum("n").alias("said"))
    c = real.join(said, "k", "full").fillna(0)
    p, r = F.when(F.col("said") > 0, F.col("hit") / F.col("said")).otherwise(0.0), F.when(F.col("real") > 0, F.col("hit") / F.col("real")).otherwise(0.0)
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return c.agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(f).alias("f1"))


def sample_groups(puzzles: DataFrame, key: str, groups: str, n: int, each: int = 4, salt: str = "") -> DataFrame:
    """n puzzles of `each` different groups: puzzle, words. The groups of all puzzles are dealt in hash order, one list for each pass, so no pair of puzzle and group is compared with another.

    A pass orders the groups by a hash and cuts them into successive fours; passes are added until there are n.
    """
    g = puzzles.select(key, F.posexplode(groups).alias("at", "words")).select(F.concat_ws(":", F.col(key).cast("string"), F.col("at").cast("string")).alias("group_id"), "words")
    total = g.count()
    if total < each:
        raise ValueError("fewer groups than a puzzle takes")
    passes = -(-n // (total // each))
    parts = max(1, total // 50_000)
    dealt = g.withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("h", hash_share(F.concat_ws("/", F.lit(salt), F.col("pass_no").cast("string"), F.col("group_id"))))
    dealt = dealt.withColumn("part", F.floor(F.col("h") * parts))
    at = F.row_number().over(Window.partitionBy("pass_no", "part").orderBy("h", "group_id")) - 1
    four = dealt.withColumn("four", F.floor(at / each)).groupBy("pass_no", "part", "four").agg(F.count("*").alias("c"), F.array_sort(F.collect_list(F.struct("h", "words"))).alias("gs")).filter(F.col("c") == each)
    made = four.select(F.concat_ws("-", *[F.col(c).cast("string") for c in ("pass_no", "part", "four")]).alias("puzzle"), F.transform("gs", lambda x: x["words"]).alias("groups"))
    return made.orderBy("puzzle").limit(n).withColumn("words", F.flatten("groups"))


def puzzle_prompt(words: Column, groups: int = 4) -> Column:
    return F.concat(F.lit(f"Sort these words into {groups} groups of equal size. Put each group into <group> tags, words parted by commas.\n"), F.array_join(words, ", "))


def puzzle_answer(groups: Column) -> Column:
    return F.array_join(F.transform(groups, lambda g: F.concat(F.lit("<group>"), F.array_join(g, ", "), F.lit("</group>"))), "\n")


def question_row(context: Column, question: Column, answers: Column) -> list[Column]:
    """prompt and label of a reading question; the first answer, or that there is none."""
    label = F.coalesce(F.try_element_at(answers, F.lit(1)), F.lit("Cannot answer this question"))
    return [F.concat(F.lit("Context: "), context, F.lit("\nQuestion: "), question, F.lit("\nAnswer:")).alias("prompt"), label.alias("label")]


def arithmetic_row(question: Column, answer: Column, system: str = "Think step by step inside <reasoning>, then answer inside <answer>.") -> list[Column]:
    """prompt (system and question) and the marked answer of a word problem."""
    return [F.array(C.message("system", F.lit(system)), C.message("user", question)).alias("prompt"), X.hash_answer(answer).alias("answer")]


def thought_row(question: Column, thoughts: Column, solution: Column) -> Column:
    """A training conversation with each thought and the solution in tags."""
    said = F.concat(F.array_join(F.transform(thoughts, lambda t: F.concat(F.lit("<thought>"), t, F.lit("</thought>"))), "\n"), F.lit("\n<solution>\n"), solution, F.lit("\n</solution>"))
    return F.array(C.message("user", question), C.message("assistant", said))


def instruction_row(instruction: Column, answer: Column, system: str | None = None) -> Column:
    own = [C.message("user", instruction), C.message("assistant", answer)]
    return F.array(*([C.message("system", F.lit(system))] if system else []), *own)


def summary_row(summary: Column, scene: Column) -> Column:
    """A summary as the request, the scene as the answer."""
    return F.array(C.message("user", summary), C.message("assistant", scene))


def screenplay_row(title: Column, thoughts: Column, script: Column) -> Column:
    """A title as the request; the thoughts as a list and the script as a fenced block in one Markdown answer."""
    listed = F.array_join(F.transform(thoughts, lambda t: F.concat(F.lit("- "), t)), "\n")
    return F.array(C.message("user", title), C.message("assistant", F.concat(listed, F.lit("\n\n```\n"), script, F.lit("\n```"))))


def character_row(messages: Column, bot: str) -> Column:
    """Messages of a chat with a named character: its own as the assistant's with the name before them, the others as the user's."""
    return F.transform(messages, lambda m: F.when(m["role"] == bot, C.message("assistant", F.concat(F.lit(f"{bot}: "), m["content"]))).otherwise(C.message("user", m["content"])))


def call_preferences(expected: DataFrame, submitted: DataFrame, key: str) -> DataFrame:
    """prompt, chosen (the expected call) and rejected (the submitted one) where they differ; both sides have key, prompt or call."""
    both = expected.select(key, "prompt", F.col("call").alias("chosen")).join(submitted.select(key, F.col("call").alias("rejected")), key)
    return both.filter(F.trim("chosen") != F.trim("rejected"))


def evaluate_code(df: DataFrame, key: str, answer: str, tests: str, entry_point: str | None = None) -> DataFrame:
    """key, code, results, passed, total, error: the last snippet of an answer against its tests, each in a process of its own."""
    snippet = R.best_snippet_udf(answer)
    r = R.run_tests_udf("code", tests, F.col(entry_point) if entry_point else F.lit(None).cast("string"))
    return df.select(key, tests, *([entry_point] if entry_point else []), snippet.alias("code")).withColumn("r", r).select(key, "code", "r.*")


def sample_log(df: DataFrame, columns: list[str], most: int = 1000) -> DataFrame:
    """The columns as one-line texts of bounded length, for logs of evaluation samples."""
    return df.select(*[clean_message(F.col(c).cast("string"), most).alias(c) for c in columns])


# --- other providers' shapes; only where rows meet a client ---------------------------------------------------------


def to_tool_calls(messages: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Messages of blocks in the shape with tool_calls and tool messages."""
    out: list[dict[str, Any]] = []
    for m in messages:
        blocks = m["content"] if isinstance(m["content"], list) else [{"type": "text", "text": m["content"]}]
        text = "\n".join(b["text"] for b in blocks if b["type"] == "text" and b.get("text"))
        calls = [{"id": b["id"], "type": "function", "function": {"name": b["name"], "arguments": b["input"]}} for b in blocks if b["type"] == "tool_use"]
        results = [{"role": "tool", "tool_call_id": b["tool_use_id"], "content": b["content"]} for b in blocks if b["type"] == "tool_result"]
        if text or calls:
            out.append({"role": "assistant" if calls else m["role"], "content": text or None} | ({"tool_calls": calls} if calls else {}))
        out += results
    return out


def split_system(messages: list[dict[str, Any]]) -> tuple[str | None, list[dict[str, Any]]]:
    """The system text apart from the other messages."""
    own = [m["content"] if isinstance(m["content"], str) else "\n".join(b.get("text") or "" for b in m["content"]) for m in messages if m["role"] == "system"]
    return ("\n".join(own) or None), [m for m in messages if m["role"] != "system"]
