"""Tasks: where rows come from, the prompt they get, what is made of the answer. Every task is a chain of columns around one generation step."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import extract as X
from ..functions import scores as S
from ..operators import documents as D
from ..operators.select import best_and_worst, fan_out, hash_split, repeat_rows
from ..session import cut
from .client import Args, generate_column

Rows = Callable[[DataFrame], DataFrame]


def ask(text: Column, system: str | None = None) -> Column:
    user = C.message("user", text)
    return F.array(C.message("system", F.lit(system)), user) if system else F.array(user)


def filled(template: str, **columns: str) -> Column:
    """A template with the columns put in for their {names}."""
    out = F.lit(template)
    for name, c in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return out


@dataclass(frozen=True)
class Task:
    name: str
    key: str
    prompt: Column | Callable[[], Column]
    before: Rows = field(default=lambda df: df)
    after: Rows = field(default=lambda df: df)
    client: str = "hash"
    args: Args = Args()

    def run(self, rows: DataFrame) -> DataFrame:
        """The answers as `content` and `finish_reason` beside the columns of the prepared rows, then the task's own form. The model's answers are written before anything reads them."""
        p = self.prompt() if callable(self.prompt) else self.prompt
        made = cut(generate_column(self.before(rows).withColumn("_conv", p), self.key, "_conv", self.client, self.args))
        return self.after(made.select("*", "result.content", "result.finish_reason").drop("_conv", "result"))


# What tasks ask; {names} are columns.
PROMPTS = {
    "upsample": "Make this image prompt richer in a few sentences: {text}",
    "summary": "Sum up this scene in one sentence:\n{text}",
    "classify": "Is this Narrative Fiction or Not Narrative Fiction? Name one.\n{text}",
    "backtranslate": "Write the instruction that this passage answers, inside <instruction>, with <genre> and <tone> tags.\n{text}",
    "continue": "Continue:\n{prefix}",
    "qa": "Context: {context}\nQuestion: {question}\nAnswer from the context, or say that it can't be answered.",
    "refuse": "Decline this politely, with a reason: {text}",
    "tool": "Call one of the tools for this task.\nTask: {text}",
    "code": "Write this Python function. Answer with one fenced block.\n{text}",
    "judge": "Score this text for {criteria}, each from 0 to 20, as 'name: score' lines.\n{text}",
    "entities": "List the people and things in this text as fenced JSON.\n{text}",
}
CRITERIA = ("clarity", "imagery", "coherence", "originality", "pacing", "tone")


def prompt_of(name: str, system: str | None = None, **columns: str) -> Callable[[], Column]:
    return lambda: ask(filled(PROMPTS[name], **columns), system)


def simple(name: str, key: str, column: str = "text", after: Rows = lambda df: df, before: Rows = lambda df: df, client: str = "hash") -> Task:
    return Task(name, key, prompt_of(name, text=column), before, after, client)


TASKS: dict[str, Task] = {
    "prompt_upsample": simple("upsample", "doc_id", before=lambda df: df.filter(short_prompt(F.col("text"))), after=lambda df: df.select("doc_id", "text", F.col("content").alias("upsampled"))),
    "screenplay_summary": simple("summary", "doc_id", after=lambda df: df.select("doc_id", F.col("content").alias("summary"))),
    "refusal": simple("refuse", "row_id", "instruction", after=lambda df: df.select("row_id", "instruction", F.col("content").alias("response"))),
    "tool_call": simple("tool", "row_id", "instruction", after=lambda df: df.select("row_id", "instruction", X.prefixed_lines(F.col("content")).alias("parts"))),
    "code": simple("code", "row_id", "instruction", after=lambda df: df.select("row_id", X.code_fences(F.col("content"), "python").alias("blocks"), "content")),
    "entities": simple("entities", "doc_id", after=lambda df: df.select("doc_id", X.code_fences(F.col("content"), "json").alias("blocks"))),
    "extractive_qa": Task("extractive_qa", "id", prompt_of("qa", context="context", question="question"), after=lambda df: df.select("id", "question", F.col("content").alias("answer"))),
}


def short_prompt(c: Column) -> Column:
    """Not empty, one line, at most ten words and 128 characters."""
    return (c != "") & ~c.contains("\n") & (F.size(F.split(c, " ")) <= 10) & (F.length(c) <= 128)


def backtranslate(chunks: DataFrame, key: str, client: str = "hash", keep_all: bool = False) -> DataFrame:
    """Chunks classified, those of narrative fiction asked for the instruction they answer: key, text, instruction, tags.

    Two model steps; the filter between them stands in the plan, as Spark moves none across a Python step. keep_all
    passes chunks whatever their label.
    """
    label = Task("classify", key, prompt_of("classify", text="text"), client=client).run(chunks).withColumn("label", X.fiction_label(F.col("content")))
    kept = label.filter(F.lit(keep_all) | (F.col("label") == 1)).select(key, "text", "label")
    made = Task("backtranslate", key, prompt_of("backtranslate", text="text"), client=client).run(kept)
    return made.select(key, "text", "label", F.coalesce(F.try_element_at(X.between_tags(F.col("content"), "instruction"), F.lit(1)), F.col("content")).alias("instruction"))


def summarized_continuations(books: DataFrame, key: str, client: str = "hash", separator: str = "\n\n") -> DataFrame:
    """Prefix and summary of a passage with the passage that follows."""
    parts = D.continuation_rows(books, key, separator=separator).withColumn("part", F.concat_ws(":", F.col(key).cast("string"), F.col("part_no").cast("string")))
    return Task("summary", "part", prompt_of("summary", text="passage"), client=client).run(parts).select(key, "part_no", "prefix", F.col("content").alias("summary"), "following")


def best_of_n(prompts: DataFrame, key: str, text: str, clients: list[str]) -> DataFrame:
    """Every prompt with every client, answered, scored by a judge and by words of the prompt: key, model_id, completion, score."""
    rows = fan_out(prompts.select(key, text), clients).withColumn("try", F.concat_ws("|", F.col(key).cast("string"), "model_id"))
    done = None
    for name in clients:
        own = Task(name, "try", lambda: ask(F.col(text)), client=name).run(rows.filter(F.col("model_id") == name))
        done = own if done is None else done.unionByName(own)
    judged = Task("judge", "try", lambda: ask(filled(PROMPTS["judge"], text="completion", criteria="_criteria"))).run(done.select("try", key, "model_id", F.col("content").alias("completion"), F.lit(", ".join(CRITERIA)).alias("_criteria")))
    scores = X.judge_scores(F.col("content"))
    return judged.select(key, "model_id", "completion", scores.alias("scores"), F.coalesce(S.judge_reward(scores), F.lit(0.0)).alias("score"))


def preference_pairs(scored: DataFrame, key: str, test: float = 0.05) -> DataFrame:
    """Chosen and rejected completion of each prompt, with a split."""
    pairs = best_and_worst(scored, key, "score", "model_id", ["completion", "model_id"])
    return pairs.withColumn("split", hash_split(F.col(key), test))


def eval_runs(seeds: DataFrame, key: str, template: str, n: int = 5, client: str = "hash") -> DataFrame:
    """Each seed prompt n times (<SEED> replaced by the run's number), answered and judged: key, run, response, scores."""
    runs = repeat_rows(seeds, n, "run").withColumn("id", F.concat_ws(":", F.col(key).cast("string"), F.col("run").cast("string")))
    asked = runs.withColumn("p", F.replace(F.col(template), F.lit("<SEED>"), F.col("run").cast("string")))
    made = Task("eval", "id", lambda: ask(F.col("p")), client=client).run(asked).select("id", key, "run", F.col("content").alias("response"))
    judged = Task("judge", "id", lambda: ask(filled(PROMPTS["judge"], text="response", criteria="_c"))).run(made.withColumn("_c", F.lit(", ".join(CRITERIA))))
    return judged.select(key, "run", "response", X.judge_scores(F.col("content")).alias("scores"))
