"""Queries of generation: tasks, episodes and tools with the offline client, and code runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, extract
from ..generation import episodes, tasks
from ..operators import documents as D
from ..operators import nested
from .registry import query, table


@query()
def generated_refusals(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.TASKS["refusal"].run(table(spark, folder, "goody").filter("instruction is not null").select("row_id", "instruction").distinct())


@query()
def generated_episodes(spark: SparkSession, folder: str) -> DataFrame:
    """One episode for each stored one, played for three steps, and its flat tables' size."""
    n = table(spark, folder, "episodes").select("episode_id").distinct().count()
    played = episodes.play(episodes.seeds(spark, n), steps=3)
    return played.select("episode_id", "step_count", "game_setting", "transcript", "metrics")


@query()
def replayed_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of freshly played episodes by kind: played, stored as text, read back as nested records."""
    from ..session import cut

    n = table(spark, folder, "episodes").select("episode_id").distinct().count()
    played = cut(episodes.play(episodes.seeds(spark, n), steps=2)).withColumn("saved_at", F.lit("2024-01-01").cast("timestamp"))
    return nested.flatten_episodes(played).groupBy("level", "variant").agg(F.count("*").alias("n"))


@query()
def summarized_continuations(spark: SparkSession, folder: str) -> DataFrame:
    b = D.latest_books(table(spark, folder, "books"))
    return tasks.summarized_continuations(b, "id")


@query()
def backtranslated_chunks(spark: SparkSession, folder: str) -> DataFrame:
    b = D.latest_books(table(spark, folder, "books"))
    chunks = D.book_chunks(b, "id", least=300).withColumn("chunk", F.concat_ws(":", F.col("id").cast("string"), F.col("chunk_no").cast("string")))
    return tasks.backtranslate(chunks.select("chunk", "text"), "chunk", keep_all=True)


@query()
def best_of_two(spark: SparkSession, folder: str) -> DataFrame:
    """Two clients answer each held-out item; the better scored answer against the other."""
    scored = tasks.best_of_n(table(spark, folder, "eval_items"), "item_id", "text", ["hash", "hash-short"])
    return tasks.preference_pairs(scored, "item_id")


@query()
def code_that_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The code of every generated text that has some (last fenced block, solution, or the whole text): whether it parses, and whether it runs to its end."""
    g = table(spark, folder, "generations").filter("content is not null").select("gen_id", "content").distinct()
    b = g.select("gen_id", code.best_snippet_udf("content").alias("code")).filter("code is not null")
    return b.select("gen_id", extract.python_parses_udf("code").alias("parses"), code.run_code_udf("code")["ok"].alias("runs"), F.length("code").alias("n_chars"))
