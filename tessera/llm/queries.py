"""Queries of the operators in this subpackage over the test tables; each takes the session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import leaks, packing, pairs, pieces, spam, splits, truncation

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    cut = pieces.split_books_and_scenes(table(spark, folder, "books"), table(spark, folder, "scenes"), table(spark, folder, "size_limits"))
    return cut.filter("n_pieces > 1 and piece_no = 0").select("record_kind", "record_id")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces, with their stretches of text joined by line breaks."""
    cut = pieces.split_books_and_scenes(table(spark, folder, "books"), table(spark, folder, "scenes"), table(spark, folder, "size_limits"))
    return cut.select("record_kind", "record_id", "piece_no", "n_pieces", "start", "end", "overlap", F.array_join("parts", "\n").alias("text"))


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every record put together again from its pieces, less their overlaps: size and digest, to be held against the text itself."""
    cut = pieces.split_books_and_scenes(table(spark, folder, "books"), table(spark, folder, "scenes"), table(spark, folder, "size_limits"))
    new = F.struct("piece_no", F.expr("substring(array_join(parts, ''), overlap + 1)").alias("t"))
    whole = cut.groupBy("record_kind", "record_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(new)), lambda x: x["t"]), "").alias("t"))
    return whole.select("record_kind", "record_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = truncation.generation_texts(table(spark, folder, "generations"))
    return truncation.find_truncated(rows).filter("cut").select(F.col("id").cast("long").alias("gen_id")).distinct()


def p3_rates(spark: SparkSession, folder: str) -> DataFrame:
    """How often each source truncates."""
    return truncation.truncation_rates(table(spark, folder, "generations")).withColumn("cut_share", F.round("cut_share", 6))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = pairs.pair_rows(table(spark, folder, "goody"), table(spark, folder, "eval_results"), table(spark, folder, "processed_rows"))
    return pairs.find_defects(rows)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.same_entity_pairs(table(spark, folder, "processed_rows"), table(spark, folder, "scenes"))


def p5_entities(spark: SparkSession, folder: str) -> DataFrame:
    """The same as one row a value: its class, named by its first value, and the number of different values in it."""
    e = splits.entity_classes(splits.entity_values(table(spark, folder, "processed_rows"), table(spark, folder, "scenes")))
    first = e.groupBy("entity").agg(F.min("value").alias("class"))
    return e.join(first, "entity").select(F.col("kind").alias("entity_kind"), "value", "class", "n_values")


def p5_splits(spark: SparkSession, folder: str) -> DataFrame:
    """The split of every row of processed_rows and scenes."""
    rows = splits.assign_splits(table(spark, folder, "processed_rows"), table(spark, folder, "scenes"), table(spark, folder, "split_shares"))
    return rows.select("row_table", "row_id", "split_name")


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    capacity = packing.capacity_of(table(spark, folder, "size_limits"))
    return packing.pack(table(spark, folder, "documents"), capacity)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    capacity = packing.capacity_of(table(spark, folder, "size_limits"))
    return packing.fill_report(packing.pack(table(spark, folder, "documents"), capacity), capacity)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    hits = leaks.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return hits.select("doc_id", "item_id")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.find_spam(table(spark, folder, "documents")).filter("is_spam").select("doc_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_text, p3_found, p3_rates, p4_found, p5_entities, p5_found, p5_splits, p6_containers, p6_fill, p7_found, p8_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH b AS (SELECT id, text FROM (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, (text IS NULL)::INT) AS n FROM books) WHERE n = 1),
                 s AS (SELECT scene_id, max(list_sum(list_transform(elements, lambda e: coalesce(length(e.content), 0)))) AS size FROM scenes GROUP BY scene_id)
            SELECT 'book' AS record_kind, id AS record_id FROM b WHERE length(text) > (SELECT max_size FROM size_limits WHERE applies_to = 'books')
            UNION ALL
            SELECT 'scene', scene_id FROM s WHERE size > (SELECT max_size FROM size_limits WHERE applies_to = 'scenes')
        """,
        "p1_text": """
            WITH b AS (SELECT id, text FROM (SELECT id, text, row_number() OVER (PARTITION BY id ORDER BY fetched_at DESC NULLS LAST, (text IS NULL)::INT) AS n FROM books) WHERE n = 1),
                 s AS (SELECT scene_id, elements FROM (SELECT scene_id, elements, row_number() OVER (PARTITION BY scene_id ORDER BY created_at DESC NULLS LAST) AS n FROM scenes) WHERE n = 1),
                 e AS (SELECT scene_id, unnest(elements) AS e, generate_subscripts(elements, 1) AS i FROM s),
                 t AS (SELECT scene_id, string_agg(e.content, '' ORDER BY e.line_number NULLS LAST, i) AS text FROM e WHERE e.content IS NOT NULL GROUP BY scene_id)
            SELECT 'book' AS record_kind, id AS record_id, length(text)::INT AS n_chars, md5(text) AS digest FROM b WHERE text <> ''
            UNION ALL
            SELECT 'scene', scene_id, length(text)::INT, md5(text) FROM t WHERE text <> ''
        """,
    }
