"""Sinks: files, reports and pages. Each writes what it is given once and appends rather than rewriting."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(df: DataFrame, path: str, key: str) -> int:
    """The rows whose key isn't in the table yet, appended; how many. Running it twice adds nothing."""
    from ..operators.select import remaining
    from ..session import cut

    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        done = None
    new = cut(df if done is None else remaining(df, done, key))
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", per_file: int | None = None) -> bool:
    """A parquet table; an empty result is not written (False)."""
    if df.isEmpty():
        return False
    w = df.write.mode("overwrite").option("compression", compression)
    (w.option("maxRecordsPerFile", per_file) if per_file else w).parquet(path)
    return True


def flat_columns(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats that take scalars only."""
    return df.select(*[F.to_json(c).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c) for c, t in df.dtypes])


def write_csv(df: DataFrame, path: str, append: bool = False) -> None:
    flat_columns(df).write.mode("append" if append else "overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def markdown_row(title: Column, fields: dict[str, Column]) -> Column:
    """A section with a heading and a bold label for each field that isn't null."""
    parts = [F.when(c.isNotNull(), F.concat(F.lit(f"**{k}**\n\n"), c.cast("string"))) for k, c in fields.items()]
    return F.concat_ws("\n\n", F.concat(F.lit("## "), title.cast("string")), *parts)


def write_markdown(df: DataFrame, path: str, title: str, fields: list[str]) -> None:
    flat = flat_columns(df)
    flat.select(markdown_row(F.col(title), {f: F.col(f) for f in fields}).alias("value")).write.mode("overwrite").option("lineSep", "\n\n").text(path)


def escaped(c: Column) -> Column:
    """Text for HTML, line breaks as <br>."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br>")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_page(title: Column, turns: Column) -> Column:
    """A page of an episode: turns are structs of role and content."""
    body = F.array_join(F.transform(turns, lambda t: F.concat(F.lit('<div class="'), escaped(t["role"]), F.lit('"><b>'), escaped(t["role"]), F.lit("</b> "), escaped(F.coalesce(t["content"], F.lit(""))), F.lit("</div>"))), "\n")
    return F.concat(F.lit("<!doctype html><html><head><title>"), escaped(title), F.lit("</title></head><body>\n"), body, F.lit("\n</body></html>"))


def write_pages(df: DataFrame, path: str, title: str, turns: str) -> None:
    df.select(html_page(F.col(title).cast("string"), F.col(turns)).alias("value")).write.mode("overwrite").text(path)


def write_shards(df: DataFrame, path: str, per_shard: int = 1000) -> None:
    """Shards of at most `per_shard` rows."""
    write_parquet(df, path, per_file=per_shard)


def write_settings(spark: SparkSession, settings: dict, path: str) -> None:
    """Settings as one JSON file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(settings, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def log_samples(df: DataFrame, path: str, columns: list[str], step: int) -> None:
    """Evaluation samples of a step appended to a log, as one-line texts."""
    from ..operators.datasets import sample_log

    sample_log(df, columns).withColumn("step", F.lit(step)).write.mode("append").parquet(path)
