"""Sources: one dispatch over formats, and the readers that are more than a format."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUSTOM: dict[str, Callable[[SparkSession], DataFrame]] = {}


@dataclass(frozen=True)
class Source:
    """Where rows come from: format (parquet, csv, tsv, jsonl, json_map, binary, text, custom), path or name, schema, first n rows."""

    format: str
    path: str = ""
    schema: str | T.StructType | None = None
    limit: int | None = None
    options: dict[str, str] = field(default_factory=dict)


def load(spark: SparkSession, s: Source) -> DataFrame:
    """The rows of a source. Lines that don't fit the schema of a CSV or TSV are dropped; a limit is pushed to the scan."""
    r = spark.read.options(**s.options)
    if s.schema is not None:
        r = r.schema(s.schema)
    if s.format == "custom":
        if s.path not in CUSTOM:
            raise KeyError(f"no custom source {s.path!r}")
        df = CUSTOM[s.path](spark)
    elif s.format in ("parquet", "orc", "text"):
        df = getattr(r, s.format)(s.path)
    elif s.format in ("csv", "tsv"):
        sep = s.options.get("sep", "\t" if s.format == "tsv" else ",")
        df = r.option("header", s.options.get("header", "true")).option("sep", sep).option("mode", "DROPMALFORMED").option("inferSchema", str(s.schema is None).lower()).csv(s.path)
    elif s.format == "jsonl":
        df = r.json(s.path)
    elif s.format == "json_map":
        df = json_map(spark, s.path, s.schema)
    elif s.format == "binary":
        df = r.format("binaryFile").load(s.path)
    else:
        raise ValueError(f"unknown format {s.format!r}")
    return df if s.limit is None else df.limit(s.limit)


def json_map(spark: SparkSession, path: str, value: str | T.StructType | None = None) -> DataFrame:
    """One JSON object of objects as rows: its key and the fields of each value."""
    kind = value.simpleString() if isinstance(value, T.StructType) else value or "map<string,string>"
    if not kind.startswith(("map", "struct")):
        kind = f"struct<{kind}>"
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", "v"))
    return rows.select("key", "v.*") if kind.startswith("struct") else rows


def file_list(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path, name, modified, bytes of files; the listing is a scan without their contents."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    d = r.load(folder)
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def first_shards(spark: SparkSession, folder: str, n: int, pattern: str = "*.parquet") -> DataFrame:
    """The first n shards by name; n paths come to the driver, no row."""
    paths = [r.path for r in file_list(spark, folder, pattern).orderBy("name").select("path").limit(n).collect()]
    return spark.read.parquet(*paths)


def newest(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """The file changed last, by name among equals."""
    row = file_list(spark, folder, pattern).orderBy(F.desc("modified"), F.desc("name")).first()
    if row is None:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    return spark.read.parquet(row.path)


def csv_tree(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """All CSV files below a folder, with the name of the folder that holds each as `source`."""
    r = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("header", "true").option("multiLine", "true").option("escape", '"')
    df = r.schema(schema).csv(folder) if schema else r.csv(folder)
    return df.withColumn("source", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def phrases(spark: SparkSession, path: str, n: int) -> DataFrame:
    """n, phrase from a JSON list of lists, lower case; a missing or broken file gives none."""
    schema = "n int, phrase string"
    try:
        raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("p"))
        return raw.select(F.lit(n).alias("n"), F.lower(F.element_at("p", 1)).alias("phrase")).filter("phrase is not null").distinct()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def fetch(ids: DataFrame, fetcher: Callable[[int], str], at_once: int = 10, delay_s: float = 0.1) -> DataFrame:
    """id, text, error: fetcher(id) for each id with `at_once` in flight in a task and a delay before each call. A failure is the row's error, not the task's."""

    def one(i: int) -> tuple[int, str | None, str | None]:
        time.sleep(delay_s)
        try:
            return i, fetcher(i), None
        except Exception as e:  # noqa: BLE001
            return i, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(one, b["id"].astype(int))), columns=["id", "text", "error"])

    return ids.select(F.col("id").cast("long").alias("id")).mapInPandas(run, "id long, text string, error string")


def converted(files: DataFrame, convert: Callable[[bytes], str]) -> DataFrame:
    """path, text, error of binary files (path, content), each converted in its task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rows.append((p, convert(c), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def tar_samples(files: DataFrame) -> DataFrame:
    """shard, key, extension, content of the members of tar shards (path, content)."""
    import io
    import tarfile

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b["path"], b["content"]):
                with tarfile.open(fileobj=io.BytesIO(c)) as tar:
                    rows = [(p, *m.name.rsplit("/", 1)[-1].partition(".")[::2], tar.extractfile(m).read()) for m in tar if m.isfile()]
                yield pd.DataFrame(rows, columns=["shard", "key", "extension", "content"])

    return files.select("path", "content").mapInPandas(run, "shard string, key string, extension string, content binary")


def cached(spark: SparkSession, make: Callable[[], DataFrame], folder: str, *settings: object) -> DataFrame:
    """make() written once under a name made of the settings, and read from there ever after."""
    import hashlib

    path = f"{folder}/{hashlib.sha256(repr(settings).encode()).hexdigest()[:16]}"
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
