"""Sources and sinks in temporary folders."""

from __future__ import annotations

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from tessera.sources import readers as R
from tessera.sources import sinks as K
from tessera.streaming import resume


def test_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,b\n2,c\n")
    (tmp_path / "a.tsv").write_text("x\ty\n1\tb\n")
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n{"x": 2}\n')
    (tmp_path / "m.json").write_text(json.dumps({"k": {"a": "1"}, "l": {"a": "2"}}))
    load = lambda f, n, **k: R.load(spark, R.Source(f, str(tmp_path / n), **k))
    assert load("csv", "a.csv").count() == 2 and load("csv", "a.csv", limit=1).count() == 1
    assert load("tsv", "a.tsv").first().y == "b"
    assert sorted(r.x for r in load("jsonl", "a.jsonl").collect()) == [1, 2]
    assert {r.key: r.a for r in load("json_map", "m.json", schema="a string").collect()} == {"k": "1", "l": "2"}
    with pytest.raises(ValueError, match="unknown format"):
        load("xlsx", "a")
    R.CUSTOM["three"] = lambda s: s.range(3)
    assert R.load(spark, R.Source("custom", "three")).count() == 3


def test_bad_lines_are_dropped(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x,y\n1,2\nno,3\n4,5\n")
    assert R.load(spark, R.Source("csv", str(tmp_path / "b.csv"), "x int, y int")).collect()[-1].x == 4


def test_files(spark, tmp_path):
    for k in range(3):
        spark.range(k, k + 1).coalesce(1).write.parquet(str(tmp_path / f"t{k}"))
        f = next((tmp_path / f"t{k}").glob("*.parquet"))
        f.rename(tmp_path / f"s{k}.parquet")
    assert sorted(r.id for r in R.first_shards(spark, str(tmp_path), 2, "s*.parquet").collect()) == [0, 1]
    assert R.newest(spark, str(tmp_path), "s*.parquet").count() == 1
    (tmp_path / "r" / "one").mkdir(parents=True)
    (tmp_path / "r" / "one" / "x.csv").write_text("a\n1\n")
    assert R.csv_tree(spark, str(tmp_path / "r")).first().source == "one"
    (tmp_path / "p.json").write_text('[["One Two"], ["x"]]')
    assert sorted(r.phrase for r in R.phrases(spark, str(tmp_path / "p.json"), 2).collect()) == ["one two", "x"]
    assert R.phrases(spark, str(tmp_path / "none.json"), 2).count() == 0


def test_fetch_and_convert(spark, tmp_path):
    def get(i):
        if i == 2:
            raise OSError("gone")
        return f"text {i}"

    got = {r.id: (r.text, r.error) for r in R.fetch(spark.range(4), get, delay_s=0).collect()}
    assert got[1] == ("text 1", None) and got[2] == (None, "OSError: gone")
    with tarfile.open(tmp_path / "s.tar", "w") as t:
        info = tarfile.TarInfo("k1.json")
        info.size = 2
        t.addfile(info, io.BytesIO(b"{}"))
    files = R.load(spark, R.Source("binary", str(tmp_path / "s.tar")))
    assert [(r.key, r.extension) for r in R.tar_samples(files).collect()] == [("k1", "json")]
    assert R.converted(files, lambda b: str(len(b))).first().text


def test_appending_twice_adds_nothing(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.lit("a"))
    assert K.append_new(df, str(tmp_path / "t"), "id") == 5
    assert K.append_new(df, str(tmp_path / "t"), "id") == 0
    assert K.append_new(spark.range(7).withColumn("x", F.lit("b")), str(tmp_path / "t"), "id") == 2
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b\nc", {"k": 1.0})], "id int, t string, m map<string,double>")
    assert K.write_parquet(df, str(tmp_path / "p")) and not K.write_parquet(df.limit(0), str(tmp_path / "q"))
    K.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", "\"").csv(str(tmp_path / "c")).first().m.startswith('{')
    K.write_markdown(df, str(tmp_path / "m"), "id", ["t", "m"])
    text = "".join(p.read_text() for p in (tmp_path / "m").glob("part*"))
    assert text.startswith("## 1\n\n**t**\n\na<b")
    page = df.select(K.html_page(F.lit("E"), F.array(F.struct(F.lit("dm").alias("role"), F.col("t").alias("content")))).alias("h")).first().h
    assert "a&lt;b<br>c" in page
    K.write_shards(spark.range(25).coalesce(1), str(tmp_path / "w"), 10)
    assert len(list((tmp_path / "w").glob("*.parquet"))) == 3


def test_cache(spark, tmp_path):
    calls = []
    make = lambda: (calls.append(1), spark.range(3))[1]
    for _ in range(2):
        assert R.cached(spark, make, f"file://{tmp_path}/cache", "v1").count() == 3
    assert len(calls) == 1


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("src", "out", "state"))
    spark.range(10).write.parquet(src)
    work = lambda df: df.filter("id % 2 = 0")
    assert resume.process_new(spark, src, out, state, work) == 5
    assert resume.process_new(spark, src, out, state, work) == 0
    spark.range(10, 14).write.mode("append").parquet(src)
    assert resume.process_new(spark, src, out, state, work) == 2
    assert spark.read.parquet(out).count() == 7
