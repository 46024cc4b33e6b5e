"""Queries of selection and statistics: scores, pairs, bands, joins, splits, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import scores as S
from ..operators import select as L
from ..streaming.resume import windowed_counts
from .registry import query, table


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Eval results with their scores as a map; exact repeats are one."""
    e = table(spark, folder, "eval_results").select("result_id", "source", "prompt", "model_response", "scores").distinct()
    return e.withColumn("m", X.literal_map_udf("scores"))


#: A map of numbers in either notation, taken apart by its pairs; a text without braces is no map.
SCORES = r"""s AS (SELECT DISTINCT result_id, source, prompt, model_response, scores FROM eval_results), m AS (SELECT result_id, source, regexp_extract_all(scores, '[''"]([^''"]+)[''"]\s*:', 1) AS names, list_transform(regexp_extract_all(scores, ':\s*[''"]?(-?[0-9]+(?:\.[0-9]+)?)', 1), lambda x: x::DOUBLE) AS v FROM s WHERE contains(scores, '{'))"""


@query(f"WITH {SCORES}, x AS (SELECT source, unnest(names) AS criterion, unnest(v) AS score FROM m) SELECT source, criterion, count(*)::BIGINT AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS deviation FROM x GROUP BY 1, 2")
def criterion_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of each criterion by source; scores are maps kept as text in several notations."""
    c = L.criterion_stats(scored(spark, folder), "source", "m")
    return c.select("source", "criterion", "n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query(
    f"""WITH {SCORES} SELECT result_id, round(coalesce(list_sum(v), 0), 6)::DOUBLE AS total, CASE WHEN len(v) > 0 THEN round(list_avg(list_transform(v, lambda x: least(greatest(x, 0::DOUBLE), 20::DOUBLE) / 20::DOUBLE))::VARCHAR::DECIMAL(38, 18), 2)::DOUBLE END AS reward, array_to_string(list_sort(names), ',') AS criteria FROM m"""
)
def total_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = scored(spark, folder).filter("m is not null")
    return s.select("result_id", F.round(S.total(F.col("m")), 6).alias("total"), S.judge_reward(F.col("m")).alias("reward"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("criteria"))


PLAIN = r"""e AS (SELECT DISTINCT result_id, source, prompt, model_response, coalesce(len(regexp_extract_all(model_response, '[.!?]')), 0) AS stops, length(model_response) AS size FROM eval_results WHERE model_response IS NOT NULL AND prompt IS NOT NULL)"""


def answers(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "eval_results").filter("model_response is not null and prompt is not null").select("result_id", "source", "prompt", "model_response").distinct()
    return e.withColumn("stops", F.regexp_count("model_response", F.lit("[.!?]"))).withColumn("size", F.length("model_response"))


@query(
    f"""WITH {PLAIN}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, result_id) AS hi, row_number() OVER (PARTITION BY source ORDER BY size, result_id) AS lo, count(*) OVER (PARTITION BY source) AS n FROM e)
        SELECT a.source, a.result_id AS result_id_chosen, a.model_response AS model_response_chosen, b.result_id AS result_id_rejected, b.model_response AS model_response_rejected, a.size::INT AS score_chosen, b.size::INT AS score_rejected
        FROM r a JOIN r b ON a.source = b.source AND a.hi = 1 AND b.lo = 1 WHERE a.n > 1"""
)
def best_and_worst(spark: SparkSession, folder: str) -> DataFrame:
    """The longest and the shortest answer of each source."""
    return L.best_and_worst(answers(spark, folder), "source", "size", "result_id", ["result_id", "model_response"])


@query(
    """WITH r AS (SELECT event_id, user_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id))
       SELECT event_id, round(CASE WHEN s IS NULL THEN 0 ELSE (coalesce(value, 0) - m) / (s + 1e-4) END, 6) AS advantage FROM r"""
)
def group_advantages(spark: SparkSession, folder: str) -> DataFrame:
    a = L.advantages(table(spark, folder, "events").select("event_id", "user_id", "value"), "user_id", {"value": 1.0})
    return a.select("event_id", F.round("advantage", 6).alias("advantage"))


@query("WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT least(floor((value - lo) / ((hi - lo) / 100)) + 1, 100)::INT AS bin, count(*)::BIGINT AS n FROM events, b WHERE value IS NOT NULL GROUP BY 1")
def histogram_100(spark: SparkSession, folder: str) -> DataFrame:
    return L.histogram(table(spark, folder, "events"), "value", 100)


@query("SELECT coalesce(kind, '?') AS kind, round(quantile_cont(n_chars, 0.4), 6) AS p40, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.6), 6) AS p60 FROM documents GROUP BY 1")
def size_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "documents").groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(F.percentile("n_chars", F.array(F.lit(0.4), F.lit(0.5), F.lit(0.6))).alias("p"))
    return p.select("kind", *[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p40", "p50", "p60"))])


@query(
    """WITH s AS (SELECT avg(n_chars) AS m, stddev_samp(n_chars) AS d FROM documents)
       SELECT coalesce(CASE WHEN n_chars < m - 1.2815515655446004 * d THEN NULL WHEN n_chars <= m THEN '10-50' WHEN n_chars <= m + 1.2815515655446004 * d THEN '50-90' ELSE '90-100' END, 'none') AS band, count(*)::BIGINT AS n FROM documents, s GROUP BY 1"""
)
def percentile_bands(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("n_chars")
    mean, deviation = d.agg(F.avg("n_chars"), F.stddev_samp("n_chars")).first()
    band = F.coalesce(S.percentile_label(F.col("n_chars"), F.lit(mean), F.lit(deviation)), F.lit("none"))
    return d.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


@query(
    """WITH r AS (SELECT prompt, result_id, model_response, row_number() OVER (PARTITION BY prompt ORDER BY result_id DESC) AS k FROM (SELECT DISTINCT result_id, prompt, model_response FROM eval_results WHERE prompt IS NOT NULL))
       SELECT g.row_id, g.instruction, g.response AS chosen, r.model_response AS rejected FROM (SELECT DISTINCT row_id, instruction, response FROM goody) g JOIN r ON g.instruction = r.prompt AND k = 1"""
)
def instruction_join(spark: SparkSession, folder: str) -> DataFrame:
    """Answers to the same instruction side by side; of equal prompts the last row counts."""
    g = table(spark, folder, "goody").select("row_id", "instruction", F.col("response").alias("chosen")).distinct()
    r = table(spark, folder, "eval_results").select("result_id", "prompt", "model_response").distinct()
    return L.join_last(g, r, {"instruction": "prompt"}, "result_id", {"model_response": "rejected"})


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT source FROM documents WHERE kind = 'contest' AND doc_id % 7 = 0) x WHERE x.source IS NOT DISTINCT FROM d.source)")
def resume_antijoin(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of sources that aren't done; done are those with a contest text whose id 7 divides."""
    d = table(spark, folder, "documents").select("doc_id", "source", "kind")
    done = d.filter("kind = 'contest' and doc_id % 7 = 0").select("source")
    return L.remaining(d.select("doc_id", "source"), done, "source")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders) WHERE n > 1000")
def positional_skip(spark: SparkSession, folder: str) -> DataFrame:
    return L.skip_done(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), 1000, "o_orderkey")


@query("SELECT item_id, suite, model_id, copy_no FROM eval_items, (VALUES ('a'), ('b'), ('c')) m(model_id), (VALUES (0), (1)) c(copy_no)")
def best_of_n_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Every item with every model, twice."""
    return L.repeat_rows(L.fan_out(table(spark, folder, "eval_items").select("item_id", "suite"), ["a", "b", "c"]), 2)


@query(
    """SELECT doc_id, CASE WHEN ('0x' || left(sha256('v1' || doc_id::VARCHAR), 8))::BIGINT / 4294967296.0 < 0.1 THEN 'test' ELSE 'train' END AS split,
       ['x', 'y', 'z'][floor(('0x' || left(sha256('c' || doc_id::VARCHAR), 8))::BIGINT / 4294967296.0 * 3)::INT + 1] AS choice FROM documents"""
)
def hash_split(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, folder, "documents").select("doc_id", L.hash_split(k, 0.1, "v1").alias("split"), L.choice(k, ["x", "y", "z"], "c").alias("choice"))


@query("SELECT doc_id, coalesce(kind, '?') AS kind, (dense_rank() OVER (ORDER BY coalesce(kind, '?')) - 1)::INT AS code FROM documents")
def category_codes(spark: SparkSession, folder: str) -> DataFrame:
    """A dense code for each kind: kinds are few, so they are ranked apart and joined back."""
    from pyspark.sql import Window

    d = table(spark, folder, "documents").select("doc_id", F.coalesce("kind", F.lit("?")).alias("kind"))
    codes = d.select("kind").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("kind")) - 1)
    return d.join(codes, "kind").select("doc_id", "kind", "code")


@query("SELECT event_id, (props->>'k')::INT AS k, CASE WHEN (props->>'k')::INT % 2 = 0 THEN 'even' ELSE 'odd' END AS name FROM events")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.when(F.col("p.k") % 2 == 0, "even").otherwise("odd").alias("name"))


@query("SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.2")
def cosine_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector whose id 100 divides against all vectors; the query set is broadcast in blocks of bounded size."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    queries = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    blocks = max(1, -(-queries.count() // 1000))
    out = None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        part = v.join(F.broadcast(own), F.col("vec_id") != F.col("query_id")).withColumn("s", S.cosine(F.col("embedding"), F.col("q"))).filter("s >= 0.2").select("query_id", "vec_id", F.round("s", 5).alias("similarity"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    r"""WITH c AS (SELECT DISTINCT gen_id, content AS c FROM generations WHERE content IS NOT NULL)
        SELECT gen_id, CASE WHEN regexp_matches(regexp_replace(string_split(string_split(c, '<answer>')[-1], '</answer>')[1], '^\s+|\s+$', '', 'g'), '^[0-9]+$') THEN 0.5 ELSE 0.0 END::DOUBLE AS integer_reward,
               CASE WHEN regexp_matches(c, '(?s)^<reasoning>.*?</reasoning>\s*<answer>.*?</answer>') THEN 0.5 ELSE 0.0 END::DOUBLE AS soft_format,
               CASE WHEN len(regexp_extract_all(c, '<summary>')) = 1 THEN 0.125 ELSE 0.0 END::DOUBLE AS once FROM c"""
)
def format_rewards(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("content")
    g = table(spark, folder, "generations").filter("content is not null").select("gen_id", "content").distinct()
    return g.select("gen_id", S.integer_reward(c).alias("integer_reward"), S.soft_format(c).alias("soft_format"), F.when(F.regexp_count(c, F.lit("<summary>")) == 1, 0.125).otherwise(0.0).alias("once"))


@query("SELECT source FROM documents INTERSECT SELECT source FROM documents WHERE kind = 'page'")
def common_sources(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    return d.select("source").intersect(d.filter("kind = 'page'").select("source"))


@query("SELECT 'goody' AS origin, row_id, instruction AS question, response AS answer FROM goody UNION ALL SELECT 'processed', row_id, prompt, text FROM processed_rows")
def appended_pairs(spark: SparkSession, folder: str) -> DataFrame:
    g = table(spark, folder, "goody").select(F.lit("goody").alias("origin"), "row_id", F.col("instruction").alias("question"), F.col("response").alias("answer"))
    return g.unionByName(table(spark, folder, "processed_rows").select(F.lit("processed").alias("origin"), "row_id", F.col("prompt").alias("question"), F.col("text").alias("answer")))


@query("SELECT url, length(url)::INT AS size, nullif(regexp_replace(url, '[^0-9]', '', 'g'), '')::BIGINT AS number FROM documents WHERE url IS NOT NULL ORDER BY number DESC, url LIMIT 25")
def natural_order(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 addresses with the greatest numbers, in the order of the number."""
    d = table(spark, folder, "documents").filter("url is not null").select("url", F.length("url").alias("size"), L.natural_key(F.col("url")).alias("number"))
    return d.orderBy(F.desc("number"), "url").limit(25)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    c = windowed_counts(table(spark, folder, "events"), "ts", "event_type", "value")
    return c.withColumn("total", F.round("total", 6)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT result_id, array_to_string([list_transform(range(0, (len(w) - 1) // 5 + 1), lambda k: array_to_string(w[k * 5 + 1:k * 5 + 5], ' '))][1], '|') AS chunks FROM (SELECT DISTINCT result_id, string_split(model_response, ' ') AS w FROM eval_results WHERE model_response IS NOT NULL)")
def word_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Answers in stretches of five words."""
    e = table(spark, folder, "eval_results").filter("model_response is not null").select("result_id", F.split("model_response", " ").alias("w")).distinct()
    return e.select("result_id", F.array_join(F.transform(L.list_chunks(F.col("w"), 5), lambda c: F.array_join(c, " ")), "|").alias("chunks"))


@query("SELECT n_name, r_name, count(*)::BIGINT AS n_customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
def customers_by_nation(spark: SparkSession, folder: str) -> DataFrame:
    c, n, r = (table(spark, folder, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name", "r_name").agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*)::BIGINT AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    li = table(spark, folder, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))
