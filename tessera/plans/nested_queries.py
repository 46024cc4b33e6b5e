"""Queries of nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested
from .registry import query, table

#: One of Python's literals as JSON: its tokens are strings in either quotes and what stands between them.
LITERAL = r"""array_to_string(list_transform(regexp_extract_all({c}, $t$'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+$t$), lambda t:
    CASE WHEN t[1] = '''' THEN '"' || replace(replace(t[2:length(t) - 1], '"', '\"'), '\''', '''') || '"' WHEN t[1] = '"' THEN replace(t, '\''', '''')
         ELSE replace(replace(replace(t, 'None', 'null'), 'True', 'true'), 'False', 'false') END), '')"""
UNQUOTED = "CASE WHEN json_valid({c}) THEN CASE WHEN json_type({c}) = 'VARCHAR' THEN json_extract_string({c}, '$') ELSE {c} END ELSE {c} END"
WHOLE = "CASE WHEN json_valid({c}) THEN {c}::JSON WHEN json_valid({l}) THEN ({l})::JSON END"
LISTED = "CASE coalesce(json_type({c}), 'NULL') WHEN 'NULL' THEN []::JSON[] WHEN 'ARRAY' THEN from_json({c}, '[\"JSON\"]') ELSE [{c}] END"


def unnested(source: str, keys: str, entry: str, at: str) -> str:
    """Rows of the entries of a list l with their positions from 0; null entries are none."""
    return f"SELECT {keys}, {entry}, {at} - 1 AS {at} FROM (SELECT {keys}, unnest(l) AS {entry}, generate_subscripts(l, 1) AS {at} FROM ({source})) WHERE coalesce(json_type({entry}), 'NULL') <> 'NULL'"


def below(level: str, keys: str, entry: str, name: str) -> str:
    """The list under a name of every object of a level; an entry that is no object stands for its own content."""
    return f"SELECT {keys}, {LISTED.format(c='x')} AS l FROM (SELECT {keys}, CASE WHEN json_type({entry}) = 'OBJECT' THEN {entry}->'$.{name}' ELSE {entry} END AS x FROM {level})"


NESTED = f"""
    latest AS (SELECT episode_id, nullif(trim(actions, E' \\n\\t\\r'), '') AS a, nullif(trim(metadata, E' \\n\\t\\r'), '') AS m FROM (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY saved_at DESC NULLS LAST, length(coalesce(actions, '')) + length(coalesce(metadata, '')) DESC) AS k FROM episodes) WHERE k = 1),
    bare AS (SELECT episode_id, {UNQUOTED.format(c="a")} AS a, {UNQUOTED.format(c="m")} AS m FROM latest),
    whole AS (SELECT episode_id, {WHOLE.format(c="a", l=LITERAL.format(c="a"))} AS a, {WHOLE.format(c="m", l=LITERAL.format(c="m"))} AS m FROM bare),
    tops AS (SELECT episode_id, CASE WHEN json_type(a) = 'OBJECT' AND json_exists(a, '$.actions') THEN a->'$.actions' ELSE a END AS a FROM whole),
    acts AS ({unnested("SELECT episode_id, " + LISTED.format(c="a") + " AS l FROM tops", "episode_id", "act", "i")}),
    msgs AS ({unnested(below("acts", "episode_id, i", "act", "messages"), "episode_id, i", "msg", "j")}),
    blocks AS ({unnested(below("msgs", "episode_id, i, j", "msg", "content"), "episode_id, i, j", "block", "k")}),
    metrics AS ({unnested("SELECT episode_id, " + LISTED.format(c="g") + " AS l FROM (SELECT episode_id, m->'$.generation_metrics' AS g FROM whole WHERE json_type(m) = 'OBJECT')", "episode_id", "metric", "i")})"""
NUMBERS = "metric->>'$.stage' AS stage, (metric->>'$.latency_s')::DOUBLE AS latency_s, (metric->>'$.usage.total_tokens')::BIGINT AS total_tokens, (metric->>'$.usage.input_tokens')::BIGINT AS input_tokens, (metric->>'$.usage.output_tokens')::BIGINT AS output_tokens, CASE WHEN json_exists(metric, '$.retries') THEN json_array_length(metric->'$.retries')::INT END AS n_retries"


@query(
    f"""WITH {NESTED} SELECT CASE WHEN json_type(block) = 'OBJECT' THEN block->>'$.type' ELSE 'text' END AS child, episode_id, i || '.' || j || '.' || k AS path FROM blocks
        UNION ALL SELECT 'metric', episode_id, i::VARCHAR FROM metrics"""
)
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.listed_children(nested.flatten_episodes(table(spark, folder, "episodes"), ("block", "metric"), fields=False))


@query(
    f"""WITH {NESTED} SELECT episode_id, i || '.' || j || '.' || k AS path, i || '.' || j AS parent, k::INT AS position, block->>'$.id' AS tool_id, block->>'$.name' AS name, array_to_string(list_sort(json_keys(block->'$.input')), ',') AS input_keys
        FROM blocks WHERE block->>'$.type' = 'tool_use'"""
)
def p2_tool_uses(spark: SparkSession, folder: str) -> DataFrame:
    """The typed table of tool calls with its links to the message."""
    t = nested.typed_table(nested.flatten_episodes(table(spark, folder, "episodes"), ("block",)), "block_tool_use")
    return t.select("episode_id", "path", "parent", "position", "tool_id", "name", F.array_join(F.array_sort(F.json_object_keys("input")), ",").alias("input_keys"))


@query(f"WITH {NESTED} SELECT episode_id, i::INT AS position, metric->>'$.model' AS model, {NUMBERS} FROM metrics")
def p2_metrics(spark: SparkSession, folder: str) -> DataFrame:
    t = nested.typed_table(nested.flatten_episodes(table(spark, folder, "episodes"), ("metric",)), "metric")
    return t.select("episode_id", "position", "model", "stage", "latency_s", "total_tokens", "input_tokens", "output_tokens", F.json_array_length("retries").alias("n_retries"))


@query()
def p2_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """How often each structural variant occurs."""
    return nested.flatten_episodes(table(spark, folder, "episodes"), fields=False).groupBy("level", "variant", "shape").agg(F.count("*").alias("n"))


@query(
    f"""WITH {NESTED}, n AS (SELECT {NUMBERS} FROM metrics) SELECT regexp_replace(stage, '_[0-9]+$', '') AS stage, count(*)::BIGINT AS calls, sum(coalesce(total_tokens, input_tokens + output_tokens))::BIGINT AS tokens, round(sum(latency_s), 3) AS seconds,
        count(n_retries)::BIGINT AS retried, count_if(total_tokens IS NULL)::BIGINT AS without_usage FROM n GROUP BY 1"""
)
def run_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, tokens, seconds and retries by stage of the generation metrics."""
    m = nested.typed_table(nested.flatten_episodes(table(spark, folder, "episodes"), ("metric",)), "metric")
    stage = F.regexp_replace("stage", "_[0-9]+$", "")
    tokens = F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
    return m.groupBy(stage.alias("stage")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"), F.round(F.sum("latency_s"), 3).alias("seconds"), F.count("retries").alias("retried"), F.count_if(F.col("total_tokens").isNull()).alias("without_usage"))


@query(f"WITH {NESTED} SELECT episode_id, CASE WHEN json_type(block) = 'OBJECT' THEN block->>'$.type' ELSE 'text' END AS variant, block->>'$.name' AS tool, count(*)::BIGINT AS n FROM blocks GROUP BY ALL")
def tool_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks by kind and tool in each episode."""
    n = nested.flatten_episodes(table(spark, folder, "episodes"), ("block",))
    return n.groupBy("episode_id", "variant", F.col("fields")["name"].alias("tool")).agg(F.count("*").alias("n"))
