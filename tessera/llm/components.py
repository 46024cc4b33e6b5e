"""Connected components by random-mate contraction, in SQL joins only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_table as cut
from ..session import drop_table

#: A vertex with more than a HOT-th of the first edges is renamed from a broadcast; there are at most 2 x HOT of them.
HOT = 256

#: The collapses of a round: a vertex whose coin is a tail and that touches a head goes into its least head. The coin is a
#: hash of vertex and round; the round is read from the table, so that the code compiled for one round serves all.
COLLAPSES = """
    SELECT v, min(CASE WHEN pmod(xxhash64(r, w), 2) = 1 THEN w END) AS parent, count(*) AS degree
    FROM (SELECT inline(array(struct(a AS v, b AS w, r), struct(b AS v, a AS w, r))) FROM {edges})
    GROUP BY v, r HAVING pmod(xxhash64(r, v), 2) = 0 AND parent IS NOT NULL"""

#: Rows of a table with `to` for their key, null where there is none. few, a bounded number of frequent keys, is broadcast;
#: the rows it names go on spread by a hash of the whole row (rows are distinct) instead of to the one task of their key.
LOOKED_UP = """
    SELECT x.*, coalesce(hub, rest.to) AS to
    FROM (SELECT /*+ BROADCAST(few) */ y.*, few.to AS hub, CASE WHEN few.to IS NULL THEN 0L ELSE pmod(xxhash64({columns}), 1048576L) + 1 END AS spot FROM {rows} y LEFT JOIN few ON y.{key} = few.v) x
    LEFT JOIN (SELECT v, to, 0L AS none FROM rest) rest ON x.{key} = rest.v AND x.spot = rest.none"""

ROUND = f"""
    WITH into AS ({COLLAPSES}),
         few AS (SELECT v, parent AS to FROM into WHERE degree > {{limit}}),
         rest AS (SELECT v, parent AS to FROM into WHERE degree <= {{limit}}),
         one AS (SELECT coalesce(to, a) AS a, b, r FROM ({LOOKED_UP.format(rows="{edges}", key="a", columns="y.a, y.b")})),
         two AS (SELECT a, coalesce(to, b) AS b, r FROM ({LOOKED_UP.format(rows="one", key="b", columns="y.a, y.b")}))
    SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, r + 1 AS r FROM two WHERE a <> b"""

#: Every parent replaced by its own parent, where it has one.
JUMP = f"""
    WITH frequent AS (SELECT parent FROM {{names}} GROUP BY parent HAVING count(*) > {{limit}}),
         few AS (SELECT v, n.parent AS to FROM {{names}} n JOIN frequent f ON n.v = f.parent),
         rest AS (SELECT v, parent AS to FROM {{names}})
    SELECT v, coalesce(to, parent) AS parent FROM ({LOOKED_UP.format(rows="{names}", key="parent", columns="y.v")})"""


def run(sql: str, limit: int, **tables: DataFrame) -> DataFrame:
    """The statement over the tables, written; the views it reads them by are dropped."""
    views = {k: f"tessera_{uuid.uuid4().hex}" for k in tables}
    for k, t in tables.items():
        t.createOrReplaceTempView(views[k])
    spark = next(iter(tables.values())).sparkSession
    try:
        return cut(spark.sql(sql.format(limit=limit, **views)))
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)


def components(edges: DataFrame, most: int = 400) -> DataFrame:
    """v, label of every vertex of the undirected edges (a, b); loops and repeated edges are allowed, nulls are dropped.

    Each round every vertex throws a coin (a hash of its name and the round); a tail that touches a head collapses into
    its least head, and edges are renamed, until none is left. A round is one statement that writes the next edges; its
    collapses follow from its edges again when the labels are unwound by joining all rounds on themselves. Only distinct
    edges are shuffled, and vertices of many edges are renamed by broadcast, so a hub of any degree is no hot task.
    """
    kind = edges.schema["a"].dataType
    now = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(0).alias("r")).distinct())
    limit = now.count() // HOT
    rounds = [now]
    while not now.isEmpty():
        if len(rounds) > most:
            raise RuntimeError(f"edges are left after {most} rounds")
        now = run(ROUND, limit, edges=now)
        rounds.append(now)
    if len(rounds) == 1:
        drop_table(now)
        return edges.select(F.col("a").cast(kind).alias("v"), F.col("a").cast(kind).alias("label")).filter("a is not null and b is not null").distinct()
    # every vertex has collapsed once at most, so the rounds together are a forest; pointer jumping finds its roots
    names = run(" UNION ALL ".join(f"SELECT v, parent FROM ({COLLAPSES.format(edges='{t%d}' % k)})" for k in range(len(rounds) - 1)), 0, **{f"t{k}": t for k, t in enumerate(rounds[:-1])})
    drop_table(*rounds)
    limit = names.count() // HOT
    for _ in range((len(rounds) - 2).bit_length()):
        names, before = run(JUMP, limit, names=names), names
        drop_table(before)
    names = names.withColumnRenamed("parent", "label")
    ends = edges.select(F.explode(F.array("a", "b")).alias("v")).filter("v is not null").distinct()
    return ends.join(names, "v", "left").select("v", F.coalesce("label", "v").alias("label"))
