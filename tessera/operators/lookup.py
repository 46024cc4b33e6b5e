"""Left joins that stay even when a key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, key: str, most: int = 256) -> DataFrame:
    """rows with the other columns of table, which has one row a key; null where the key is null or unknown.

    The `most` most frequent keys of rows (counted with map-side combine, the order among equals by key) are looked up in
    a broadcast of at most that many rows of table, and rows without a key are not joined at all, so that neither is
    shuffled; only the rest is, and no key left there has more than a `most`-th of the rows. A key that table has twice
    gives two rows; empty inputs and rows equal to each other are joined like any others. Columns of table must not be
    named like those of rows, but for the key.
    """
    own = [c for c in table.columns if c != key]
    kinds = dict(zip(table.columns, (f.dataType for f in table.schema.fields)))
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    frequent = counts.orderBy(F.desc("_n"), key).limit(most).select(key, F.lit(True).alias("_hot"))
    hot = frequent.join(table, key, "left")
    first = rows.filter(F.col(key).isNotNull()).join(F.broadcast(hot), key, "left")
    order = [*rows.columns, *own]
    common = first.filter("_hot").select(order)
    rest = first.filter("_hot is null").select(rows.columns).join(table, key, "left").select(order)
    none = rows.filter(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(kinds[c]).alias(c) for c in own))
    return common.unionByName(rest).unionByName(none)
