"""Selection and statistics over tables: pairs by score, advantages, bands, histograms, splits, samples, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_and_worst(df: DataFrame, group: str, score: str, order: str, keep: list[str]) -> DataFrame:
    """One row a group with the kept columns of the highest and the lowest score as *_chosen and *_rejected; the first by `order` wins a tie.

    The extremes are found by aggregation, so a hot group is added up before the shuffle; groups of one row give no pair.
    """
    row = F.struct(*[F.col(k) for k in keep])
    top = F.min_by(row, F.struct((-F.col(score)).alias("s"), F.col(order).alias("o")))
    low = F.min_by(row, F.struct(F.col(score).alias("s"), F.col(order).alias("o")))
    agg = df.filter(F.col(score).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), top.alias("top"), low.alias("low"), F.max(score).alias("score_chosen"), F.min(score).alias("score_rejected"))
    return agg.filter("n > 1").select(group, *[F.col(f"top.{k}").alias(f"{k}_chosen") for k in keep], *[F.col(f"low.{k}").alias(f"{k}_rejected") for k in keep], "score_chosen", "score_rejected")


def best_of_n(df: DataFrame, group: str, passed: str, order: str, keep: list[str], mode: str = "best_of_n", reference: str | None = None) -> DataFrame:
    """best_of_n: the completion that passes most tests (only one that passes any) against the one that passes least;
    reference: the reference completion against the worst; none: all completions in order."""
    if mode == "none":
        return df.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *keep))), lambda x: x[keep[0]]).alias(f"{keep[0]}_all"))
    pairs = best_and_worst(df, group, passed, order, keep)
    if mode == "reference":
        ref = df.groupBy(group).agg(F.min(reference).alias("_ref"))
        return pairs.join(ref, group).withColumn(f"{keep[0]}_chosen", F.col("_ref")).drop("_ref")
    return pairs.filter("score_chosen > 0")


def advantages(df: DataFrame, group: str, rewards: dict[str, float], eps: float = 1e-4) -> DataFrame:
    """df with reward (the weighted sum, NaN and null as 0) and advantage = (reward - mean) / (sample deviation + eps) of its group; 0 in a group of one.

    Group statistics are aggregated and joined back, so a hot group is no single task.
    """
    r = sum((F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * w for c, w in rewards.items()), F.lit(0.0))
    rows = df.withColumn("reward", r)
    stats = rows.groupBy(group).agg(F.avg("reward").alias("_m"), F.stddev_samp("reward").alias("_s"))
    return rows.join(stats, group).withColumn("advantage", F.when(F.col("_s").isNull(), 0.0).otherwise((F.col("reward") - F.col("_m")) / (F.col("_s") + eps))).drop("_m", "_s")


def nan_mean(c: str) -> Column:
    return F.avg(F.when(~F.isnan(F.col(c).cast("double")), F.col(c)))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin (1..bins), n over equal widths between the least and the greatest value, the greatest in the last bin; nulls and NaN are left out. The two bounds are read first."""
    own = df.select(F.col(value).cast("double").alias("v")).filter("v is not null and not isnan(v)")
    lo, hi = own.agg(F.min("v"), F.max("v")).first()
    at = F.lit(1) if lo is None or lo == hi else F.least(F.floor((F.col("v") - lo) / ((hi - lo) / bins)) + 1, F.lit(bins))
    return own.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def criterion_stats(df: DataFrame, group: str, scores: str) -> DataFrame:
    """group, criterion, n, mean, deviation (sample, 0 for one) over map-typed scores."""
    long = df.select(group, F.explode(scores).alias("criterion", "score")).filter("score is not null")
    return long.groupBy(group, "criterion").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.coalesce(F.stddev_samp("score"), F.lit(0.0)).alias("deviation"))


def hash_share(key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from the key's SHA-256, alike in every engine."""
    return F.conv(F.left(F.sha2(F.concat(F.lit(salt), key.cast("string")), 256), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def hash_split(key: Column, test: float, salt: str = "") -> Column:
    return F.when(hash_share(key, salt) < test, "test").otherwise("train")


def sample_rows(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """n rows, always the same: those with the least hash."""
    return df.orderBy(hash_share(F.col(key), salt), key).limit(n)


def choice(key: Column, options: list[str], salt: str = "") -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(hash_share(key, salt) * len(options)) + 1).cast("int"))


def resume_key(new: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("id", "prompt_id", "instruction", "Prompt", "text")) -> str | None:
    """The first of the keys that both have."""
    return next((k for k in keys if k in new.columns and k in done.columns), None)


def remaining(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't done; a null key counts as a value."""
    d = done.select(F.col(key).alias("_done")).distinct()
    return new.join(d, F.col(key).eqNullSafe(F.col("_done")), "left_anti")


def skip_done(new: DataFrame, n_done: int, order: str) -> DataFrame:
    """Without shared key: the rows after the first n_done in the order. Places are counted per partition of a range sort, so no task sees all rows."""
    parts = new.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id())
    sizes = parts.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(order)) + F.col("_before")
    return parts.join(F.broadcast(sizes.select("_part", "_before")), "_part").withColumn("_at", at).filter(F.col("_at") > n_done).drop("_at", "_part", "_before")


def join_last(left: DataFrame, right: DataFrame, on: dict[str, str], order: str, take: dict[str, str]) -> DataFrame:
    """Inner join on left = right keys where of equal right keys the last by `order` counts."""
    (lk, rk), *_ = on.items()
    last = right.filter(F.col(rk).isNotNull()).groupBy(rk).agg(F.max_by(F.struct(*take), F.col(order)).alias("_r"))
    own = last.select(F.col(rk).alias("_k"), *[F.col(f"_r.{c}").alias(a) for c, a in take.items()])
    return left.join(own, F.col(lk) == F.col("_k")).drop("_k")


def repeat_rows(df: DataFrame, n: int, name: str = "copy_no") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def fan_out(df: DataFrame, names: list[str], name: str = "model_id") -> DataFrame:
    """Every row with every name: a literal array exploded, no join."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, names))))


def zip_short(*arrays: Column) -> Column:
    """Arrays zipped to the length of the shortest."""
    n = F.least(*map(F.size, arrays)) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), 1, n)


def list_chunks(arr: Column, n: int) -> Column:
    """An array cut into arrays of n, the last one shorter."""
    return F.when(F.size(arr) > 0, F.transform(F.sequence(F.lit(0), ((F.size(arr) - 1) / n).cast("int")), lambda k: F.slice(arr, k * n + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def natural_key(c: Column) -> Column:
    """The digits of a name as a number."""
    return F.nullif(F.regexp_replace(c, r"[^0-9]", ""), F.lit("")).cast("long")


def common_pair_scores(a: Column, b: Column) -> Column:
    """Scores side by side for the criteria that both have."""
    return F.map_filter(F.map_zip_with(a, b, lambda k, x, y: F.struct(x.alias("a"), y.alias("b"))), lambda k, v: v["a"].isNotNull() & v["b"].isNotNull())
