"""Scores and rewards as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .extract import groups, hash_answer, xml_answer
from .text import ngrams, words

#: Weight of one, two and three successive words of the phrase lists.
WEIGHTS = {1: 1.0, 2: 2.0, 3: 8.0}


def slop_index(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, slop of every row: 1000 (w + 2 bi + 8 tri) / n over the words, 0 for a text without words.

    phrases: n (1, 2 or 3), phrase (lower case, words joined by spaces); repeats count once. Spark broadcasts the list as
    long as its size allows and joins by shuffle beyond that. Only listed phrases and one row a text with its length are
    kept for the sums; rows of one key are added up before the shuffle and count as one text.
    """
    toks = docs.select(key, text).select(key, words(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    gram = lambda n, g, size: F.struct(F.lit(n).alias("n"), g.alias("phrase"), size.alias("size"))
    counted = lambda n: F.transform(ngrams(F.col("t"), n) if n > 1 else F.col("t"), lambda g: gram(n, g, F.lit(0)))
    grams = F.concat(F.array(gram(0, F.lit(""), F.size("t"))), *map(counted, (1, 2, 3)))
    flat = toks.select(key, F.explode(grams).alias("g")).select(key, "g.n", "g.phrase", "g.size")
    listed = phrases.select(F.col("n").cast("int").alias("n"), "phrase").distinct().withColumn("weight", F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])[F.col("n")])
    hits = flat.join(listed, ["n", "phrase"], "left").filter("n = 0 or weight is not null")
    sums = hits.groupBy(key).agg(F.sum("size").cast("int").alias("n_tokens"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    return sums.select(key, "n_tokens", F.when(F.col("n_tokens") > 0, 1000.0 * F.col("w") / F.col("n_tokens")).otherwise(0.0).alias("slop"))


def antislop(slop: Column) -> Column:
    return F.greatest(F.lit(100.0) - slop, F.lit(0.0))


def total(m: Column) -> Column:
    """Sum of a map's values that aren't null."""
    return F.aggregate(F.filter(F.map_values(m), lambda v: v.isNotNull()), F.lit(0.0), lambda a, v: a + v)


def with_slop(m: Column, slop: Column, base: float = 50.0) -> Column:
    """A score map with the component Slop: base less the slop index. A null map stays null, so that a judge's empty reply nulls its own row only."""
    return F.map_concat(F.map_filter(m, lambda k, v: k != "Slop"), F.create_map(F.lit("Slop"), F.lit(base) - slop))


def judge_reward(m: Column) -> Column:
    """Mean of the scores clamped to 0..20 as a share, to two places; null for no score."""
    v = F.filter(F.map_values(m), lambda x: x.isNotNull())
    clamped = F.transform(v, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(20.0)) / 20.0)
    return F.when(F.size(v) > 0, F.round(F.aggregate(clamped, F.lit(0.0), lambda a, x: a + x) / F.size(v), 2))


def correctness(completion: Column, gold: Column) -> Column:
    """2 if the tagged or the hash-marked answer is the right one."""
    return F.when((xml_answer(completion) == gold) | F.coalesce(hash_answer(completion) == gold, F.lit(False)), 2.0).otherwise(0.0)


def integer_reward(completion: Column) -> Column:
    return F.when(xml_answer(completion).rlike("^[0-9]+$"), 0.5).otherwise(0.0)


def xml_count(c: Column) -> Column:
    """0.125 for each of four marks that occurs exactly once, less 0.001 for each character after the answer."""
    once = lambda rx: F.when(F.regexp_count(c, F.lit(rx)) == 1, 0.125).otherwise(0.0)
    after = lambda mark: F.length(F.substring_index(c, mark, -1))
    tail = lambda mark, less: F.when(F.regexp_count(c, F.lit(mark)) == 1, 0.125 - 0.001 * (after(mark.replace("\\n", "\n")) - less)).otherwise(0.0)
    return once("<reasoning>\n") + once("\n</reasoning>\n") + tail("\n<answer>\n", 0) + tail("\n</answer>", 1)


def soft_format(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)^<reasoning>.*?</reasoning>\s*<answer>.*?</answer>"), 0.5).otherwise(0.0)


def strict_format(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)^<reasoning>\n.*?\n</reasoning>\n<answer>\n.*?\n</answer>\n?$"), 0.25).otherwise(0.0)


def as_sets(g: Column) -> Column:
    return F.transform(g, lambda x: F.array_sort(F.array_distinct(x)))


def hard_groups(solution: Column, submitted: Column, most: int = 4) -> Column:
    """Share of the submitted groups that are solved, each solution once; 0 for none or too many."""
    solved = F.size(F.array_intersect(F.array_distinct(as_sets(submitted)), as_sets(solution)))
    return F.when((F.size(submitted) == 0) | (F.size(submitted) > most), 0.0).otherwise(solved / F.size(submitted))


def soft_groups(solution: Column, submitted: Column, most: int = 4, size: int = 4) -> Column:
    """Mean best overlap of the solution groups with submitted groups of the right size, a share of the groups submitted."""
    whole = F.filter(submitted, lambda x: F.size(x) == size)
    best = F.transform(as_sets(solution), lambda s: F.coalesce(F.array_max(F.transform(whole, lambda x: F.size(F.array_intersect(s, x)))), F.lit(0)))
    score = F.aggregate(best, F.lit(0), lambda a, b: a + b) / F.size(solution) / F.size(submitted)
    return F.when((F.size(whole) > most) | (F.size(submitted) == 0) | (F.size(solution) == 0), 0.0).otherwise(score)


def group_sizes(submitted: Column, size: int = 4) -> Column:
    return F.when(F.size(submitted) > 0, F.size(F.filter(submitted, lambda x: F.size(x) == size)) / F.size(submitted)).otherwise(0.0)


def group_count(submitted: Column, n: int = 4) -> Column:
    return F.when(F.size(submitted) == n, 1.0).otherwise(0.0)


def parsed_groups(c: Column) -> Column:
    return groups(c)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; null if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def pair_probability(a: Column, b: Column) -> Column:
    return 1 / (1 + F.exp(b - a))


def preference_metrics(chosen: Column, rejected: Column, beta: float = 0.1) -> list[Column]:
    """loss, accuracy and margin of a preference pair from the two rewards (log probability ratios)."""
    margin = beta * (chosen - rejected)
    return [F.log1p(F.exp(-margin)).alias("loss"), (chosen > rejected).cast("double").alias("accuracy"), margin.alias("margin")]


def percentile_label(x: Column, mean: Column, std: Column) -> Column:
    """The band of a value between the normal cut points at 10, 50, 90 and 100 per cent, closed on the right; null below the first."""
    z = 1.2815515655446004
    lo, mid, hi = mean - z * std, mean, mean + z * std
    return F.when(x < lo, F.lit(None).cast("string")).when(x <= mid, "10-50").when(x <= hi, "50-90").when(x > hi, "90-100")
