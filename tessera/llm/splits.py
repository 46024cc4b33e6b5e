"""Splits that keep related records together: spellings of authors and works are joined to entities, entities that share
records to components by random-mate contraction, and components are dealt to splits by cumulative weight."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from ..session import cut
from .components import components

# Stand-ins for a name or title.
NO_NAME = frozenset("unknown|various|various authors|anonymous|anon|none|null|nan|n/a|na|untitled|no title|no author|unknown author|author unknown|not known|tbd|-|--|?|_".split("|"))
TITLE_OF_PERSON = frozenset("dr mr mrs ms miss prof professor sir dame lord lady rev st by the".split())
ARTICLES = frozenset("the a an".split())
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
NUMBERS = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten".split())}
EXTENSION = re.compile(r"\.(?:txt|pdf|epub|html?|md|docx?|fdx|rtf)$")
VOLUME = re.compile(r"[,:;(\[ ]*\b(?:book|vol|volume|part|bk|no|episode)\b\.?\s*(?:the\s+)?([ivxlc]+|\d{1,3}|one|two|three|four|five|six|seven|eight|nine|ten)\b[)\]]?")
NOTE = re.compile(r"[(\[][^()\[\]]*[)\]]")
AFTER = re.compile(r"\s*(?:[-–—:,;]\s*)(?:(?:the\s+|a\s+|an\s+)?(?:shooting|final|first|second|third|working|original|revised)?\s*(?:script|screenplay|draft|novel|film|movie|motion picture|play|edition|tale|story|romance)(?:\s+\d+)?|(?:\d+(?:st|nd|rd|th)|new|revised|illustrated|first|second|third)\s+(?:ed|edition)\.?|illustrated|unabridged|annotated)\s*$")


def folded(s: str) -> str:
    s = unicodedata.normalize("NFKD", s).lower()
    return re.sub(r"\s+", " ", "".join(c for c in s if not unicodedata.combining(c))).strip()


def person(value: str) -> tuple[str, str] | None:
    """First and family name in one notation, the first name an initial where only that is given; None for a stand-in."""
    s = folded(value.replace("_", " "))
    if not s or s in NO_NAME or not any(c.isalpha() for c in s):
        return None
    parts = [p.strip() for p in s.split(",")]
    parts = [p for p in parts if p and not re.search(r"\d", p) and p.strip(".") not in ("jr", "sr", "ed", "eds", "author")]
    names = (parts[1].split() + parts[0].split()) if len(parts) > 1 else parts[0].split() if parts else []
    names = [n for n in (re.sub(r"[^\w'-]", "", n) for n in names) if n]
    while len(names) > 1 and names[0] in TITLE_OF_PERSON:
        names.pop(0)
    if not names or " ".join(names) in NO_NAME:
        return None
    return (" ".join(names[:-1]), names[-1])


def number(s: str) -> int:
    if s.isdigit():
        return int(s)
    if s in NUMBERS:
        return NUMBERS[s]
    v = [ROMAN[c] for c in s]
    return sum(-a if a < b else a for a, b in zip(v, v[1:] + [0]))


def work(value: str) -> str | None:
    """A title without articles, edition, draft and year, with its volume as a number; None for a stand-in."""
    s = folded(value)
    if not s or s in NO_NAME:
        return None
    s = EXTENSION.sub("", s)
    s = s.replace("_", " ")
    if " " not in s:
        s = s.replace("-", " ")
    s = s.replace("&", " and ")
    vol = ""
    if m := list(VOLUME.finditer(s)):
        vol = f" #{number(m[-1][1])}"
        s = s[: m[-1].start()] + " " + s[m[-1].end() :]
    s = NOTE.sub(" ", s)
    before = None
    while before != s:
        before, s = s, AFTER.sub("", s.strip(" .,:;"))
    w = re.findall(r"[^\W_]+", s)
    while len(w) > 1 and w[0] in ARTICLES:
        w.pop(0)
    while len(w) > 1 and w[-1] in ARTICLES and "," in s:
        w.pop()
    t = " ".join(w)
    return (t + vol) if t and t not in NO_NAME else None


KEYED = "kind string, value string, key string, first string, family string"


def keys_of(values: DataFrame) -> DataFrame:
    """kind, value, key, first, family of distinct values; stand-ins are left out. values: kind ('author' or 'work'), value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if kind == "author":
                    if p := person(v):
                        rows.append((kind, v, f"author:{p[0]} {p[1]}", *p))
                elif w := work(v):
                    rows.append((kind, v, f"work:{w}", None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(5)], names=["kind", "value", "key", "first", "family"])

    return values.select("kind", "value").filter("value is not null").distinct().mapInArrow(run, KEYED)


def one_edit(a: Column, b: Column) -> Column:
    """Equal, or one letter put in, left out, changed, or two neighbours exchanged."""
    swapped = F.exists(F.sequence(F.lit(1), F.length(a) - 1), lambda k: F.concat(F.substring(a, F.lit(1), k - 1), F.substring(a, k + 1, F.lit(1)), F.substring(a, k, F.lit(1)), F.substring(a, k + 2, F.length(a))) == b)
    return (F.levenshtein(a, b, 1) >= 0) | ((F.length(a) > 1) & (F.length(a) == F.length(b)) & (F.levenshtein(a, b, 2) == 2) & swapped)


def misspellings(names: DataFrame, least: int = 8) -> DataFrame:
    """Edges a, b between keys of persons one edit apart. names: key, first, family (distinct).

    Names that share a form with one letter left out are compared; such a bucket holds different strings one letter away
    from one string, so it is bounded by the alphabet. Two different first names (or families) that both occur with
    several families (first names) are different persons, however alike.
    """
    before = len("author:")
    full = names.filter(F.length("first") > 1).filter(F.length("key") >= least + before)
    known_first = full.groupBy("first").agg((F.count_distinct("family") >= 3).alias("first_known"))
    known_family = full.groupBy("family").agg((F.count_distinct("first") >= 2).alias("family_known"))
    full = full.join(known_first, "first").join(known_family, "family")
    left_out = F.transform(F.sequence(F.lit(before + 1), F.length("key")), lambda k: F.concat(F.substring("key", F.lit(1), k - 1), F.substring("key", k + 1, F.length("key"))))
    forms = full.select("*", F.explode(F.array_distinct(F.concat(F.array("key"), left_out))).alias("form"))
    other = forms.select("form", *(F.col(c).alias(c + "2") for c in ("key", "first", "family", "first_known", "family_known")))
    pairs = forms.join(other, "form").filter("key < key2").filter("first = first2 or not (first_known and first_known2)").filter("family = family2 or not (family_known and family_known2)").filter("first = first2 or family = family2")
    return pairs.select(F.col("key").alias("a"), F.col("key2").alias("b")).distinct().filter(one_edit(F.col("a"), F.col("b")))


def initials(names: DataFrame, labels: DataFrame) -> DataFrame:
    """key, person of every key with an initial: the only person of that family whose first name starts so. labels: key, label."""
    short = names.filter("length(first) = 1").select("key", "first", "family")
    full = names.filter("length(first) > 1").join(labels, "key", "left").select(F.substring("first", 1, 1).alias("first"), "family", F.coalesce("label", "key").alias("label"))
    only = full.groupBy("first", "family").agg(F.min("label").alias("person"), F.max("label").alias("most")).filter("person = most")
    return short.join(only, ["first", "family"]).select("key", "person")


def entities(values: DataFrame) -> DataFrame:
    """kind, value, entity of every value that names something. values: kind, value (repeats and nulls allowed).

    Misspellings are contracted once; a name with an initial has no edge but the one to its person, so it takes that
    person's label and needs no contraction of its own.
    """
    keyed = cut(keys_of(values))
    names = keyed.filter("kind = 'author'").select("key", "first", "family").distinct()
    labels = cut(components(misspellings(names)).withColumnRenamed("v", "key"))
    label = names.select("key").join(labels, "key", "left").join(initials(names, labels), "key", "left").select("key", F.coalesce("label", "person").alias("label"))
    return keyed.join(label, "key", "left").select("kind", "value", F.coalesce("label", "key").alias("entity"))


def entity_classes(values: DataFrame) -> DataFrame:
    """kind, value, entity, n_values: each value with its class and the number of different values in it; one row a value."""
    e = cut(entities(values))
    return e.join(e.groupBy("entity").agg(F.count("*").alias("n_values")), "entity").select("kind", "value", "entity", "n_values")


def entity_values(processed_rows: DataFrame, scenes: DataFrame) -> DataFrame:
    part = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("value"))
    return part(processed_rows, "author", "author").unionByName(part(processed_rows, "work", "title")).unionByName(part(scenes, "work", "name"))


def same_entity_pairs(processed_rows: DataFrame, scenes: DataFrame, part: int = 256) -> DataFrame:
    """entity_kind, value_a, value_b: all pairs of different spellings of one entity, value_a first by code points.

    Null and placeholder values name nothing; spellings of several works by one author stay apart. Empty tables give
    none. The pairs are the stated result; entity_classes() gives the same as one row a value. An entity of more than
    `part` values is dealt to several tasks.
    """
    e = entity_classes(entity_values(processed_rows, scenes)).withColumn("parts", F.ceil(F.col("n_values") / part).cast("long"))
    a = e.select("entity", F.col("kind").alias("entity_kind"), F.col("value").alias("value_a"), F.pmod(F.xxhash64("value"), "parts").alias("part"))
    b = e.select("entity", F.col("value").alias("value_b"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["entity", "part"]).filter("value_a < value_b").select("entity_kind", "value_a", "value_b")


def assign_splits(processed_rows: DataFrame, scenes: DataFrame, shares: DataFrame, heavy: float = 0.01, buckets: int = 1024) -> DataFrame:
    """row_table, row_id, component, split_name of every row, close to the shares and with no author or work in two splits.

    processed_rows: row_id, author, title; scenes: scene_id, name; shares: split_name, share (normalised to 1). Rows that
    name nobody and nothing are components of their own, one for each id. Components of more than `heavy` of all rows, at
    most 1 / heavy of them, are dealt one by one to the split that lacks most; the others by cumulative weight in the order
    of a hash. Repeated rows share their id's split; null ids count as one id. Rows without a name and rows of frequent
    names are joined without a shuffle (lookup).
    """
    e = cut(entities(entity_values(processed_rows, scenes)))
    author = e.filter("kind = 'author'").select(F.col("value").alias("author"), F.col("entity").alias("who"))
    title = e.filter("kind = 'work'").select(F.col("value").alias("title"), F.col("entity").alias("what"))
    row = lambda name, key, c: [F.lit(name).alias("row_table"), F.col(key).cast("long").alias("row_id"), F.col(c).alias("title")]
    written = lookup(processed_rows.select(*row("processed_rows", "row_id", "title"), "author"), author, "author").drop("author")
    named = written.unionByName(scenes.select(*row("scenes", "scene_id", "name"), F.lit(None).cast("string").alias("who")))
    own = F.concat_ws(":", F.lit("row"), "row_table", F.coalesce(F.col("row_id").cast("string"), F.lit("")))
    rows = cut(lookup(named, title, "title").select("row_table", "row_id", own.alias("own"), "who", "what"))
    # an id that recurs with other names, or with none, ties them together through its own vertex
    again = rows.groupBy("own").agg(F.min(F.struct("who", "what")).alias("lo"), F.max(F.struct("who", "what")).alias("hi")).filter("lo <> hi").select("own")
    ties = rows.join(again, "own", "left_semi").select(F.coalesce("who", "what").alias("a"), F.col("own").alias("b")).filter("a is not null")
    edges = rows.select(F.coalesce("who", "what").alias("a"), F.coalesce("what", "who").alias("b")).filter("a is not null").unionByName(ties).distinct()
    labels = cut(components(edges))
    of = cut(lookup(rows.select("row_table", "row_id", F.coalesce("who", "what", "own").alias("v")), labels, "v").select("row_table", "row_id", F.coalesce("label", "v").alias("component")))
    weights = cut(of.groupBy("component").agg(F.count("*").alias("weight")))
    total = weights.agg(F.sum("weight")).first()[0] or 0
    wanted = {r.split_name: r.share for r in shares.collect()}
    scale = sum(wanted.values()) or 1.0
    lack = {k: v / scale * total for k, v in wanted.items()}
    dealt = []
    for r in weights.filter(F.col("weight") > heavy * total).orderBy(F.desc("weight"), "component").collect():
        to = max(lack, key=lambda k: (lack[k], k))
        lack[to] -= r.weight
        dealt.append((r.component, to))
    fixed = weights.sparkSession.createDataFrame(dealt, "component string, fixed string") if dealt else None
    rest = weights.join(F.broadcast(fixed.select("component")), "component", "left_anti") if dealt else weights
    place = rest.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets))).withColumn("order", F.xxhash64(F.lit(1), "component"))
    sums = place.groupBy("bucket").agg(F.sum("weight").alias("in_bucket"))
    offsets = sums.withColumn("before", F.sum("in_bucket").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("bucket", F.coalesce("before", F.lit(0)).alias("before"))
    run = F.sum("weight").over(Window.partitionBy("bucket").orderBy("order", "component")) - F.col("weight") / 2
    middle = place.join(F.broadcast(offsets), "bucket").withColumn("middle", F.col("before") + run)
    left = {k: max(0.0, v) for k, v in lack.items()}
    size = sum(left.values()) or 1.0
    more = sum(lack.values())
    pick, edge = F.lit(None).cast("string"), 0.0
    for name in sorted(left, key=lambda k: (left[k], k)):
        edge += left[name] / size * more
        pick = F.coalesce(pick, F.when(F.col("middle") <= edge, F.lit(name)))
    if left:
        pick = F.coalesce(pick, F.lit(max(left, key=lambda k: (left[k], k))))
    chosen = middle.select("component", pick.alias("split_name"))
    if dealt:
        chosen = chosen.unionByName(fixed.select("component", F.col("fixed").alias("split_name")))
    return lookup(of, chosen, "component").select("row_table", "row_id", "component", "split_name")
