"""Keyword-stuffed and link-list pages: bagged trees on content and link features, smoothed by the host's spam rate.

Features are taken from every whole text in one scan. Weak labels come from clear cases only; the trees are fitted on a
bounded sample of them, applied to all pages, and each page's score is then pulled towards the rate of its host.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .trees import fit_bag, vote

FEATURES = ["n_words", "top_pair", "top_word", "repeated_pairs", "distinct", "function_words", "link_share", "tag_share", "stops", "separators", "line_words", "same_lines", "prose_share", "packed"]

# Frequent function words of seven languages.
FUNCTION_WORDS = frozenset(
    """the a an and or but of to in on at by for with from as if was were is are be been had has have not no nobody nor than that which who it its he she they his her their this
    those these there what when until while into out up only each one two so my your our we i you said though because just
    le la les un une des du de et que qui ne pas plus dans sur avec pour il elle se son sa ses est ce au aux mais
    der die das ein eine und den dem des nicht mit auf im zu war als ist sich noch wird da mehr
    el los las una y no en por su se del con para al lo otra que
    il lo gli uno e non di con per una che si sul della nella
    de het een en van niet op met voor dat was zijn te nog hij zij ze
    и в во не на что он она они с у к до по из за но а все это его ее был была""".split()
)

HAN = re.compile(r"[぀-ヿ㐀-鿿]")
DOMAIN = r"(?:example|invalid|test|com|net|org|info|biz|io|ru|cn|de|shop|xyz|top|site|online)"
LINK = re.compile(rf"""<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:[a-z]{{3,6}}:)?//[^\s<>"|,]+|\bwww\.[^\s<>"|,]+|\b[a-z0-9][a-z0-9-]*(?:\.[a-z0-9-]+)*\.{DOMAIN}\b(?:/[^\s<>"|,]*)?""", re.I)
LINKED = re.compile(rf"//|\]\(|www\.|<a\s|\.{DOMAIN}\b", re.I)
HASHTAG = re.compile(r"(?<!\w)#[^\W\d_]\w*")
STOP = re.compile(r"""[.!?…](?<!\.\.)[”"'’)\]]*(?=\s|$)|[。！？]""")
SEPARATOR = re.compile(r"[,|;•·]|\s[-–—]\s")
PART = re.compile(r"""[.!?…](?<=[^\W\d][^\W\d].)[”"'’)\]]*\s+|[。！？]|\n""")
WORD_MARKED, HAN_MARKED = re.compile(r"[^\W_]+|\x02"), re.compile(r"[぀-ヿ㐀-鿿]|\x02")
NUMBERED = re.compile(r"\s*(?:\d{1,3}[.)]|[IVXLC]{1,8}\.|[-*•]\s*\d)\s")


def words_of(parts: list[str], rx: re.Pattern) -> list[list[str]]:
    """The words of each part, found in one pass over all of them."""
    out: list[list[str]] = [[]]
    for w in rx.findall("\x02".join(parts)):
        if w == "\x02":
            out.append([])
        else:
            out[-1].append(w)
    return out


def measure(text: str) -> list[float]:
    """The features of one text, in the order of FEATURES.

    A part (sentence or line) counts as prose if its words are mostly different, enough of them are function words (or it
    is a numbered entry with one) and it does not hold the word pair that the page keeps repeating; the others are
    keywords, tags, links or entries.
    """
    size = max(1, len(text))
    links = tags = 0
    bare = text
    if LINKED.search(text):
        links = sum(len(m[0]) for m in LINK.finditer(text))
        bare = LINK.sub(" \x01 ", text)
    if "#" in bare:
        tags = sum(map(len, HASHTAG.findall(bare)))
    parts = [p for p in PART.split(bare.lower()) if p and not p.isspace()]
    han = not bare.isascii() and len(HAN.findall(bare)) > 0.3 * size
    told = words_of(parts, HAN_MARKED if han else WORD_MARKED)
    w = [x for p in told for x in p]
    n = max(1, len(w))
    known = FUNCTION_WORDS.__contains__
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.int64, len(w))
    names = list(ids)
    m = len(names)
    own = np.fromiter((not known(x) for x in names), bool, m)  # no function word
    seen = np.bincount(code, minlength=m)
    pairs, times = np.unique(code[:-1] * m + code[1:], return_counts=True) if len(w) > 1 else (code[:0], code[:0])
    content = times * (own[pairs // m] & own[pairs % m]) if m else times
    k = int(content.argmax()) if len(content) else 0
    top = int(content[k]) if len(content) else 0
    pair = (names[pairs[k] // m], names[pairs[k] % m]) if top else None
    kept = pair is not None and top >= 4 and 2 * top >= (0.2 if han else 0.1) * n
    good = every = 0
    for p, x in zip(parts, told):
        every += len(p)
        if not x or (tags and p.count("#") > 1) or (links and p.count("\x01") * 8 > len(x)):
            continue
        if kept and any(a == pair for a in zip(x, x[1:])):
            continue
        if han:
            good += len(p) if len(x) >= 8 and len(set(x)) >= 0.5 * len(x) else 0
            continue
        f = sum(map(known, x))
        if len(x) >= 4 and f >= 0.2 * len(x) and len(set(x)) >= 0.6 * len(x) or f and NUMBERED.match(p):
            good += len(p)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    raw = text.encode()
    return [
        float(n),
        2 * top / n,
        float((seen * own).max() / n) if m else 0.0,
        float(times[times >= 3].sum() / n),
        m / n**0.8,
        float((seen * ~own).sum() / n),
        links / size,
        tags / size,
        len(STOP.findall(bare)) / n,
        len(SEPARATOR.findall(bare)) / n,
        n / max(1, len(lines)),
        1 - len(set(lines)) / max(1, len(lines)),
        good / max(1, every),
        len(zlib.compress(raw, 1)) / max(1, len(raw)),
    ]


AT = {f: k for k, f in enumerate(FEATURES)}


def weak_label(x: np.ndarray) -> np.ndarray:
    """1 for clear spam, 0 for clear writing, -1 for anything else; x: rows of features."""
    g = lambda f: x[:, AT[f]]
    little, much = g("prose_share") < 0.35, g("prose_share") > 0.65
    stuffed = (g("top_pair") > 0.25) | (g("link_share") > 0.4) | (g("tag_share") > 0.4) | ((g("function_words") < 0.12) & (g("stops") < 0.03))
    clean = (g("top_pair") < 0.15) & (g("link_share") < 0.25) & (g("tag_share") < 0.15)
    return np.where(little & stuffed & (g("n_words") > 0), 1, np.where(much & clean, 0, -1))


def page_features(documents: DataFrame) -> DataFrame:
    """doc_id, host, x (features), label (weak) of each document with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hosts, texts = (b.column(k).to_pylist() for k in range(3))
            x = np.array([measure(t) for t in texts], np.float64).reshape(len(texts), len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(hosts, pa.string()), pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), pa.array(x.ravel(), pa.float64())), pa.array(weak_label(x), pa.int32())],
                names=["doc_id", "host", "x", "label"],
            )

    return documents.filter(F.col("text").rlike(r"\S")).mapInArrow(run, "doc_id long, host string, x array<double>, label int")


def find_spam(documents: DataFrame, sample: int = 4000, trees: int = 25, depth: int = 6, prior: float = 20.0, pull: float = 0.15, threshold: float = 0.5) -> DataFrame:
    """Spam score of every document: doc_id, host, page_score, host_rate, score, is_spam.

    documents: doc_id, text and, where there, source or url (the host); other columns are ignored. The trees see about
    `sample` weakly labelled pages of each label: those whose id's hash lies in the first `sample` / n of its range, n
    being the label's pages, so that only these rows ever reach the driver; everything else covers all pages.
    The host's rate is the mean page score with `prior` pages at the overall mean added; score = (1 - pull) page + pull
    host. Null, empty and blank texts score 0; if a label has no page, the weak rule stands in for the trees; a null
    host forms no group and keeps the overall mean. Repeated rows give one row each.
    """
    names = documents.columns
    host = F.col("source") if "source" in names else F.lit(None).cast("string")
    if "url" in names:
        host = F.coalesce(host, F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:]+)", 1)))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), host.alias("host"), "text")
    feats = cut(page_features(docs))
    rows = []
    for r in feats.filter("label >= 0").groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect():
        spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
        taken = feats.filter((F.col("label") == r.label) & (spot < F.lit(int(min(1.0, sample / r.n) * (1 << 40)))))
        rows += sorted(taken.dropDuplicates(["doc_id"]).select("doc_id", "x", "label").collect())
    x, y = np.array([r.x for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r.label for r in rows], float)
    bag = fit_bag(x, y, trees, depth) if 0 < y.sum() < len(y) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.asarray(b.column(2).flatten(), np.float64).reshape(b.num_rows, len(FEATURES))
            p = vote(bag, v) if bag else (weak_label(v) == 1).astype(float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64())], names=["doc_id", "host", "page_score"])

    pages = feats.select("doc_id", "host", "x").mapInArrow(score, "doc_id long, host string, page_score double")
    sums = cut(pages.groupBy("host").agg(F.sum("page_score").alias("s"), F.count("*").alias("n")))
    total = sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = (total.s or 0.0) / max(1, total.n or 0)
    rates = sums.filter(F.col("host").isNotNull()).select("host", ((F.col("s") + prior * mean) / (F.col("n") + prior)).alias("host_rate"))
    blank = docs.filter(F.col("text").isNull() | ~F.col("text").rlike(r"\S")).select("doc_id", "host", F.lit(0.0).alias("page_score"))
    joined = pages.unionByName(blank).join(rates, "host", "left").withColumn("host_rate", F.coalesce("host_rate", F.lit(mean)))
    return joined.select("doc_id", "host", "page_score", "host_rate", ((1 - pull) * F.col("page_score") + pull * F.col("host_rate")).alias("score")).withColumn("is_spam", (F.col("score") >= threshold) & (F.col("page_score") > 0))
