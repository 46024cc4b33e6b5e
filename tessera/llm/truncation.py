"""Texts cut off by a field limit or mid-transfer.

1. Near-copies: min-hash bands over five-word shingles bring copies together, verified pairs are aligned word by word, and
   the copy whose alignment ends early, inside a sentence, is cut. Copies cut however short, but otherwise equal, are found
   exactly by sorting.
2. Records without such a copy: structures left open and cut marks are certain; otherwise the closing word is scored by
   its terminality, how often it closes a sentence or entry in the whole corpus, beside stock closings and length-limit
   spikes. All measures are rates, so a text's verdict doesn't hang on the size of the table.
finish_reason is not used: it is partly wrong, and every case it names correctly is seen from the text.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lookup import lookup
from ..session import cut, cut_table

ENDING = "id string, hash long, length int, kind string, cut boolean, word string, tail string"
ENDING_NAMES = ["hash", "length", "kind", "cut", "word", "tail"]

MARK = re.compile(r"(?:\[(?:\.\.\.|…|truncated|cut|cut off|continued|snip)\]|\((?:truncated|continued|cut off)\)|<(?:truncated|cut)>|�+|\\u[0-9a-fA-F]{0,3}|\\|<(?:/?[a-zA-Z]\w*)?|&#?\w{0,6})$", re.I)
DOTS = re.compile(r"""(?:…|\.\.\.)[”"'’)\]*_]*$""")
CLOSED = re.compile(r"""[.!?。！？؟।][”"'’»)\]*_`~]*$""")
ENTRY = re.compile(r"\s*(?:[-*•+]|\d{1,3}[.)])\s+")
SIGNATURE = re.compile(r"[A-Z][\w' .-]{0,40},$")
NAME = re.compile(r"[A-ZÀ-Þ]\w+(?: [A-ZÀ-Þ]\w*\.?){0,2}$")
FIGURE = re.compile(r"(?:[\w ]{1,30}[:=]\s*)?[-+$€£]?\d[\d.,:/]*\s?[%°\w]{0,3}$")
CAPS = re.compile(r"[^a-zß-ÿ]*[A-ZÀ-Þ]{2}[^a-zß-ÿ]*$")
TAG = re.compile(r"<(/?)([a-z_][\w-]*)>")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
HAN = re.compile(r"[぀-ヿ㐀-鿿]")
STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
LOOSE = frozenset("br hr p li img input meta link".split())


def ending(text: str) -> tuple[str, bool | None, str, str]:
    """How a text ends: its kind, whether it is cut (None where the corpus has to tell), its closing word, its last four words."""
    s = text.rstrip(" \t\r\n ​")
    if not s:
        return "none", False, "", ""
    end = s[-200:]  # longer than every mark
    if MARK.search(end):
        return "mark", True, "", ""
    body = s.lstrip()
    if body[0] in "{[" and (body[0] == "{" or body[1:2] in ('"', "{", "[", "]") or body[1:2].isdigit()):
        try:
            json.loads(body)
            return "json", False, "", ""
        except RecursionError:  # nested too deep for the parser: whole if every bracket is closed again
            bare = STRING.sub("", body)
            return "json", any(bare.count(a) != bare.count(b) for a, b in ("[]", "{}")), "", ""
        except ValueError:
            if body.count('"') or body[0] == "{":
                return "json", True, "", ""
    if s.count("```") % 2:
        return "fence", True, "", ""
    still: list[str] = []
    for close, name in TAG.findall(s) if "<" in s else ():
        if name in LOOSE:
            continue
        if not close:
            still.append(name)
        elif name in still:
            del still[len(still) - 1 - still[::-1].index(name) :]
    if still and body.startswith("<"):
        return "tag", True, "", ""
    if s.endswith("```") or (s.endswith(">") and re.search(r"</[a-z_][\w-]*>$", s)):
        return "closed", False, "", ""
    lines = s.split("\n")
    last = lines[-1].strip()
    low = end.lower()
    w = WORD.findall(low)
    word, tail = (w[-1] if w else ""), " ".join(w[-4:])
    odd = (last.count('"') % 2 == 1) or (last.count("“") > last.count("”"))
    if DOTS.search(end):
        return "dots", None, word, tail
    if CLOSED.search(end):
        if odd and not s.endswith(('"', "”")):
            return "quote", True, word, tail
        return "stop", None if not HAN.search(s[-3:]) else False, word, tail
    if HAN.search(s[-2:]):
        return "open", True, "", ""
    before = next((x.strip() for x in lines[-2::-1] if x.strip()), "")
    if ENTRY.match(lines[-1]):
        return "entry", None, word, tail
    if SIGNATURE.match(before) and len(before.split()) <= 4 and NAME.match(last):
        return "sign", False, word, tail
    if FIGURE.match(last):
        return "figure", False, word, tail
    if CAPS.match(last) and (before or len(w) <= 12):
        return "caps", None, word, tail
    if len(w) <= 2 and len(WORD.findall(s)) <= 2 and not last.endswith((",", ";", "-")):
        return "short", None, word, tail
    return "open", None, word, tail


STOP = re.compile("[.!?]")
MARKED = re.compile(r"^[ \t]*(?:[-*•+]|\d{1,3}[.)])[ \t]+", re.M)


class WordCounts:
    """How often each word stands in a kind of place (entry of a list, prose) and how often it closes it."""

    COLUMNS = ("place", "word", "n", "closed")

    def __init__(self):
        self.n = {"prose": Counter(), "entry": Counter()}
        self.closed = {"prose": Counter(), "entry": Counter()}

    def __len__(self) -> int:
        return len(self.n["prose"]) + len(self.n["entry"])

    def add(self, text: str) -> None:
        """Count a text; the word that ends it tells nothing and is left out."""
        low = text.rstrip().lower()
        prose = low
        if MARKED.search(low):
            lines = low.split("\n")
            entry = [bool(ENTRY.match(x)) for x in lines]
            for k, line in enumerate(lines):
                if entry[k]:
                    w = WORD.findall(line[ENTRY.match(line).end() :])
                    if w and k < len(lines) - 1:
                        self.n["entry"][w[-1]] += 1
                        self.closed["entry"][w[-1]] += 1
                    self.n["entry"].update(w[:-1])
            prose = "\n".join(x for x, e in zip(lines, entry) if not e)
            own_end = not entry[-1]
        else:
            own_end = True
        words: list[str] = []
        closers: list[str] = []
        parts = STOP.split(prose)
        for k, part in enumerate(parts):
            w = WORD.findall(part)
            words += w
            if w and k < len(parts) - 1 and part[-1].isalnum():
                closers.append(w[-1])
        if own_end and words:
            last = next((p for p in parts[::-1] if p and not p.isspace()), "")
            if not WORD.search(parts[-1]) and last[-1:].isalnum() and closers and closers[-1] == words[-1]:
                closers.pop()
            words.pop()
        self.n["prose"].update(words)
        self.closed["prose"].update(closers)

    def take(self) -> dict[str, list]:
        """The counts as columns; counting starts anew."""
        keys = [(place, w) for place in ("prose", "entry") for w in self.n[place]]
        out = {"place": [p for p, _ in keys], "word": [w for _, w in keys], "n": [self.n[p][w] for p, w in keys], "closed": [self.closed[p][w] for p, w in keys]}
        self.__init__()
        return out


def word_columns(counts: WordCounts, schema: pa.Schema) -> pa.RecordBatch:
    """The counts as rows of a wider schema, whose other columns are null."""
    own = counts.take()
    n = len(own["word"])
    return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(n, f.type) for f in schema], schema=schema)


def ending_columns(texts: list[str | None]) -> list[pa.Array]:
    """The columns of ENDING_NAMES for texts; the hash is that of the text without white space at its end."""
    bare = [(x or "").rstrip() for x in texts]
    e = [ending(x) for x in bare]
    return [pa.array([hash_of(x) - 2**63 for x in bare], pa.int64()), pa.array(map(len, bare), pa.int32()), *(pa.array([x[k] for x in e], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.string(), pa.string())))]


SCANNED = f"{ENDING}, tails array<long>, place string, n long, closed long"


def scanned(rows: DataFrame, flush: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Everything that one pass over the texts gives, written once: the endings (ENDING and the keys of the closing words), one row an id and text; and place, word, n, closed over all texts, counted per partition first. rows: id string, text."""
    names = [*ENDING.replace(",", "").split()[::2], "tails", "place", "n", "closed"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64(), pa.int64()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = WordCounts()
        for b in batches:
            texts = b.column(1).to_pylist()
            for t in texts:
                if t:
                    counts.add(t)
            tails = [closing_keys((x or "").rstrip()) for x in texts]
            none = [pa.nulls(len(texts), k) for k in kinds[-3:]]
            yield pa.RecordBatch.from_arrays([b.column(0), *ending_columns(texts), pa.array(tails, kinds[7]), *none], schema=schema)
            if len(counts) > flush:
                yield word_columns(counts, schema)
        yield word_columns(counts, schema)

    all_ = cut_table(rows.select("id", "text").mapInArrow(run, SCANNED))
    return all_.filter("place is null").select(*ENDING.replace(",", "").split()[::2], "tails"), added(all_)


def added(counts: DataFrame) -> DataFrame:
    """place, word, n, closed summed over all partitions; written, as several sums are taken over them."""
    return cut_table(counts.filter("place is not null").groupBy("place", "word").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed")))


def cut_share(scores: list[tuple[float, int]], sure: float = 9.0, doubt: float = 1.0) -> float:
    """The share of cut endings among open ones, by expectation maximisation over (log likelihood ratio, number) with a weak prior of sure : doubt."""
    share, total = sure / (sure + doubt), sum(n for _, n in scores) + sure + doubt
    for _ in range(100):
        share = (sum(n / (1 + (1 - share) / share * math.exp(-x)) for x, n in scores) + sure) / total
    return min(share, 1 - 1e-9)


def broken(words: DataFrame, counts: DataFrame, at_most: float = 0.01) -> DataFrame:
    """word of those that are hardly ever whole: as words they make up at most that share of all words that begin so. words: word, distinct."""
    prose = counts.filter("place = 'prose'")
    longer = prose.filter(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("word"), F.col("n").alias("more"))
    more = longer.groupBy("word").agg(F.sum("more").alias("more"))
    known = words.join(more, "word").join(prose.select("word", "n"), "word", "left")
    return known.filter(F.coalesce("n", F.lit(0)) <= at_most * F.col("more")).select("word")


def judged(ends: DataFrame, counts: DataFrame, stock: float = 0.01, spike: float = 8.0, finished: float = 0.999) -> DataFrame:
    """id, kind and cut for every ending. ends: ENDING; counts: place, word, n, closed.

    A word's terminality is the share of its places that it closes, with one place at the overall rate added. An entry or
    a text with dots is cut if its word closes less than every fourth; one with a full stop only if even the upper 95 %
    bound of its word's rate (rule of three; other texts that end so count as closed) is a fiftieth of the overall rate.
    An open ending is scored by the likelihood of its word among all running words against that among closing words, with
    the share of cut endings estimated from all of them (cut_share): it is cut unless it is finished at odds of `finished`.
    Short texts and capitals are cut where their word is broken off (broken). A stock closing is a last-four-words tail that
    at least `stock` of the endings of its kind (and three of them) share; a spike is a length that `spike` times as many
    endings of that kind have as its neighbours on average. Equal texts count once in all this.
    """
    certain = ends.filter("cut is not null").select("id", "kind", "cut")
    place = F.when(F.col("kind") == "entry", "entry").otherwise("prose")
    kinds = cut_table(ends.filter("cut is null").select("kind", "word", "tail", "length", "hash").distinct())
    tails = kinds.groupBy("kind", "tail").agg(F.count("*").alias("tail_n"))
    totals = {r.kind: r.n for r in kinds.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    kind_n = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in totals.items()], F.lit(0))
    known = tails.filter((F.col("tail_n") >= 3) & (F.col("tail_n") >= stock * kind_n)).select("kind", "tail", F.lit(True).alias("stock"))  # at most 1 / stock a kind
    by_length = kinds.filter("kind = 'dots'").groupBy("length").agg(F.count("*").alias("here"))
    around = by_length.select(F.explode(F.sequence(F.col("length") - 12, F.col("length") + 12)).alias("length"), F.col("here").alias("near")).groupBy("length").agg(F.sum("near").alias("near"))
    spikes = by_length.join(around, "length").filter((F.col("here") >= 5) & (F.col("here") >= spike * F.greatest((F.col("near") - F.col("here")) / 24.0, F.lit(0.3)))).select(F.col("length").alias("dots_length"), F.lit(True).alias("spike"))
    spikes, known = cut_table(spikes), cut_table(known)
    sums = {r.place: (r.n, r.closed) for r in counts.groupBy("place").agg(F.sum("n").alias("n"), F.sum("closed").alias("closed")).collect()}
    (n_all, closed_all), base = sums.get("prose", (0, 0)), {k: (c + 0.1) / (n + 1) for k, (n, c) in sums.items()}
    p = F.when(place == "entry", F.lit(base.get("entry", 0.1))).otherwise(F.lit(base.get("prose", 0.1)))
    vocabulary = kinds.groupBy("kind", "word").agg(F.count("*").alias("ends")).withColumn("place", place)
    own = vocabulary.join(counts, ["place", "word"], "left").select("kind", "word", "ends", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("closed", F.lit(0)).alias("closed"), p.alias("base"))
    # a closing whose own place is the end of a text counts in closed only, so closed may exceed n
    running = (F.greatest(F.col("n") - F.col("closed"), F.lit(0)) + 1 - F.col("base")) / F.lit(max(n_all - closed_all, 0) + 1)
    closing = (F.col("closed") + F.col("base")) / F.lit(closed_all + 1)
    own = cut_table(own.withColumn("closes", (F.col("closed") + F.col("base")) / (F.col("n") + 1)).withColumn("score", F.log(running / closing)))
    bins = own.filter("kind = 'open'").groupBy(F.round(F.col("score") * 4).alias("bin")).agg(F.sum("ends").alias("n")).collect()  # a score lies within some 40, so these are few
    share = cut_share([(r.bin / 4, r.n) for r in bins])
    odds = F.lit(share / (1 - share)) * F.exp("score")
    fragment = broken(own.filter("kind in ('caps', 'short')").filter((F.length("word") > 2) & ~F.col("word").rlike("^([ivxlcdm]+|[0-9]+)$")).select("word").distinct(), counts).select("word", F.lit(True).alias("fragment"))
    least = (
        F.when(F.col("kind") == "stop", (F.col("closed") + F.col("ends") - 1 + 3) / (F.col("n") + F.col("ends")) < 0.02 * F.col("base"))
        .when(F.col("kind").isin("dots", "entry"), F.col("closes") < 0.25)
        .when(F.col("kind").isin("caps", "short"), F.coalesce("fragment", F.lit(False)))
        .otherwise(odds / (1 + odds) > 1 - finished)
    )
    verdicts = cut_table(own.join(fragment, "word", "left").select(F.concat_ws(":", "kind", "word").alias("key"), least.alias("likely")))
    open_ = ends.filter("cut is null").join(F.broadcast(known), ["kind", "tail"], "left").select("id", "kind", F.coalesce("stock", F.lit(False)).alias("stock"), F.concat_ws(":", "kind", "word").alias("key"), F.when(F.col("kind") == "dots", F.col("length")).alias("dots_length"))
    dots = cut_table(lookup(open_.filter("kind = 'dots'"), spikes, "dots_length"))
    scored = lookup(open_.filter("kind <> 'dots'").withColumn("spike", F.lit(None).cast("boolean")).unionByName(dots), verdicts, "key")
    likely, spiky = F.coalesce("likely", F.lit(False)), F.coalesce("spike", F.lit(False))
    verdict = F.when(F.col("kind").isin("stop", "entry"), likely).when(F.col("kind") == "dots", ~F.col("stock") & (spiky | likely)).otherwise(~F.col("stock") & likely)
    return certain.unionByName(scored.select("id", "kind", verdict.alias("cut")))


# --- near-copies ---------------------------------------------------------------------------------------------------

SEEDS = np.random.default_rng(17).integers(1, 2**63, (2, 80), dtype=np.uint64) | np.uint64(1)
TOKEN = re.compile(r"[^\W_]+|[.!?。！？]")


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(s)


class Hashes(dict):
    """The hash of every token seen; emptied when it gets large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[token] = hash_of(token)
        return h


def ends_early(short: str, long: str, identity: float = 0.8) -> bool:
    """Whether short, aligned word by word with long, stops inside a word or sentence of it.

    All words of short are aligned with a stretch of long (match 1, change or gap -1), of which at least `identity` must
    agree; the last word of short may be the beginning of the one in its place. A text that ends with a full stop, lacks no more
    than the last one of long, or has fewer than six tokens, is not cut.
    """
    a, b = TOKEN.findall(short.lower()), TOKEN.findall(long.lower())
    if len(a) < 6 or a[-1] in STOPS:
        return False
    code = {w: k for k, w in enumerate(dict.fromkeys(b))}
    y = np.fromiter((code[w] for w in b), np.int32, len(b))
    step = np.arange(len(b) + 1, dtype=np.int32)
    h = np.zeros(len(b) + 1, np.int32)
    for i, w in enumerate(a):
        eq = y == code.get(w, -1) if i < len(a) - 1 else np.fromiter((x.startswith(w) for x in b), bool, len(b))
        g = np.empty_like(h)
        g[0] = -i - 1
        g[1:] = np.maximum(h[:-1] + np.where(eq, 1, -1), h[1:] - 1)
        h = np.maximum.accumulate(g + step) - step
    j = int(h.argmax())
    if j == 0 or h[j] < (2 * identity - 1) * len(a):
        return False
    return (b[j - 1] != a[-1] and b[j - 1].startswith(a[-1])) or (j < len(b) and (b[j] not in STOPS or j + 1 < len(b)))


MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
#: Tokens of a closing stretch. A text too short for one is a near-copy only if it is equal so far, which sorting finds.
STRETCH = 8
STOPS = frozenset(".!?。！？")
#: Least and most bits of a filter that is broadcast (1 and 32 MB). It has 16 bits a key or more; only from 16 million keys
#: on it lets more than two in a hundred through, which the exact join behind it drops.
SPOTS = 2**23, 2**28


HASHES = Hashes()


def mixed(h: np.ndarray, n: int) -> np.ndarray:
    """A key of every n successive hashes."""
    w = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n):
        w += (h[k : k + len(w)] ^ MIX[k]) * MIX[k]
        w ^= w >> np.uint64(29)
    return w


def hashed_tokens(t: list[str]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, t), np.uint64, len(t))


def own_places(tokens: list[str]) -> list[int]:
    """Where the closing stretches of a text begin: before its last token, and before that stretch, so that an edit near the cut spoils one only; none where ends_early can't hold."""
    n = len(tokens) - 1 - STRETCH
    return [k for k in (n, n - STRETCH) if k >= 0] if tokens and tokens[-1] not in STOPS else []


def closing_keys(text: str) -> list[int] | None:
    """The keys of a text's closing stretches; only its last tokens are read."""
    most = 2 * STRETCH + 1
    t = TOKEN.findall(text[-240:].lower())
    if len(text) > 240 and len(t) <= most:  # the first of them may be cut
        t = TOKEN.findall(text.lower())
    t = t[-most:]
    own = own_places(t)
    return mixed(hashed_tokens(t), STRETCH)[own].view(np.int64).tolist() if own else None


def signature(tokens: list[str], h: np.ndarray) -> list[int] | None:
    """80 min-hashes of the five-word shingles, full stops left out; None for fewer than five words."""
    own = mixed(h[np.fromiter((x not in STOPS for x in tokens), bool, len(tokens))], 5)
    if not len(own):
        return None
    return ((own[:, None] * SEEDS[0] + SEEDS[1]) >> np.uint64(33)).min(0).astype(np.int32).tolist()


def joint_keys(windows: np.ndarray, sig: np.ndarray, bands: int) -> np.ndarray:
    """A key of every window with every band of the signature."""
    part = sig.astype(np.uint64).reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64) * MIX[0]
    for k in range(part.shape[1]):
        key = (key ^ part[:, k]) * MIX[1 + k % 4]
        key ^= key >> np.uint64(31)
    out = (windows[:, None] ^ key[None, :]) * MIX[2]
    return (out ^ out >> np.uint64(32)).ravel()


def key_filter(keys: DataFrame) -> np.ndarray:
    """The bits of all keys (key long, read twice), two a key, SPOTS of them by the number of keys; built by an aggregation."""
    spots = min(max(1 << (16 * keys.count()).bit_length(), SPOTS[0]), SPOTS[1])
    spot = F.explode(F.array(F.col("key").bitwiseAND(spots - 1), F.shiftrightunsigned("key", 32).bitwiseAND(spots - 1))).alias("spot")
    bits = np.zeros(spots // 8, np.uint8)
    places = keys.select(spot).select(F.floor(F.col("spot") / 32768).cast("int").alias("block"), F.pmod("spot", F.lit(32768)).cast("int").alias("at")).distinct()
    # keys are shuffled, not a bitmap of every task
    for r in places.repartition("block").groupBy("block").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits")).toLocalIterator():
        bits[r.block * 4096 : r.block * 4096 + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return bits


def passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = np.uint64(8 * len(bits) - 1)
    first, second = keys & at, keys >> np.uint64(32) & at
    there = [bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8) for x in (first, second)]
    return there[0] & there[1] & 1 == 1


def near_copies(rows: DataFrame, tails: DataFrame | None = None, bands: int = 16, similarity: float = 0.8) -> DataFrame:
    """id of texts that are a shortened near-copy of another. rows: id string, text; tails: the endings of scanned(), where they are there already.

    Two texts are held against each other where they share a band and the longer one has a closing stretch of the shorter one,
    so every pair of a bucket that could show a cut is tried, and no other: a hot bucket is parted by the stretches,
    and nothing of it is left out. Keys with bands are made only for the stretches that close one text and stand elsewhere in
    another, which an exact join of both tells. Pairs whose min-hashes agree are aligned (ends_early). Equal texts are no pair.
    """
    spark = rows.sparkSession
    rows = rows.select("id", "text")
    tails = scanned(rows)[0] if tails is None else tails
    tail_bits = spark.sparkContext.broadcast(key_filter(tails.filter("tails is not null").select(F.explode("tails").alias("key"))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        bits = tail_bits.value
        for b in (x.slice(k, 1000) for x in batches for k in range(0, x.num_rows, 1000)):
            out: list[tuple] = []
            ids, texts = b.column(0).to_pylist(), [(x or "").rstrip() for x in b.column(1).to_pylist()]
            tokens = [TOKEN.findall(x.lower()) for x in texts]
            ends = np.cumsum([len(t) for t in tokens])
            h = np.fromiter((HASHES[x] for t in tokens for x in t), np.uint64, int(ends[-1]) if len(ends) else 0)
            w = mixed(h, STRETCH)  # of all texts at once; those that run over an end count for none
            hit = passes(w, bits)
            for i, x, t, end in zip(ids, texts, tokens, ends.tolist()):
                start, n = end - len(t), len(t) - STRETCH + 1
                if n < 1:
                    continue
                own = [start + k for k in own_places(t)]
                found = hit[start : start + n]
                if not own and not found.any():
                    continue
                found = start + np.flatnonzero(found)
                if sig := signature(t, h[start:end]):
                    out.append((i, hash_of(x) - 2**63, sig, len(x), w[own].view(np.int64).tolist() or None, np.unique(w[found[~np.isin(found, own)]]).view(np.int64).tolist()))
            cols = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "hash", "sig", "size", "tails", "windows"])

    sigs = cut_table(rows.mapInArrow(sign, "id string, hash long, sig array<int>, size int, tails array<long>, windows array<long>"))

    closing, inside = (sigs.select(F.explode(c).alias("key")).distinct() for c in ("tails", "windows"))
    both = cut_table(closing.join(inside, "key", "left_semi"))
    both_bits = spark.sparkContext.broadcast(key_filter(both))

    def keyed(bits):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    hashes, sizes, keys = [], [], []
                    for h, n, sig, w in zip(*(b.slice(at, 1000).column(k).to_pylist() for k in range(4))):
                        w = np.array(w, np.int64).view(np.uint64)
                        w = w[passes(w, both_bits.value)]
                        if not len(w):
                            continue
                        k = joint_keys(w, np.array(sig, np.int64), bands)
                        k = k if bits is None else k[passes(k, bits.value)]
                        hashes.append(np.full(len(k), h, np.int64)), sizes.append(np.full(len(k), n, np.int32)), keys.append(k.view(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else [], t) for x, t in ((hashes, pa.int64()), (sizes, pa.int32()), (keys, pa.int64()))], names=["hash", "size", "key"])

        return run

    short = cut_table(sigs.filter("tails is not null").select("hash", "size", "sig", "tails").mapInArrow(keyed(None), "hash long, size int, key long"))
    joint_bits = spark.sparkContext.broadcast(key_filter(short))
    long = sigs.filter("size(windows) > 0").select("hash", "size", "sig", "windows").mapInArrow(keyed(joint_bits), "hash long, size int, key long")
    long = long.select(F.col("hash").alias("leader"), F.col("size").alias("leader_size"), "key").distinct()
    pairs = cut_table(short.distinct().join(long, "key").filter("hash <> leader and size <= leader_size").select("hash", "leader").distinct())
    # a cut copy is shorter, so its shingles can all lie in the longer text: the estimate may fall a little below the limit
    least = similarity - 0.1
    same = F.aggregate(F.zip_with("sig", "leader_sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda x, y: x + y) / 80.0
    # written tables: their sizes are known, so the few pairs are sent to the signatures and not the other way round
    named = pairs.select("hash").union(pairs.select("leader")).distinct()
    own = cut_table(sigs.select("hash", "sig").join(named, "hash", "left_semi").dropDuplicates(["hash"]))
    found = cut_table(pairs.join(own, "hash").join(own.select(F.col("hash").alias("leader"), F.col("sig").alias("leader_sig")), "leader").filter(same >= least).select("hash", "leader"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([hash_of((x or "").rstrip()) - 2**63 for x in b.column(1).to_pylist()], pa.int64()), b.column(1)], names=["hash", "text"])

    early = F.udf(ends_early, "boolean", useArrow=True)
    named = found.select("hash").union(found.select("leader")).distinct()
    ids = sigs.select("id", "hash").join(named, "hash", "left_semi").groupBy("hash").agg(F.min("id").alias("id"))
    t = cut_table(rows.join(ids.select("id").distinct(), "id", "left_semi").mapInArrow(hashed, "hash long, text string").dropDuplicates(["hash"]))
    early_ = found.join(t, "hash").join(t.select(F.col("hash").alias("leader"), F.col("text").alias("longer")), "leader").filter(early("text", "longer")).select("hash").distinct()
    return sigs.select("id", "hash").join(early_, "hash", "left_semi").select("id").distinct()


OPEN_END = re.compile(r"""[.!?。！？…][”"'’)\]*_`]*$""")
#: Stands for a line break while texts are sorted: the last of all characters, so that what goes on in the line comes first.
LAST = "\U0010ffff"


def continued(text: str, following: str, least: int = 5) -> bool:
    """Whether the next text in the order goes on from inside a word or sentence of this one. Fewer than `least` words are no sign of a copy; such a text is judged by its own ending."""
    if not (len(following) > len(text) and following.startswith(text)) or following[len(text)] == LAST or OPEN_END.search(text):
        return False
    return len(WORD.findall(text)) + len(HAN.findall(text)) >= least


#: Characters in a range of the sort, the most ranges, texts sampled a range, and the characters sampled in all.
RANGE, RANGES, RANGE_SAMPLE, SAMPLE = 8 * 2**20, 4096, 20, 16 * 2**20


def bounds_of(texts: list[str], ranges: int) -> list[str]:
    """At most ranges - 1 ascending bounds that part the texts evenly; each is the shortest beginning of a text that lies above the text before."""
    s, out = sorted(set(texts)), []
    for k in range(1, ranges):
        at = k * len(s) // ranges
        if at and (not out or s[at - 1] >= out[-1]):
            n = next(i for i, c in enumerate(s[at]) if s[at - 1][i : i + 1] != c)
            out.append(s[at][: n + 1])
    return out


def range_bounds(rows: DataFrame) -> list[str]:
    """Bounds of the ranges that the texts are sorted in. rows: h long, n int, text.

    Spark's own range partitioning sends the driver 300 whole texts a partition; here the sample, chosen by the hashes, has
    some SAMPLE characters in all, whatever the number of texts and ranges. Any bounds give the same result, only the sizes differ.
    """
    count, size = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = min(-(-size // RANGE), RANGES)
    if ranges < 2:
        return []
    share = min(1.0, RANGE_SAMPLE * ranges / count, SAMPLE / size)
    return bounds_of([r.text for r in rows.filter(F.pmod("h", F.lit(2**31)) < int(share * 2**31)).select("text").distinct().collect()], ranges)


def range_of(text: Column, bounds: list[str]) -> Column:
    """The number of bounds at or below the text: those of a list of every width-th first, then of the stretch behind."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    stretches = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    below = lambda a: F.size(F.filter(a, lambda b: b <= text))
    strings = lambda x: F.lit(x) if x else F.array().cast("array<string>")
    over = below(strings([x[0] for x in stretches[1:]]))
    return over * width + below(F.element_at(F.array(*map(strings, stretches)), over + 1))


def shortened(rows: DataFrame) -> DataFrame:
    """id of texts that another text continues inside a word or sentence. rows: id string, text.

    Equal texts are one row first; then the texts are sorted over the cluster in ranges (range_bounds), line breaks last. All
    continuations of a text follow it directly, those that go on in its line first, so each is held against its next neighbour only. A task
    gives the texts it finds and the first and last text of its partition; the last is held against the first of the next
    partition that has any.
    """
    names = ["part", "what", "h", "n", "text"]
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        last: tuple | None = None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*(b.column(k).to_pylist() for k in range(3))):
                if last is None:
                    out.append((part, "first", *row))
                elif continued(last[2], row[2]):
                    out.append((part, "found", *last[:2], None))
                last = row
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, "last", *last), kinds)], names=names)

    bare = F.rtrim(F.col("text"))
    keyed = [F.xxhash64(bare).alias("h"), F.length(bare).alias("n")]
    sorted_ = rows.filter("text is not null").select(*keyed, F.translate(bare, "\n", LAST).alias("text"))
    bounds = range_bounds(sorted_)
    seen = cut(sorted_.distinct().repartitionById(len(bounds) + 1, range_of(F.col("text"), bounds)).sortWithinPartitions("text").mapInArrow(run, "part int, what string, h long, n int, text string"))
    of = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    ends = seen.filter("what <> 'found'").groupBy("part").agg(of("first", "text").alias("first"), of("last", "text").alias("text"), of("last", "h").alias("h"), of("last", "n").alias("n"))
    border = ends.withColumn("following", F.lead("first").over(Window.orderBy("part"))).filter("following is not null")
    found = seen.filter("what = 'found'").select("h", "n").unionByName(border.filter(F.udf(continued, "boolean", useArrow=True)("text", "following")).select("h", "n"))
    return rows.select("id", *keyed).join(found, ["h", "n"], "left_semi").select("id")


def find_truncated(rows: DataFrame, copies: bool = True, stock: float = 0.01) -> DataFrame:
    """id, how, cut for every row with a text that has something in it.

    rows: id string, text; other columns are ignored; rows of one id that aren't equal are judged apart. how: 'copy' where a longer near-copy shows the cut, else
    the kind of ending. Null and blank texts give no row; repeated texts are judged alike; an empty table gives none.
    """
    rows = rows.select("id", "text").filter(F.length(F.regexp_replace("text", r"^\s+", "")) > 0)
    ends, counts = scanned(rows)
    out = judged(cut_table(ends.drop("tails").dropDuplicates(["id", "hash"])), counts, stock)  # read several times
    if not copies:
        return out.select("id", F.col("kind").alias("how"), "cut")
    shown = near_copies(rows, ends).unionByName(shortened(rows)).distinct().withColumn("shown", F.lit(True))
    return out.join(shown, "id", "left").select("id", F.when(F.col("shown"), "copy").otherwise(F.col("kind")).alias("how"), (F.col("cut") | F.coalesce("shown", F.lit(False))).alias("cut"))


def generation_texts(generations: DataFrame) -> DataFrame:
    """id, source, text of the rows; gen_id repeats in exact repeats of a row only, which the verdicts drop."""
    return generations.select(F.col("gen_id").cast("string").alias("id"), "source", F.col("content").alias("text"))


def truncation_rates(generations: DataFrame) -> DataFrame:
    """source, n_texts, n_cut, cut_share: how often each source truncates; a null source is a group of its own."""
    rows = generation_texts(generations)
    cuts = find_truncated(rows).select("id", "cut")
    return rows.select("id", "source").dropDuplicates(["id"]).join(cuts, "id").groupBy("source").agg(F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.avg(F.col("cut").cast("double")).alias("cut_share"))
