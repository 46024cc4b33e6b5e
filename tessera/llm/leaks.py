"""Evaluation texts leaking into training text: rare n-gram seeds joined to test items, Smith-Waterman alignment of the hits.

The test items are the query set. They are read in blocks bounded in bytes, so what is broadcast never grows, and n-grams
are rare or not among all items, whatever the blocks. One block is one scan of the corpus without a shuffle; for several,
the normalised words are written once and each block reads those.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .normal import words

SCHEMA = "doc_id long, item_id long, score int, span int, matched int, item_start int, doc_start int"
MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


@dataclass
class Index:
    """Encoded test items of one block and the places of their rare n-grams."""

    ids: list[int]
    codes: list[np.ndarray]
    vocab: dict[str, int]
    keys: np.ndarray
    first: np.ndarray
    item: np.ndarray
    at: np.ndarray
    n: int


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of every n successive words; key 0 where a word is unknown."""
    if len(codes) < n:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.int64).astype(np.uint64)
    out = np.zeros(len(codes) - n + 1, np.uint64)
    bad = np.zeros(len(out), bool)
    for k in range(n):
        part = c[k : k + len(out)]
        out += (part + np.uint64(1)) * MULT[k]
        bad |= codes[k : k + len(out)] < 0
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out |= np.uint64(1)
    out[bad] = 0
    return out


def gram_hash(words_: list[str]) -> int:
    """The name of an n-gram across blocks."""
    import xxhash

    return xxhash.xxh64_intdigest(" ".join(words_)) - 2**63


def build_index(items: list[tuple[int, str]], n: int = 4, common: frozenset[int] = frozenset()) -> Index:
    """items: id and text without stock lines. Every n-gram whose hash is not among the common ones is a seed."""
    vocab: dict[str, int] = {}
    told = [words(t) for _, t in items]
    codes = [np.array([vocab.setdefault(w, len(vocab)) for w in t], np.int32) for t in told]
    key = [grams(c, n) for c in codes]
    rare = [np.array([gram_hash(t[k : k + n]) not in common for k in range(len(g))], bool) for t, g in zip(told, key)] if common else [np.ones(len(g), bool) for g in key]
    item = np.repeat(np.arange(len(items)), [len(k) for k in key]) if items else np.zeros(0, int)
    at = np.concatenate([np.arange(len(k)) for k in key]) if items else np.zeros(0, int)
    flat = np.concatenate(key) if items else np.zeros(0, np.uint64)
    keep = np.concatenate(rare) if items else np.zeros(0, bool)
    flat, item, at = flat[keep], item[keep], at[keep]
    order = np.argsort(flat, kind="stable")
    keys, first = np.unique(flat[order], return_index=True)
    return Index([i for i, _ in items], codes, vocab, keys, np.append(first, len(flat)), item[order].astype(np.int32), at[order].astype(np.int32), n)


def align(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman of each pair at once: score, first and last aligned word of a, first of b, matches.

    A match counts 1, a change or gap -1; of several best ends the first counts, so an alignment never runs past its last match.
    """
    p, la, lb = len(a), max(map(len, a)), max(map(len, b))
    x, y = np.full((p, la), -2, np.int32), np.full((p, lb), -3, np.int32)
    for k in range(p):
        x[k, : len(a[k])], y[k, : len(b[k])] = a[k], b[k]
    h = np.zeros((p, lb + 1), np.int32)
    si, sj, m = np.zeros_like(h), np.zeros_like(h), np.zeros_like(h)
    best = np.zeros((p, 5), np.int32)
    rows = np.arange(p)
    cols = np.arange(lb, dtype=np.int32)[None, :]
    for i in range(la):
        eq = y == x[:, i : i + 1]
        d, dsi, dsj, dm = h[:, :-1] + np.where(eq, 1, -1), si[:, :-1], sj[:, :-1], m[:, :-1] + eq
        new = h[:, :-1] == 0
        dsi, dsj, dm = np.where(new, i, dsi), np.where(new, cols, dsj), np.where(new, eq, dm)
        up = h[:, 1:] - 1
        use = up > d
        g, gsi, gsj, gm = np.where(use, up, d), np.where(use, si[:, 1:], dsi), np.where(use, sj[:, 1:], dsj), np.where(use, m[:, 1:], dm)
        # words put in: the best of all places before, less one a word, is a running maximum of g + column
        risen = g + cols
        top = np.maximum.accumulate(risen, 1)
        fresh = np.ones_like(use)
        fresh[:, 1:] = risen[:, 1:] > top[:, :-1]
        of = np.maximum.accumulate(np.where(fresh, cols, 0), 1)
        g, gsi, gsj, gm = np.maximum(top - cols, 0), np.take_along_axis(gsi, of, 1), np.take_along_axis(gsj, of, 1), np.take_along_axis(gm, of, 1)
        h[:, 1:], si[:, 1:], sj[:, 1:], m[:, 1:] = g, gsi, gsj, gm
        j = h.argmax(1)
        v = h[rows, j]
        better = v > best[:, 0]
        best[better] = np.stack([v, si[rows, j], np.full(p, i), sj[rows, j], m[rows, j]], 1)[better]
    return best


def steps(a: list[int], b: list[int]) -> list[tuple[int, int, bool]]:
    """The best local alignment of two texts, as of align(), step by step: word of a, word of b, whether they are equal; in a gap the side that stands still repeats its word."""
    above, ways, best, end = [0] * (len(b) + 1), [], 0, (0, 0)
    for i, x in enumerate(a):
        row, way = [0] * (len(b) + 1), bytearray(len(b) + 1)
        for j, y in enumerate(b):
            v, w = above[j] + (1 if x == y else -1), 1
            if above[j + 1] - 1 > v:
                v, w = above[j + 1] - 1, 2
            if row[j] - 1 > v:
                v, w = row[j] - 1, 3
            if v > 0:
                row[j + 1], way[j + 1] = v, w
                if v > best:
                    best, end = v, (i, j + 1)
        above = row
        ways.append(way)
    i, j = end
    out = []
    while i >= 0 and j > 0 and (w := ways[i][j]):
        out.append((i, j - 1, w == 1 and a[i] == b[j - 1]))
        i, j = i - (w != 3), j - (w != 2)
    return out[::-1]


def stretch(a: np.ndarray, b: np.ndarray, least: int, identity: float) -> tuple[int, int, int, int, int] | None:
    """The best stretch of at least `least` words of a that b holds with `identity` of them equal and only single words changed: score, span, matches, first word of a and of b.

    For pairs whose alignment as a whole has too many changes: a changed block parts it, and what lies beside it is looked at in turn.
    """
    x, y = a.tolist(), b.tolist()
    while len(path := steps(x, y)) >= least and sum(e for *_, e in path) >= identity * least:
        found = None
        same = [k for k, (*_, e) in enumerate(path) if e]
        runs = np.split(same, np.flatnonzero(np.diff(same) > 2) + 1)
        for run in (r.tolist() for r in runs if len(r) >= identity * least):
            for n, k in enumerate(run):
                for m in range(len(run) - 1, n, -1):
                    span, matched = path[run[m]][0] - path[k][0] + 1, m - n + 1
                    if span < least or found and matched <= found[2]:
                        break
                    if matched >= identity * span:
                        found = (2 * matched - (run[m] - k + 1), span, matched, path[k][0], path[k][1])
                        break
        if found:
            return found
        for i, *_ in path:
            x[i] = -2
    return None


def candidates(code: np.ndarray, doc: np.ndarray, index: Index, seeds: int, width: int) -> np.ndarray:
    """Rows (doc, item, diagonal) where at least `seeds` seeds of an item lie near one diagonal. code: all words of a batch, doc: their documents."""
    key = grams(code, index.n)
    if not len(key) or not len(index.keys):
        return np.zeros((0, 3), np.int64)
    key[doc[: len(key)] != doc[index.n - 1 :]] = 0
    at = np.flatnonzero(key)
    k = np.searchsorted(index.keys, key[at])
    k[k == len(index.keys)] = 0
    hit = index.keys[k] == key[at]
    at, k = at[hit], k[hit]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    n = index.first[k + 1] - index.first[k]
    where = np.repeat(index.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pos = np.repeat(at, n)
    item, diag = index.item[where].astype(np.int64), pos - index.at[where] + 4096
    out = []
    for shift in (0, width // 2):  # overlapping bands, so no run of hits is parted
        band = (diag + shift) // width
        kind = np.stack([doc[pos].astype(np.int64), item, band], 1)
        u, inv, c = np.unique(kind, axis=0, return_inverse=True, return_counts=True)
        inv = inv.ravel()
        mean = np.bincount(inv, diag) / c
        sel = c >= seeds
        out.append(np.stack([u[sel, 0], u[sel, 1], np.rint(mean[sel]).astype(np.int64) - 4096, c[sel]], 1))
    both = np.concatenate(out)
    if not len(both):
        return np.zeros((0, 3), np.int64)
    both = both[np.lexsort((-both[:, 3], both[:, 2] // width, both[:, 1], both[:, 0]))]
    same = np.zeros(len(both), bool)
    same[1:] = (both[1:, 0] == both[:-1, 0]) & (both[1:, 1] == both[:-1, 1]) & (np.abs(both[1:, 2] - both[:-1, 2]) < width // 2)
    return both[~same][:, :3]


def search(index: Index, seeds: int, width: int, least: int, identity: float, pairs: int = 256, part_rows: int = 1000, split: Callable[[str | None], list[str]] = words):
    """The worker: Arrow batches of (doc_id, text) to Arrow batches of alignments; split gives the words of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = index.vocab.get
        for batch in (b.slice(k, part_rows) for b in batches for k in range(0, b.num_rows, part_rows)):
            ids = batch.column(0).to_pylist()
            toks = [split(t) for t in batch.column(1).to_pylist()]
            lens = np.array([len(t) for t in toks], np.int64)
            code = np.fromiter((get(w, -1) for t in toks for w in t), np.int32, int(lens.sum()))
            start = np.concatenate([[0], np.cumsum(lens)])
            found = candidates(code, np.repeat(np.arange(len(ids)), lens), index, seeds, width)
            rows: dict[tuple[int, int], tuple] = {}
            for k in range(0, len(found), pairs):
                part = found[k : k + pairs]
                a = [index.codes[i] for _, i, _ in part]
                lo = [max(start[d], g - width) for d, _, g in part]
                b = [code[s : max(s, min(start[d + 1], g + len(x) + width))] for (d, _, g), s, x in zip(part, lo, a)]
                for (d, i, _), s, x, y, (score, i0, i1, j0, m) in zip(part, lo, a, b, align(a, b).tolist()):
                    span = i1 - i0 + 1
                    if span >= least and m < identity * span and score >= (2 * identity - 1) * least and (d, i) not in rows:
                        score, span, m, i0, j0 = stretch(x, y, least, identity) or (0, 0, 0, 0, 0)
                    if span >= least and m >= identity * span and score > rows.get((d, i), (0,))[0]:
                        rows[d, i] = (score, span, m, i0, int(s - start[d] + j0))
            best: dict[tuple[int, int], tuple] = {}  # an item_id with two texts is one item
            for (d, i), r in rows.items():
                if r[0] > best.get((d, index.ids[i]), (0,))[0]:
                    best[d, index.ids[i]] = r
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[d] for d, _ in keys], pa.int64()), pa.array([i for _, i in keys], pa.int64()), *(pa.array([best[x][c] for x in keys], pa.int32()) for c in range(5))],
                names=["doc_id", "item_id", "score", "span", "matched", "item_start", "doc_start"],
            )

    return run


def stock_free(items: DataFrame) -> DataFrame:
    """item_id and text, without a first line that other items share."""
    line = F.lower(F.trim(F.substring_index("text", "\n", 1)))
    shared = items.filter(F.instr("text", "\n") > 0).groupBy(line.alias("_line")).count().filter("count > 1").select("_line", F.lit(True).alias("_stock"))
    cut = F.expr("substring(text, instr(text, '\n') + 1)")
    return items.select("item_id", "text", line.alias("_line")).join(shared, "_line", "left").select("item_id", F.when(F.col("_stock"), cut).otherwise(F.col("text")).alias("text"))


def common_grams(clean: DataFrame, n: int, rare: float, total: int) -> frozenset[int]:
    """Hashes of the n-grams that more than max(2, rare x total) of all items have; at most the items' mean length / rare of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [(i, {gram_hash(w[k : k + n]) for k in range(len(w) - n + 1)}) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in (words(t),)]
            yield pa.RecordBatch.from_arrays([pa.array([g for _, s in own for g in s], pa.int64()), pa.array([i for i, s in own for _ in s], pa.int64())], names=["gram", "item_id"])

    seen = clean.select("item_id", "text").mapInArrow(run, "gram long, item_id long").distinct().groupBy("gram").agg(F.count("*").alias("n"))
    return frozenset(r.gram for r in seen.filter(F.col("n") > max(2, rare * total)).select("gram").toLocalIterator())


def item_blocks(clean: DataFrame, most_chars: int, buckets: int = 4096) -> list[tuple[int, int]]:
    """Ranges of hash buckets of item ids whose texts have at most `most_chars` characters together (a single bucket may have more); at least one."""
    sums = clean.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(buckets)).alias("bucket")).agg(F.sum(F.length("text")).alias("n"))
    out, lo, full = [], 0, 0
    for r in sums.orderBy("bucket").collect():
        if full and full + r.n > most_chars:
            out.append((lo, r.bucket))
            lo, full = r.bucket, 0
        full += r.n
    return [*out, (lo, buckets)]


def find_leaks(documents: DataFrame, items: DataFrame, least: int = 30, identity: float = 0.82, seeds: int = 6, width: int = 24, rare: float = 0.01, block_chars: int = 8_000_000) -> DataFrame:
    """Documents that hold at least `least` successive words of a test item, one row per document and item.

    Words are compared as read, not as typed (case, accents, lookalike letters, markup, line-end hyphens, unseen
    characters); scattered changes of single words are passed over as long as `identity` of the aligned words agree, in the
    alignment as a whole or in a stretch of it that no changed block parts.
    documents: doc_id, text; items: item_id, text; further columns are ignored. Null or empty texts give no row; items
    of fewer than `least` words can't leak; two texts under one item_id are both searched for and name that item; repeated
    rows of a document give one row each. A seed is an n-gram that at most max(2, `rare` x items) of all items have.
    Output: doc_id, item_id, score, span (item words covered), matched, item_start, doc_start (word positions).
    """
    n = 4
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).distinct()
    clean = cut(stock_free(items))
    common = common_grams(clean, n, rare, clean.select("item_id").distinct().count())
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = item_blocks(clean, block_chars)
    split = words
    if len(blocks) > 1:
        docs, split = cut(docs.mapInArrow(told, "doc_id long, text string")), str.split
    out = None
    for lo, hi in blocks:
        rows = clean.filter(F.pmod(F.xxhash64("item_id"), F.lit(4096)).between(lo, hi - 1)).orderBy("item_id", "text").collect()
        index = documents.sparkSession.sparkContext.broadcast(build_index([(r.item_id, r.text) for r in rows], n, common))
        part = docs.mapInArrow(lambda batches, index=index: search(index.value, seeds, width, least, identity, split=split)(batches), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as their normalised words with a space between."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([" ".join(words(t)) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])
