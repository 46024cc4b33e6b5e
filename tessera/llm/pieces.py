"""Oversized texts cut into pieces at natural boundaries: sections, paragraphs, lines, sentences, words, characters.

A piece is packed greedily with whole parts of the highest level of which at least one still fits; only where none does
is the next lower level used. Every piece but the first begins with the stated number of characters of the one before.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"(?:(?:chapter|part|book|section|act|scene|volume|canto|prologue|epilogue|kapitel|chapitre|cap[ií]tulo|capitolo|hoofdstuk|глава|часть|第.{1,6}[章节回部])\b[^\n]{0,80}|[IVXLC]{1,8}\.[^\n]{0,80}|\d{1,3}\.[^\n]{0,80}|[^\na-zß-ÿ]{2,60}[A-ZÀ-Þ]{2}[^\na-zß-ÿ]{0,60})"
#: Where a part of each level ends, the highest level first; a match's end is a boundary.
LEVELS = (
    re.compile(rf"(?:\r?\n[ \t]*)+(?:\r?\n)(?=[ \t]*{HEADING}[ \t]*(?:\r?\n|$))|\f", re.I),
    re.compile(r"\r?\n[ \t]*(?:\r?\n[ \t]*)+| "),
    re.compile(r"\r?\n"),
    re.compile(r"""[.!?…]+[”"'’»)\]*_]*\s+|[。！？；][”」』’）]*\s*|[؟।॥]\s*"""),
    re.compile(r"[,;:—–]\s+|[，、：]"),
    re.compile(r"\s+|[​­]"),
)
OUT = "record_id long, piece_no int, n_pieces int, start int, end int, overlap int, n_chars int, parts array<string>"


def boundaries(text: str) -> list[list[int]]:
    return [[m.end() for m in rx.finditer(text)] for rx in LEVELS]


def whole_character(text: str, at: int, least: int) -> int:
    """The last place up to `at` that parts no character from its marks and joiners, if there is one beyond least."""
    k = at
    while k > least and k < len(text) and (unicodedata.combining(text[k]) or text[k] in "‍️" or text[k - 1] == "‍"):
        k -= 1
    return k if k > least else at


def cuts(text: str, most: int, overlap: int, extra: list[int] | None = None) -> list[tuple[int, int]]:
    """start and end of the new text of each piece (without the overlap). extra: boundaries above all levels, of a text put together of elements.

    The first piece has at least `overlap` characters, as every later one has with what it repeats, so that each can be repeated that far.
    """
    if len(text) <= most:
        return [(0, len(text))]
    if not 0 <= overlap < most:
        raise ValueError("the overlap must be smaller than the limit")
    levels = ([extra] if extra else []) + boundaries(text)
    out, at = [], 0
    while at < len(text):
        room = at + most - (overlap if out else 0)
        if room >= len(text):
            out.append((at, len(text)))
            break
        to = at
        for ends in levels:
            k = bisect_right(ends, room) - 1
            if k >= 0 and ends[k] > at and (out or ends[k] >= overlap):
                to = ends[k]
                break
        else:
            to = whole_character(text, room, at)
        out.append((at, to))
        at = to
    return out


def split_records(rows: DataFrame, most: int, overlap: int) -> DataFrame:
    """record_id, piece_no, n_pieces, start, end, overlap, n_chars, parts of every record that has any text.

    rows: record_id, elements (array of strings, one for a plain text); start and end count characters of all elements
    together and tell the new text of the piece; parts are the piece's stretches of the elements, overlap included.
    A record within the limit is one piece. Null elements count as empty; records without a character give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for rid, elements in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts = [e for e in elements or () if e]
                if not texts:
                    continue
                text = texts[0] if len(texts) == 1 else "".join(texts)
                ends = list(accumulate(map(len, texts)))
                found = cuts(text, most, overlap, ends if len(texts) > 1 else None)
                for k, (start, end) in enumerate(found):
                    again = min(overlap, start) if k else 0
                    lo, parts, e = start - again, [], bisect_right(ends, start - again)
                    while lo < end:
                        hi = min(end, ends[e])
                        parts.append(text[lo:hi])
                        lo, e = hi, e + 1
                    rows.append((rid, k, len(found), start, end, again, end - start + again, parts))
            kinds = (pa.int64(), *[pa.int32()] * 6, pa.list_(pa.string()))
            cols = list(zip(*rows)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["record_id", "piece_no", "n_pieces", "start", "end", "overlap", "n_chars", "parts"])

    return rows.select(F.col("record_id").cast("long").alias("record_id"), "elements").mapInArrow(run, OUT)


def latest(rows: DataFrame, key: str, at: str, text: str) -> DataFrame:
    """The row of each key with the latest `at`; among equals one with a text, the choice fixed by the text. Spark keeps one row a key and task before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.col(at).desc_nulls_last(), F.col(text).isNull(), F.xxhash64(text))
    return rows.select(key, at, text).withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def split_books_and_scenes(books: DataFrame, scenes: DataFrame, size_limits: DataFrame) -> DataFrame:
    """record_kind, record_id and the pieces of each book's latest fetched text and of each scene's elements.

    Elements are put in the order of their line numbers, those without one last, equal ones as stored. size_limits:
    applies_to ('books', 'scenes'), max_size, overlap; a few rows.
    """
    limit = {r.applies_to: (r.max_size, r.overlap) for r in size_limits.select("applies_to", "max_size", "overlap").collect()}
    b = latest(books, "id", "fetched_at", "text").select(F.col("id").alias("record_id"), F.array("text").alias("elements"))
    both = F.arrays_zip(F.col("elements.line_number").alias("line"), F.col("elements.content").alias("content"))  # only these fields are read
    narrow = scenes.select("scene_id", "created_at", F.transform(both, lambda e, i: F.struct(F.coalesce(e["line"], F.lit(2**31 - 1)).alias("line"), i.alias("i"), e["content"].alias("content"))).alias("lines"))
    s = latest(narrow, "scene_id", "created_at", "lines").select(F.col("scene_id").alias("record_id"), F.transform(F.array_sort("lines"), lambda e: e["content"]).alias("elements"))
    parts = [split_records(df, *limit[name]).select(F.lit(kind).alias("record_kind"), "*") for kind, name, df in (("book", "books", b), ("scene", "scenes", s))]
    return parts[0].unionByName(parts[1])
