"""Cleaning and chunking of whole documents: header stripping, paragraph chunks, screenplays. Folds over one document run in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from ..functions.text import FRONT_MATTER, HEADING_LINE, clean_paragraphs

# Line starts before the text, after the text, and around legal notes.
START_MARKERS = (
    "*END*THE SMALL PRINT", "*** START OF THE PROJECT GUTENBERG", "*** START OF THIS PROJECT GUTENBERG", "This etext was prepared by", "E-text prepared by",
    "Produced by", "Distributed Proofreading Team", "Proofreading Team at http://www.pgdp.net", "http://gallica.bnf.fr)", "      http://archive.org/details/",
    "http://www.pgdp.net", "by The Internet Archive)", "by The Internet Archive/Canadian Libraries", "by The Internet Archive/American Libraries",
    "public domain material from the Internet Archive", "Internet Archive)", "Internet Archive/Canadian Libraries", "Internet Archive/American Libraries",
    "material from the Google Print project", "*END THE SMALL PRINT", "***START OF THE PROJECT GUTENBERG", "This etext was produced by",
    "*** START OF THE COPYRIGHTED", "The Project Gutenberg", "http://gutenberg.spiegel.de/ erreichbar.", "Project Runeberg publishes",
    "Beginning of this Project Gutenberg", "Project Gutenberg Online Distributed", "Gutenberg Online Distributed", "the Project Gutenberg Online Distributed",
    "Project Gutenberg TEI", "This eBook was prepared by", "http://gutenberg2000.de erreichbar.", "This Etext was prepared by",
    "This Project Gutenberg Etext was prepared by", "Gutenberg Distributed Proofreaders", "Project Gutenberg Distributed Proofreaders",
    "the Project Gutenberg Online Distributed Proofreading Team", "**The Project Gutenberg", "*SMALL PRINT!",
    "More information about this book is at the top of this file.", "tells you about restrictions in how the file may be used.",
    "l'authorization à les utilizer pour preparer ce texte.", "of the etext through OCR.", "*****These eBooks Were Prepared By Thousands of Volunteers!*****",
    "We need your donations more than ever!", " *** START OF THIS PROJECT GUTENBERG", "****     SMALL PRINT!", '["Small Print" V.',
    "      (http://www.ibiblio.org/gutenberg/", "and the Project Gutenberg Online Distributed Proofreading Team",
    "Mary Meehan, and the Project Gutenberg Online Distributed Proofreading", "                this Project Gutenberg edition.",
)
END_MARKERS = (
    "*** END OF THE PROJECT GUTENBERG", "*** END OF THIS PROJECT GUTENBERG", "***END OF THE PROJECT GUTENBERG", "End of the Project Gutenberg",
    "End of The Project Gutenberg", "Ende dieses Project Gutenberg", "by Project Gutenberg", "End of Project Gutenberg", "End of this Project Gutenberg",
    "        ***END OF THE PROJECT GUTENBERG", "*** END OF THE COPYRIGHTED", "End of this is COPYRIGHTED", "Ende dieses Etextes ", "Ende dieses Project Gutenber",
    "Ende diese Project Gutenberg", "**This is a COPYRIGHTED Project Gutenberg Etext, Details Above**", "Fin de Project Gutenberg",
    "The Project Gutenberg Etext of ", "Ce document fut presente en lecture", "Ce document fut présenté en lecture",
    "More information about this book is at the top of this file.", "We need your donations more than ever!", "END OF PROJECT GUTENBERG",
    " End of the Project Gutenberg", " *** END OF THIS PROJECT GUTENBERG",
)
NOTICE_START = ("<<THIS ELECTRONIC VERSION OF",)
NOTICE_END = ("SERVICE THAT CHARGES FOR DOWNLOAD",)

Counter = Callable[[str], int]
ROUGH = re.compile(r"\w+|[^\w\s]")


def rough_count(text: str) -> int:
    """Words and single punctuation marks; any tokenizer's count may stand in its place."""
    return len(ROUGH.findall(text))


def strip_headers(text: str, starts: tuple[str, ...] = START_MARKERS, ends: tuple[str, ...] = END_MARKERS, head: int = 600, least: int = 100) -> str:
    """The text between the last start marker and the first end marker, without legal notices.

    Lines are counted as they are kept, also those that a later start marker throws away; start markers count up to
    `head` kept lines, end markers from `least` on.
    """
    kept: list[str] = []
    seen = 0
    notice = False
    for line in text.splitlines():
        if seen <= head and line.startswith(starts):
            kept.clear()
        elif seen >= least and line.startswith(ends):
            break
        elif line.startswith(NOTICE_START):
            notice = True
        elif line.startswith(NOTICE_END):
            notice = False
        elif not notice:
            kept.append(line)
            seen += 1
    return "\n".join(kept)


def paragraph_chunks(paragraphs: list[str], least: int = 1500, count: Counter = rough_count) -> list[list[str]]:
    """Successive paragraphs until `least` tokens are reached. The paragraph that meets a full chunk closes it and belongs to none; a last chunk that isn't full is dropped."""
    chunks: list[list[str]] = []
    now: list[str] = []
    size = 0
    for p in paragraphs:
        if p == "[deleted]":
            continue
        if now and size >= least:
            chunks.append(now)
            now, size = [], 0
        else:
            now.append(p)
            size += count(p)
    return chunks + ([now] if now and size >= least else [])


def truncated(text: str | None, most: int = 1536, spans: Callable[[str], list[tuple[int, int]]] | None = None) -> tuple[str | None, int]:
    """A text of at most `most` tokens and the number of tokens of the whole one. What is cut off takes the paragraph it parts with it; a text of one paragraph that is cut leaves nothing. spans: start and end of each token; words and punctuation marks without it."""
    if text is None:
        return None, 0
    at = spans(text) if spans else [m.span() for m in ROUGH.finditer(text)]
    return (text if len(at) <= most else "\n\n".join(text[: at[most - 1][1]].split("\n\n")[:-1])), len(at)


@dataclass(frozen=True)
class ContinuationSizes:
    summary_tokens: int = 1024
    prefix_tokens: int = 512
    paragraph_words: int = 15
    prefix_words: int = 30
    summary_words: int = 100


HEADING_RX = re.compile(HEADING_LINE, re.M)
FRONT_RX = re.compile("^(?:" + "|".join(FRONT_MATTER) + r")\s*$", re.I)


def narrative(p: str, least: int) -> bool:
    s = p.strip()
    n = len(s.split())
    heading = (len(s) < 100 and HEADING_RX.match(s)) or (len(s) < 80 and s.isupper() and n <= 6)
    return n >= least and not heading and not (len(s) < 50 and FRONT_RX.match(s))


def take(sizes: list[int], at: int, most: int) -> int:
    """The end of the longest run from `at` within `most` tokens; one paragraph at least."""
    total, k = 0, at
    while k < len(sizes) and (total == 0 or total + sizes[k] <= most):
        total += sizes[k]
        k += 1
    return k


def continuations(paragraphs: list[str], sizes: ContinuationSizes = ContinuationSizes(), count: Counter = rough_count) -> list[tuple[str, str, str]]:
    """(prefix, passage, next passage) of successive narrative paragraphs; the next search begins after the next passage."""
    own = [p for p in paragraphs if narrative(p, sizes.paragraph_words)]
    if len(own) < 2:
        return []
    tokens = [count(p + "\n\n") for p in own]
    out, at = [], 0
    while at < len(own):
        mid = take(tokens, at, sizes.summary_tokens)
        head = take(tokens[:mid], at, sizes.prefix_tokens)
        end = take(tokens, mid, sizes.summary_tokens)
        prefix, passage, following = ("\n\n".join(own[a:b]) for a, b in ((at, head), (at, mid), (mid, end)))
        if following and len(prefix.split()) >= sizes.prefix_words and len(passage.split()) >= sizes.summary_words:
            out.append((prefix, passage, following))
        at = end
    return out


# --- screenplays ---------------------------------------------------------------------------------------------------

SCENE_HEADING = re.compile(r"(?:INT\.|EXT\.).+")
TRANSITION = re.compile(r"(?:FADE|DISSOLVE|CUT).+")
SCENE = "struct<heading:string,line_number:int,elements:array<struct<type:string,content:string,line_number:int,character:string,parenthetical:string>>>"


def kind_of(line: str) -> str:
    if not line:
        return "blank"
    if SCENE_HEADING.match(line):
        return "heading"
    if TRANSITION.match(line):
        return "transition"
    return "character" if line.isupper() and not line.startswith("(") else "action"


def parse_screenplay(text: str | None) -> list[dict]:
    """Scenes with their elements. A dialogue runs from a character's line to a blank line, another character or a heading; successive lines of one kind without a gap are one element."""
    lines = [x.strip() for x in (text or "").split("\n")]
    kinds = [kind_of(x) for x in lines]
    scenes: list[dict] = []
    at = 0
    while at < len(lines):
        kind, line = kinds[at], lines[at]
        if kind == "heading":
            scenes.append({"heading": line, "line_number": at, "elements": []})
        elif scenes and kind == "character":
            end = at + 1
            while end < len(lines) and kinds[end] not in ("blank", "character", "heading"):
                end += 1
            asides = [x for x in lines[at + 1 : end] if x.startswith("(") and x.endswith(")")]
            said = [x for x in lines[at + 1 : end] if not (x.startswith("(") and x.endswith(")"))]
            scenes[-1]["elements"].append({"type": "dialogue", "content": " ".join(said), "line_number": at, "character": line, "parenthetical": asides[-1] if asides else None, "_n": 0})
            at = end
            continue
        elif scenes and kind != "blank":
            own = scenes[-1]["elements"]
            if own and own[-1]["type"] == kind and own[-1]["line_number"] + own[-1]["_n"] == at:
                own[-1]["content"] += " " + line
                own[-1]["_n"] += 1
            else:
                own.append({"type": kind, "content": line, "line_number": at, "character": None, "parenthetical": None, "_n": 1})
        at += 1
    for s in scenes:
        for e in s["elements"]:
            del e["_n"]
    return scenes


def dialogue_text(elements: Column) -> Column:
    """'NAME: line' for each dialogue of a scene's elements, the parenthetical on a line before."""
    own = F.filter(elements, lambda e: e["type"] == "dialogue")
    return F.array_join(F.transform(own, lambda e: F.concat(e["character"], F.lit(": "), F.when(e["parenthetical"].isNotNull(), F.concat(e["parenthetical"], F.lit("\n"))).otherwise(""), F.coalesce(e["content"], F.lit("")))), "\n")


def screenplay_passes(scenes: Column, least_scenes: int = 20, least_characters: int = 20) -> Column:
    """Enough scenes and enough different speakers."""
    speakers = F.array_distinct(F.flatten(F.transform(scenes, lambda s: F.transform(F.filter(s["elements"], lambda e: e["type"] == "dialogue"), lambda e: e["character"]))))
    return (F.size(scenes) >= least_scenes) & (F.size(speakers) >= least_characters)


# --- over tables ---------------------------------------------------------------------------------------------------


def per_row(df: DataFrame, key: str, column: str, of: Callable, name: str, kind: str) -> DataFrame:
    """df's key and of(column), in Arrow batches; a null gives of(null)."""
    schema = f"{key} {df.schema[key].dataType.simpleString()}, {name} {kind}"
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(x) for x in b.column(1).to_pylist()], made)], names=[key, name])

    made = to_arrow_type(_parse_datatype_string(kind))
    return df.select(key, column).mapInArrow(run, schema)


def strip_all(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    return per_row(df, key, column, lambda t: None if t is None else strip_headers(t), "text", "string")


def latest_books(books: DataFrame) -> DataFrame:
    """The most recently fetched row with a text of each book; among equally late ones the choice is fixed by their content. Spark keeps one row a key and task before the shuffle."""
    order = Window.partitionBy("id").orderBy(F.col("fetched_at").desc_nulls_last(), F.xxhash64("text", "title", "author"))
    return books.filter("text is not null").select("id", "text", "title", "author", "fetched_at").withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "fetched_at")


def book_chunks(df: DataFrame, key: str, least: int = 1500, most: int = 10_000, separator: str = "\n\n", count: Counter = rough_count) -> DataFrame:
    """key, chunk_no, text, tokens of the chunks of cleaned paragraphs, those of `most` tokens and more left out."""
    cleaned = strip_all(df, key).select(key, clean_paragraphs(F.col("text"), separator).alias("p"))
    made = per_row(cleaned, key, "p", partial(paragraph_chunks_of, least=least, count=count), "chunks", "array<struct<text:string,tokens:int>>")
    return made.select(key, F.posexplode("chunks").alias("chunk_no", "c")).select(key, "chunk_no", "c.text", "c.tokens").filter(F.col("tokens") < most)


def paragraph_chunks_of(paragraphs: list[str] | None, least: int, count: Counter) -> list[dict]:
    return [{"text": "\n\n".join(c), "tokens": count(" ".join(c))} for c in paragraph_chunks([p for p in paragraphs or [] if p is not None], least, count)]


def continuation_rows(df: DataFrame, key: str, sizes: ContinuationSizes = ContinuationSizes(), separator: str = "\n\n", count: Counter = rough_count) -> DataFrame:
    """key, part_no, prefix, passage, following."""
    of = lambda t: [dict(zip(("prefix", "passage", "following"), x)) for x in continuations((t or "").split(separator), sizes, count)]
    made = per_row(df, key, "text", of, "parts", "array<struct<prefix:string,passage:string,following:string>>")
    return made.select(key, F.posexplode("parts").alias("part_no", "p")).select(key, "part_no", "p.*")


def truncate_all(df: DataFrame, key: str, column: str = "text", most: int = 1536) -> DataFrame:
    """key, text, encoded_length."""
    made = per_row(df, key, column, lambda t: dict(zip(("text", "encoded_length"), truncated(t, most))), "t", "struct<text:string,encoded_length:int>")
    return made.select(key, "t.text", "t.encoded_length")


def parse_screenplays(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    """key, scenes."""
    return per_row(df, key, column, parse_screenplay, "scenes", f"array<{SCENE}>")
