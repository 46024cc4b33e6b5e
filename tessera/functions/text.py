"""Text predicates, counts and cleaning as column expressions; nothing here leaves the JVM but the two Unicode folds."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: letters, digits and underscores of any script; the same class in Java, RE2 and Python.
WORD = r"[\p{L}\p{N}_]+"

# What a chapter heading or a line of front matter looks like.
DIVISIONS = ("CHAPTER", "PART", "BOOK", "ACT", "SCENE")
FRONT_MATTER = (
    r"By\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", "Contents:?", r"Table\s+of\s+Contents", "Introduction", "Preface", "Foreword", "Dedication", "Acknowledgements?",
    "Copyright", r"Published\s+by", r"First\s+published", r"All\s+rights\s+reserved", "ISBN", r"Illustrated\s+by", r"Edited\s+by", r"Translated\s+by",
)
#: Matched from the beginning of a paragraph to the end of any of its lines.
HEADING_LINE = "(?:" + "|".join(rf"{d}\s+[IVXLCDM0-9]+\.?|{d.title()}\s+[IVXLCDMivxlcdm0-9]+\.?" for d in DIVISIONS) + r"|[IVXLCDM]+\.|[0-9]+\.)\s*$"
HEADING = r"(?md)\A" + HEADING_LINE
METADATA = "(?i)^(?:" + "|".join(FRONT_MATTER) + r")\s*$"
EMAIL = r"[A-Za-z0-9_.-]+@[A-Za-z0-9_.-]+\.[A-Za-z0-9_]+"
IMAGE = r"\.png|\.jpg|\.jpeg|\.gif|picture:"
COPIES = r"[0-9]* copies|copyright"
FORMATTED = r"^\s*[*_>=+-]+"


def stripped(c: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """Stretches between white space; none of an empty text."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def count_words(c: Column) -> Column:
    return F.size(tokens(c))


def rough_tokens(c: Column) -> Column:
    """A count of words and single punctuation marks, the stand-in for a tokenizer."""
    return F.regexp_count(c, F.lit(rf"{WORD}|[^\s\p{{L}}\p{{N}}_]"))


def ngrams(toks: Column, n: int) -> Column:
    """Every n successive tokens, joined by spaces; none if there are fewer."""
    m = F.greatest(F.size(toks) - (n - 1), F.lit(0))
    out = F.slice(toks, 1, m)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(toks, k + 1, m), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def occurrences(c: Column, what: str) -> Column:
    """How often a string occurs, without overlap."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / F.lit(len(what))).cast("int")


def is_upper(c: Column) -> Column:
    """At least one cased letter and none in lower case."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def is_chapter_heading(p: Column) -> Column:
    s = stripped(p)
    return ((F.length(s) < 100) & s.rlike(HEADING)) | ((F.length(s) < 80) & is_upper(s) & (count_words(s) <= 6))


def is_metadata(p: Column) -> Column:
    s = stripped(p)
    return (F.length(s) < 50) & s.rlike(METADATA)


def is_narrative(p: Column, min_words: int = 15) -> Column:
    """Enough words, and neither front matter nor a heading."""
    return (count_words(p) >= min_words) & ~is_metadata(p) & ~is_chapter_heading(p)


def is_title_or_other(p: Column, min_length: int = 5, s: Column | None = None) -> Column:
    """Titles, credits and other lines that are no running text. s: the stripped paragraph, where it is at hand."""
    s = stripped(p) if s is None else s
    low = F.lower(s)
    n = F.length(s)
    quoted = (occurrences(s, '"') == 2) | (occurrences(s, "'") == 2) | s.endswith(":")
    loud = F.regexp_count(s, F.lit(r"[\p{Lu}\p{Nd}!#$%&'()*+,./:;<=>?@\[\\\]^_`{|}~-]"))
    colons = occurrences(s, ":")
    return (
        (n == 0)
        | ((n < min_length) & ~quoted)
        | (loud / F.greatest(F.length(F.replace(s, F.lit(" "), F.lit(""))), F.lit(1)) > 0.6)
        | low.startswith("appendix")
        | s.rlike("^[%_<>*]")
        | ((colons > 3) & (2 * colons - occurrences(s, '"') > 3))
        | (s.contains("@") & (n < 100))
        | (low.contains("printed in") & (n < 200))
        | low.contains("inc.")
        | (low.contains("original title") & (n < 200))
    )


def is_table(p: Column, s: Column | None = None) -> Column:
    s = stripped(p) if s is None else s
    wide = lambda c: (occurrences(c, "   ") > 3) | (occurrences(c, "\t") > 2)
    joined = F.array_join(F.transform(F.split(s, "\n"), stripped), " ")
    return (wide(s) & wide(joined)) | (occurrences(s, "*") > 3) | (occurrences(s, "=") > 2)


def is_image(p: Column) -> Column:
    return F.lower(p).rlike(IMAGE)


def is_footnote(p: Column, s: Column | None = None) -> Column:
    s = stripped(p) if s is None else s
    return (F.lower(s).contains("footnote") & (F.length(F.replace(s, F.lit(" "), F.lit(""))) < 50)) | s.rlike(r"^\{.+\}|^\[.+\]")


def is_copies_note(p: Column) -> Column:
    return p.rlike(COPIES) & (F.length(F.replace(p, F.lit(" "), F.lit(""))) < 500)


def is_email(p: Column) -> Column:
    """An address; the sign is looked for first, as the pattern is slow on texts without it."""
    return p.contains("@") & p.rlike(EMAIL)


def starts_formatted(p: Column) -> Column:
    return p.rlike(FORMATTED)


def is_boilerplate(p: Column, min_length: int = 5, s: Column | None = None) -> Column:
    """Any of the paragraph kinds that cleaning drops; the cheap and frequent ones are tested first."""
    s = stripped(p) if s is None else s
    return starts_formatted(p) | is_title_or_other(p, min_length, s) | is_table(p, s) | is_footnote(p, s) | is_image(p) | is_copies_note(p) | is_email(p)


def clean_paragraphs(text: Column, separator: str = "\n\n", min_length: int = 5) -> Column:
    """The paragraphs of a text that are running text."""
    both = F.transform(F.split(text, separator), lambda p: F.struct(p.alias("p"), stripped(p).alias("s")))  # stripped once for all tests
    return F.transform(F.filter(both, lambda x: ~is_boilerplate(x["p"], min_length, x["s"])), lambda x: x["p"])


def clean_message(c: Column, most: int | None = None) -> Column:
    """One line of a message: ends stripped, end marks and runs of line breaks or tabs deleted, cut to `most` characters and '...'."""
    s = F.coalesce(F.when(c.isin("True", "False"), F.lower(c)).otherwise(c), F.lit(""))
    s = F.regexp_replace(F.replace(stripped(s), F.lit("<|endoftext|>"), F.lit("")), r"\n+|\t+", "")
    return s if most is None else F.when(F.length(s) > most, F.concat(F.substring(s, 1, most), F.lit("..."))).otherwise(s)


def clean_example(c: Column) -> Column:
    """Without a numbered scenario with its call, and without fenced blocks."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)1\. Scenario:.*?Example API Call:", ""), r"(?s)```.*?```", "")


def without_last_paragraph(c: Column) -> Column:
    p = F.split(c, "\n\n")
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), "\n\n")).otherwise(F.lit(""))


@F.pandas_udf(T.StringType())
def unaccented(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Letters without their marks."""
    for s in batches:
        yield s.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def compatible(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition (NFKC)."""
    for s in batches:
        yield s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def corpus_line(c: Column) -> Column:
    """Lower case, unaccented, runs of blanks as one, line breaks as the two characters backslash n."""
    s = F.regexp_replace(F.lower(unaccented(c)), r"[ \t]+", " ")
    return stripped(F.replace(s, F.lit("\n"), F.lit("\\n")))


def ascii_normal(c: Column) -> Column:
    """Plain quotes, no accents, lower case, single spaces, ASCII only."""
    s = F.translate(c, "‘’‚“”„", "'''\"\"\"")
    s = F.lower(unaccented(compatible(s)))
    return stripped(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), r"[^\x00-\x7F]", ""))


def slug(c: Column, most: int = 20) -> Column:
    return F.left(F.regexp_replace(F.replace(F.lower(c), F.lit(" "), F.lit("_")), "[^a-z0-9_]", ""), F.lit(most))


def snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))


def short_hash(c: Column, digits: int = 8) -> Column:
    return F.left(F.sha2(c, 256), F.lit(digits))


def has_han(c: Column) -> Column:
    return c.rlike("[一-鿿]+")
