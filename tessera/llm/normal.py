"""Text normalisation shared by the matching operators: words as a reader sees them, whatever the typing."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x",
    "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ɡ": "g", "ı": "i",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
LOOKS = str.maketrans(LOOKALIKES)
UNSEEN = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁪-⁯︀-️﻿]")
#: A tag of any length where its attributes are well-formed, one of up to 300 characters otherwise ("a <b" with a ">" far behind is no tag).
TAG = re.compile(r"""</?[A-Za-z](?:[^<>]{0,300}|[\w:-]*(?:\s+[\w:@.-]+(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>]+))?)*\s*/?)>""")
SPLIT_WORD = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>*|#]*(?=[^\W\d_])")
MIXED = re.compile(r"[^\W\d_]+")
WORD = re.compile(r"[^\W_]+")
LATIN = re.compile(r"[a-z]")
FOREIGN = re.compile(r"[Ͱ-ϿЀ-ԯɡı]")


def plain(text: str) -> str:
    """Lower-case text without tags, entities, unseen characters, accents, line-end hyphens and lookalike letters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub("", text)
    if text.isascii():
        return SPLIT_WORD.sub("", text).lower() if "-" in text else text.lower()
    text = UNSEEN.sub("", unicodedata.normalize("NFKC", text))
    text = SPLIT_WORD.sub("", text).lower()
    text = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not 0x300 <= ord(c) <= 0x36F)) if not text.isascii() else text
    if FOREIGN.search(text):
        text = MIXED.sub(lambda m: w.translate(LOOKS) if FOREIGN.search(w := m[0]) and LATIN.search(w) else w, text)
    return text


def words(text: str | None) -> list[str]:
    """The words of a text in reading order, normalised; null gives none."""
    return WORD.findall(plain(text)) if text else []
