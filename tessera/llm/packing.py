"""Filling fixed-capacity containers with texts: bounded-space online best-fit.

Each partition keeps a fixed number of open containers, found through a bitset keyed by free space. A text goes into the
fullest container that still takes it; if none does, a new one is opened, and beyond the bound the fullest one closes
first. One scan, no shuffle; the waste is at most the open containers of each partition.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits text into the stretches that byte-pair merges stay within.
STRETCH = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = "doc_id long, piece_no int, container_id string, n_tokens int, start int, end int"


@lru_cache(maxsize=2)
def encoder(ranks: bytes):
    """The tokenizer of a rank file's content; built once in each worker."""
    import tiktoken

    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("public", pat_str=STRETCH, mergeable_ranks=known, special_tokens={})


def count_tokens(enc, text: str) -> int:
    """Tokens of a whole text, however long, encoded at once."""
    return len(enc.encode_ordinary(text))


def divided(enc, text: str, capacity: int) -> list[tuple[int, int, int]]:
    """start, end, tokens of the pieces of a text that alone exceeds the capacity: each as long as fits, cut before white space where there is some."""
    out, at = [], 0
    while at < len(text):
        lo, hi = at + 1, min(len(text), at + 8 * capacity)
        while count_tokens(enc, text[at:hi]) <= capacity and hi < len(text):
            hi = min(len(text), at + 2 * (hi - at))
        while lo < hi:  # the longest prefix within the capacity
            mid = (lo + hi + 1) // 2
            if count_tokens(enc, text[at:mid]) <= capacity:
                lo = mid
            else:
                hi = mid - 1
        to = lo
        if to < len(text):
            back = [m.start() for m in re.finditer(r"\s", text[at + (to - at) // 2 : to])]
            if back:
                to = at + (to - at) // 2 + back[-1]
                to = lo if to <= at else to
        out.append((at, to, count_tokens(enc, text[at:to])))
        at = to
    return out


class OpenContainers:
    """At most `most` open containers, keyed by free space in a bitset (an int whose bit f tells that one has f free)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.n, self.bits, self.made = capacity, most, 0, 0, 0
        self.by: dict[int, list[int]] = {}

    def put(self, size: int) -> int:
        """The number of the container that takes a text of this size."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            if self.n >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            own, free = self.made, self.capacity
            self.made += 1
        if free > size:
            self.by.setdefault(free - size, []).append(own)
            self.bits |= 1 << (free - size)
            self.n += 1
        return own

    def _take(self, free: int) -> int:
        here = self.by[free]
        own = here.pop()
        if not here:
            del self.by[free]
            self.bits ^= 1 << free
        self.n -= 1
        return own


def pack(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, most: int = 512, look_ahead: int = 1000) -> DataFrame:
    """doc_id, piece_no, container_id, n_tokens, start, end (characters) of every document.

    No document is divided unless it alone exceeds the capacity; then each of its pieces is as long as fits and the
    pieces are placed like documents. documents: doc_id, text; other columns are ignored. Null and empty texts have no
    tokens and still get a container, one that is open or a new one. Of every `look_ahead` pieces the larger are placed
    first, which leaves the small ones for the gaps; look_ahead=1 is the plain online method. Repeated rows are placed one
    by one. Container ids name the partition and the container in it: equal input partitions give equal ids at every size.
    """
    if capacity < 1:
        raise ValueError("a container must take at least one token")

    # the rank file (under 2 MB) is read on the driver only, so no worker needs it on its disk
    ranks = documents.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(ranks.value)
        context = TaskContext.get()
        part = f"{context.partitionId():06d}" if context else uuid.uuid4().hex[:6]
        bins = OpenContainers(capacity, most)
        for b in batches:
            sized = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                n = count_tokens(enc, text)
                pieces = [(0, len(text), n)] if n <= capacity else divided(enc, text, capacity)
                sized.extend((doc, k, size, s, e) for k, (s, e, size) in enumerate(pieces))
            rows = []
            for k in range(0, len(sized), look_ahead):
                for doc, no, size, s, e in sorted(sized[k : k + look_ahead], key=lambda x: -x[2]):
                    rows.append((doc, no, f"{part}-{bins.put(size):08d}", size, s, e))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "piece_no", "container_id", "n_tokens", "start", "end"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def capacity_of(size_limits: DataFrame, applies_to: str = "documents") -> int:
    """The size limit that the table of limits (a few rows) states."""
    row = size_limits.filter(F.col("applies_to") == applies_to).select("max_size").first()
    if row is None:
        raise ValueError(f"no size limit for {applies_to}")
    return row.max_size


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """n_containers, n_pieces, n_tokens, share of the capacity used, fewest containers possible; one row."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("pieces"))
    total = F.sum("used")
    return per.agg(F.count("*").alias("n_containers"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("n_pieces"), F.coalesce(total, F.lit(0)).alias("n_tokens"), (total / (F.count("*") * F.lit(capacity))).alias("filled"), F.ceil(total / F.lit(capacity)).alias("least_containers"))
