"""Evaluation texts leaking into training text: Wu-Manber multi-pattern search over words."""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words of an item that make a leak; shorter items must occur whole.
PASSAGE = 10
#: Characters of test items searched for in one pass over the corpus; bounds what is broadcast.
BLOCK_CHARS = 16_000_000
_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after compatibility normalization, without case and accents."""
    if not text:
        return []
    if text.isascii():
        return _ASCII.findall(text.lower())
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).casefold())
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)))


class _Patterns:
    """Wu-Manber tables for patterns of one length: words are the symbols, a block is two of them (one, if need be)."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.shift: dict[tuple[int, ...], int] = {}
        self.buckets: dict[tuple[int, ...], dict[tuple[int, ...], list]] = defaultdict(lambda: defaultdict(list))
        for p, items in patterns.items():
            for end in range(self.block, length + 1):
                b = p[end - self.block : end]
                self.shift[b] = min(self.shift.get(b, length), length - end)
            self.buckets[p[-self.block :]][p[: self.block]].append((p, items))
        self.far = length - self.block + 1

    def search(self, text: list[int], found: set[int]) -> None:
        at, n, length, block = self.length, len(text), self.length, self.block
        shift, far = self.shift, self.far
        while at <= n:
            b = tuple(text[at - block : at])
            step = shift.get(b, far)
            if step:
                at += step
                continue
            begin = at - length
            for p, items in self.buckets[b].get(tuple(text[begin : begin + block]), ()):
                if tuple(text[begin:at]) == p:
                    found.update(items)
            at += 1


class LeakSearch:
    """Finds which items' passages occur in a text. Items are (id, text)."""

    def __init__(self, items: list[tuple[int, str | None]], passage: int = PASSAGE):
        self.ids: dict[str, int] = {}
        by_length: dict[int, dict[tuple[int, ...], dict[int, None]]] = defaultdict(lambda: defaultdict(dict))
        for item, text in items:
            symbols = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            length = min(passage, len(symbols))
            for i in range(len(symbols) - length + 1 if length else 0):
                by_length[length][tuple(symbols[i : i + length])][item] = None
        self.tables = [_Patterns(n, {x: list(items) for x, items in p.items()}) for n, p in sorted(by_length.items())]

    def find(self, text: str | None) -> set[int]:
        found: set[int] = set()
        symbols = [self.ids.get(w, 0) for w in words(text)]
        for t in self.tables:
            t.search(symbols, found)
        return found


_built: dict[str, LeakSearch] = {}


def _search_of(name: str, items: list[tuple[int, str | None]], passage: int) -> LeakSearch:
    """The tables of a block of items, built once in a Python worker and kept until another block comes."""
    if name not in _built:
        _built.clear()
        _built[name] = LeakSearch(items, passage)
    return _built[name]


def leaks(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, block_chars: int = BLOCK_CHARS, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold ``passage`` consecutive words of an item, or all words of a shorter one: doc_id, item_id.

    Distinct pairs. Items without words leak nowhere, null or empty documents hold nothing; repeated rows change
    nothing, extra columns are not read. Whole texts are searched.

    The items are searched for in blocks of at most ``block_chars`` characters, one pass over the corpus each; a block goes
    to every worker, which builds its tables once, the corpus is never shuffled. Block shift tables skip places where no passage can end, buckets by the
    last and first block select passages, and comparison word by word confirms them.
    """
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    spark, parts = docs.sparkSession, []
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks)) == k) if blocks > 1 else items
        rows = [(r[0], r[1]) for r in mine.select(item_id, item_text).distinct().collect()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches, shared=shared, name=uuid.uuid4().hex):
            search = _search_of(name, shared.value, passage)
            for batch in batches:
                hits = [(d, i) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i in search.find(t)]
                yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], pa.int64()) for k in (0, 1)], names=["doc_id", "item_id"])

        parts.append(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
