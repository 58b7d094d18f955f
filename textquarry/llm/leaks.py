"""Evaluation texts leaking into training text: Wu-Manber search for runs of words."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = 20
BLOCK = 3
#: Characters of test items whose tables are sent to the executors at a time.
ITEMS_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    low = text.lower()
    if len(low) != len(text):  # some letter's lower case has marks, which would cut a word
        return [w.lower() for w in _WORD.findall(text)]
    return _WORD.findall(low)


class Searcher:
    """Finds which items share ``run`` consecutive words with a text.

    Every run of an item is a pattern. The shift table says, for a block of
    words ending at a place, how far the search window can move on at least
    before it can hold a pattern; unknown blocks move it by ``run - block + 1``.
    Blocks with shift 0 have a bucket of item places that end with them, which
    are compared word by word.
    """

    def __init__(self, items: list[tuple[int, str]], run: int = RUN, block: int = BLOCK):
        self.run, self.block = run, block
        self.items = [(i, w) for i, w in ((i, words(t)) for i, t in items) if len(w) >= run]
        self.shift: dict[tuple[str, ...], int] = {}
        self.bucket: dict[tuple[str, ...], list[tuple[int, int]]] = defaultdict(list)
        for k, (_, w) in enumerate(self.items):
            for end in range(block, len(w) + 1):
                key = tuple(w[end - block : end])
                self.shift[key] = min(self.shift.get(key, run), max(0, run - end))
                if end >= run:
                    self.bucket[key].append((k, end))

    def find(self, text: str) -> set[int]:
        """Ids of the items of which ``text`` holds a run."""
        found: set[int] = set()
        if not self.items:
            return found
        d = words(text)
        run, block, shift, n = self.run, self.block, self.shift, len(d)
        skip = run - block + 1
        at = run
        while at <= n:
            key = tuple(d[at - block : at])
            step = shift.get(key, skip)
            if step:
                at += step
                continue
            for k, end in self.bucket[key]:
                i, w = self.items[k]
                if i not in found and w[end - run : end] == d[at - run : at]:
                    found.add(i)
            at += 1
        return found


def leaked_items(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``(doc_id, item_id)``: documents that hold ``run`` or more consecutive words of an item.

    Null texts and ids, and items below ``run`` words, match nothing. Equal
    items are all reported; repeated rows give one row. Documents are scanned
    once, whole, where they are; nothing but hits is shuffled. Items are taken
    in blocks of at most ``ITEMS_CHARS`` characters (by hash of their id; a
    longer single item makes a longer block), so what is sent to the executors
    doesn't grow with their number; each block is one more scan.
    """
    items = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // ITEMS_CHARS) or 1
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    out: DataFrame | None = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        searcher = Searcher([(r[0], r[1]) for r in own.collect()], run)
        tables = documents.sparkSession.sparkContext.broadcast(searcher)

        def scan(batches, tables=tables):
            find = tables.value.find
            for batch in batches:
                docs, hits = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    for i in find(text.as_py()):
                        docs.append(doc_id)
                        hits.append(i)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(hits, pa.int64())], names=["doc_id", "item_id"])

        found = texts.mapInArrow(scan, "doc_id long, item_id long")
        out = found if out is None else out.unionByName(found)
    return out.distinct()
