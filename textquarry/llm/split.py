"""Splitting oversized items at natural boundaries."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, LEAST, OVERLAP = 2000, 1000, 150
#: From the best place to cut to the worst.
MARKS = ("\n\n", "\n", " ")


def boundaries(text: str, mark: str) -> list[int]:
    """Sorted offsets right behind each occurrence of ``mark``, overlapping ones too."""
    out, at = [], text.find(mark)
    while at >= 0:
        out.append(at + len(mark))
        at = text.find(mark, at + 1)
    return out


def pieces(text: str, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP, offsets=None, marks=MARKS):
    """Half-open character spans of the pieces of ``text``.

    ``offsets[i]`` is the size of the first ``i`` characters (a prefix sum; by
    default ``i``), in whatever unit ``limit``, ``least`` and ``overlap`` are.
    A piece from s ends at the last boundary e of the best mark that has any
    with ``least < size(s, e) <= limit``, else at the last character that fits
    (at least one). The next piece starts ``overlap`` before e, and the last
    piece takes the rest if it fits. ``overlap`` must be below ``least``.
    """
    if not 0 <= overlap < least <= limit:
        raise ValueError("overlap must be below least, and least not above limit")
    size = range(len(text) + 1) if offsets is None else offsets
    places = [boundaries(text, m) for m in marks]
    out, s, n = [], 0, len(text)
    while size[n] - size[s] > limit:
        last = max(bisect_right(size, size[s] + limit) - 1, s + 1)
        first = bisect_right(size, size[s] + least)
        e = last
        for place in places:
            k = bisect_right(place, last)
            if k and place[k - 1] >= first:
                e = place[k - 1]
                break
        out.append((s, e))
        s = max(bisect_right(size, size[e] - overlap) - 1, s + 1)
    if s < n or not out:
        out.append((s, n))
    return out


def split_oversized(items: DataFrame, limit: int = LIMIT, least: int = LEAST, overlap: int = OVERLAP) -> DataFrame:
    """``(chunk_ord, first_character_index, last_character_index)`` of the pieces of every chunk over ``limit``.

    Offsets are file offsets, from ``first_character_index`` of the chunk; sizes
    are code points. Chunks within the limit, null and empty texts give no rows;
    a null ``first_character_index`` gives pieces with null offsets removed, so
    none. Exact duplicates count once. Only oversized texts leave the JVM; a
    chunk is never moved, and only spans are compared to remove duplicates.
    """
    big = items.where((F.length("text") > limit) & F.col("first_character_index").isNotNull())

    def run(batches):
        for b in batches:
            ords, starts, ends = [], [], []
            for o, f, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                for s, e in pieces(t.as_py(), limit, least, overlap):
                    ords.append(o)
                    starts.append(f + s)
                    ends.append(f + e)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ords, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["chunk_ord", "first_character_index", "last_character_index"],
            )

    out = big.select("chunk_ord", "first_character_index", "text").mapInArrow(
        run, "chunk_ord long, first_character_index long, last_character_index long"
    )
    return out.distinct()
