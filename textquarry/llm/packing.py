"""Filling fixed-capacity containers with texts: bulk-synchronous best fit over range-sorted items and gaps."""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import Counter, defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

CAPACITY = 4096
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's tokenizer cuts a text before it merges bytes (fixed by the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items and gaps that one task sweeps over; items left over that one task packs at the end.
SWEEP_ROWS, REST_ROWS = 50_000, 100_000
#: Rounds end when one places less than this share of the items it had.
LEAST_PLACED = 0.2

_encoders: dict[int, object] = {}


def encoder(vocabulary: bytes):
    """Byte-pair encoder of a vocabulary file's lines ``base64 rank``; one for each Python worker."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _encoders:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of whole texts; null texts count 0. The vocabulary file is read on the driver (about 1 MB)."""
    with open(vocabulary, "rb") as f:
        held = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = encoder(held.value).encode_ordinary
        for batch in batches:
            counts = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")


def sweep(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit matching of items to gaps, ``(matches, containers)``.

    ``counts``: how many items of each size there are. Items and gaps are
    sorted sequences, kept as runs: ``(size, count)`` and ``(gap, first
    container, count)``. A superstep takes all items of one size, from the
    largest to the smallest, and sweeps over the gaps from its successor, the
    least gap that holds it: each container on the way is filled as far as that
    size goes, items and containers being matched by rank, and its new gap is
    put back in order. What finds no gap opens containers. The result is that
    of best fit on the sizes in descending order.

    A match ``(size, rank, count, per, first)`` sends the items of that size
    with ranks from ``rank`` on, ``count`` of them, into containers from
    ``first`` on, ``per`` each. State and matches depend on the capacity and
    the number of distinct sizes, not on the number of items.
    """
    matches: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []
    runs: dict[int, deque[tuple[int, int]]] = defaultdict(deque)
    opened = 0

    def put(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((first, count))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                first, count = runs[gap].popleft()
                if not runs[gap]:
                    gaps.pop(at)
            else:
                gap, first, count = capacity, opened, -(-left // (capacity // size))
                opened += count
            per = gap // size
            full = min(count, left // per)
            if full:
                matches.append((size, rank, full * per, per, first))
                put(gap - per * size, first, full)
                rank, left, first, count = rank + full * per, left - full * per, first + full, count - full
            if count and left:  # fewer than fill one container
                matches.append((size, rank, left, left, first))
                put(gap - left * size, first, 1)
                left, first, count = 0, first + 1, count - 1
            put(gap, first, count)
    return matches, opened


def successors(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places ``(item, gap)`` of the pairs that a sweep over a sorted stretch makes, and of the gaps and items left over, in order.

    ``kind`` is 0 for an item and 1 for a gap; sizes ascend, an item coming
    before a gap of its size. Each gap takes the largest item before it that no
    gap between them has taken, as a closing bracket takes an opening one.
    """
    depth = np.cumsum(np.where(kind == 0, 1, -1))
    level = np.where(kind == 0, depth, depth + 1)
    order = np.lexsort((np.arange(len(kind)), level))
    k, lev = kind[order], level[order]
    at = np.flatnonzero((k[:-1] == 0) & (k[1:] == 1) & (lev[:-1] == lev[1:])) if len(k) else np.zeros(0, np.int64)
    item, gap = order[at], order[at + 1]
    left = np.ones(len(kind), bool)
    left[item] = left[gap] = False
    return item, gap, np.flatnonzero(left & (kind == 1)), np.flatnonzero(left & (kind == 0))


def segments(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Matches between stretches, ``(gap part, first gap, item part, first item, count, first number)``.

    ``left``: gaps and items left over of each part of a sorted sequence. Gaps
    count from the smallest, items from the largest; what is left over is
    matched as within a part, by rank. No more than two rows for each part.
    """
    out, stack, number = [], [], 0
    for part in sorted(left):
        gaps, items = left[part]
        first = 0
        while gaps and stack:
            top = stack[-1]
            n = min(gaps, top[2])
            out.append((part, first, top[0], top[1], n, number))
            first, gaps, number = first + n, gaps - n, number + n
            top[1], top[2] = top[1] + n, top[2] - n
            if not top[2]:
                stack.pop()
        if items:
            stack.append([part, 0, items])
    return out


_ITEM = "size long, doc_id long, piece int, token_start long"
_SWEPT = f"{_ITEM}, container long, gap long, state int, part int, rank long"
PLACED, GAP_LEFT, ITEM_LEFT = range(3)


def _swept(events: DataFrame, parts: int) -> DataFrame:
    """Items and gaps range-sorted, each range swept in a task: placed items, and what is left over with its range and rank."""
    ordered = events.repartitionByRange(parts, "v", "kind", "tie").sortWithinPartitions("v", "kind", "tie")

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        v, kind = t["v"].to_numpy(), t["kind"].to_numpy()
        item, gap, gaps, items = successors(kind)
        take = np.concatenate([item, gaps, items])
        n = len(item), len(gaps), len(items)
        box = t["container"].take(pa.array(np.concatenate([gap, gaps, items])))
        rest = np.concatenate([v[gap] - v[item], v[gaps], np.zeros(n[2], np.int64)])
        rank = np.concatenate([np.zeros(n[0], np.int64), np.arange(n[1]), np.arange(n[2])[::-1]])
        part = np.full(sum(n), TaskContext.get().partitionId(), np.int32)
        own = t.select(["v", "doc_id", "piece", "token_start"]).take(pa.array(take))
        cols = [*(c.combine_chunks() for c in own.columns), box.combine_chunks(), pa.array(rest), pa.array(np.repeat([PLACED, GAP_LEFT, ITEM_LEFT], n).astype(np.int32)), pa.array(part), pa.array(rank)]
        yield pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[c.split()[0] for c in _SWEPT.split(", ")])

    return ordered.mapInArrow(run, _SWEPT)


def _rest(items: DataFrame, n: int, capacity: int, opened: int, ws: Workspace) -> tuple[DataFrame, int]:
    """The last items in new containers, by best fit within tasks; the number of containers then open."""
    groups = max(1, -(-n // REST_ROWS))

    def run(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_numpy()
        matches, _ = sweep(Counter(sizes.tolist()), capacity)
        rank = np.empty(len(sizes), np.int64)
        order = np.argsort(sizes, kind="stable")
        starts = np.searchsorted(sizes[order], sizes[order])
        rank[order] = np.arange(len(sizes)) - starts
        box = np.zeros(len(sizes), np.int64)
        for size, first_rank, count, per, first in matches:
            own = (sizes == size) & (rank >= first_rank) & (rank < first_rank + count)
            box[own] = first + (rank[own] - first_rank) // per
        return table.append_column("container", pa.array(box))

    group = F.pmod(F.xxhash64("doc_id", "token_start", "size"), F.lit(groups)).cast("int").alias("group")
    packed = ws.cut(items.select("*", group).groupBy("group").applyInArrow(run, f"{_ITEM}, group int, container long"), "rest")
    used = packed.groupBy("group").agg((F.max("container") + 1).alias("n"))  # a row for each group
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    used = used.select("group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n")
    total = opened + (used.agg(F.sum("n")).first()[0] or 0)
    placed = packed.join(F.broadcast(used), "group").withColumn("container", F.col("container") + F.col("base") + opened)
    return placed.select("size", "doc_id", "piece", "token_start", "container"), total


def pack(documents: DataFrame, ws: Workspace, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(container_id, doc_id, piece, token_start, n_tokens)``: every text put into one container.

    A text above ``capacity`` tokens is cut into pieces of exactly ``capacity``
    and a rest, which is an item like any other; no other text is split. Empty
    and null texts take no room and are spread over the containers. Rows with
    equal ``doc_id`` are items of their own; null ids are kept.

    As many containers are opened as all tokens need at least. In each round,
    items and gaps are sorted together by ranges; every range is swept in a task,
    where each gap takes the largest item that fits and is left (see
    ``successors``); gaps and items left over of different ranges are matched by
    rank (``segments``); gaps shrink, and the next round begins. A gap takes one
    item in a round, so rounds are about as many as texts in a container. What
    is left when rounds place few items is packed into new containers, by best
    fit within tasks. The driver sees a few numbers for each range.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    spark = documents.sparkSession
    cap = F.lit(capacity).cast("long")
    sized = ws.cut(token_counts(documents, vocabulary), "sized")
    piece = F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_tokens") - 1, F.lit(0)), cap)).alias("piece", "token_start")
    every = sized.select("doc_id", "n_tokens", piece)
    every = every.select(F.least(F.col("n_tokens") - F.col("token_start"), cap).alias("size"), "doc_id", "piece", "token_start")
    items = every.where("size > 0")
    n, tokens = items.agg(F.count(F.lit(1)), F.sum("size")).first()
    opened = -(-(tokens or 0) // capacity)
    gaps = spark.range(opened).select(F.col("id").alias("container"), cap.alias("gap"))
    n_gaps, done, names = opened, [], [c.split()[0] for c in _ITEM.split(", ")]
    step = 0
    while n:
        events = items.select(F.col("size").alias("v"), F.lit(0).alias("kind"), F.xxhash64("doc_id", "token_start").alias("tie"), *names[1:], F.lit(None).cast("long").alias("container"))
        events = events.unionByName(gaps.select(F.col("gap").alias("v"), F.lit(1).alias("kind"), F.xxhash64("container").alias("tie"), "container"), allowMissingColumns=True)
        swept = ws.cut(_swept(events, max(1, -(-(n + n_gaps) // SWEEP_ROWS))), f"swept-{step}")
        left: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        placed_here = 0
        for part, state, count in swept.groupBy("part", "state").count().collect():  # three rows for each range
            if state == PLACED:
                placed_here += count
            else:
                left[part][state == ITEM_LEFT] = count
        across = segments({p: tuple(v) for p, v in left.items()})
        done.append(swept.where(F.col("state") == PLACED).select(*names, "container", "gap"))
        free, open_items = swept.where(F.col("state") == GAP_LEFT), swept.where(F.col("state") == ITEM_LEFT)
        if across:
            table = F.broadcast(spark.createDataFrame(across, "gp int, gf long, ip int, if long, n long, number long"))
            inside = lambda p, f: (F.col("part") == F.col(p)) & (F.col("rank") >= F.col(f)) & (F.col("rank") < F.col(f) + F.col("n"))
            free = free.join(table, inside("gp", "gf"), "left").withColumn("m", F.col("number") + F.col("rank") - F.col("gf"))
            open_items = open_items.join(table, inside("ip", "if"), "left").withColumn("m", F.col("number") + F.col("rank") - F.col("if"))
            pairs = open_items.where("m is not null").select(*names, "m").join(free.where("m is not null").select("m", "container", F.col("gap").alias("room")), "m")
            pairs = ws.cut(pairs.select(*names, "container", (F.col("room") - F.col("size")).alias("gap")), f"across-{step}")
            done.append(pairs)
            free, open_items = free.where("m is null"), open_items.where("m is null")
        matched = placed_here + sum(x[4] for x in across)
        before, n = n, n - matched
        items = open_items.select(*names)
        least = items.agg(F.min("size")).first()[0] or 0 if n else 0
        gaps = free.select("container", "gap")
        for d in done[-1 - bool(across) :]:
            gaps = gaps.unionByName(d.select("container", "gap"))
        gaps = ws.cut(gaps.where(F.col("gap") >= max(1, least)), f"gaps-{step}")
        n_gaps = gaps.count()
        step += 1
        if n and matched < LEAST_PLACED * before:
            rest, opened = _rest(items, n, capacity, opened, ws)
            done.append(rest)
            n = 0
    out = [F.col("container").alias("container_id"), "doc_id", "piece", "token_start", F.col("size").alias("n_tokens")]
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, opened))).alias("container")
    parts = [every.where("size = 0").select(*names, spread), *(d.select(*names, "container") for d in done)]
    total = parts[0]
    for d in parts[1:]:
        total = total.unionByName(d)
    return total.select(*out)


def packed_check(packed: DataFrame, documents: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row on a packing: ``n_texts`` put whole or in pieces, ``n_missing`` or told twice, ``n_over`` containers over capacity, ``well_filled``."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    room = boxes.where("t > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"), F.coalesce(F.sum((F.col("t") > capacity).cast("long")), F.lit(0)).alias("n_over"))
    texts = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("distinct"), F.max("piece").alias("last"))
    whole = (F.col("pieces") == F.col("distinct")) & (F.col("last") == F.col("pieces") - 1) & (F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("t") / capacity)))
    given = documents.select("doc_id").join(texts.withColumn("whole", whole), "doc_id", "left")
    given = given.agg(F.count(F.lit(1)).alias("n_texts"), F.coalesce(F.sum(F.when(F.col("whole"), 0).otherwise(1)), F.lit(0)).cast("long").alias("n_missing"))
    filled = F.coalesce(F.col("t") >= 0.999 * capacity * (F.col("n") - 1), F.lit(True))
    return given.crossJoin(F.broadcast(room)).select("n_texts", "n_missing", "n_over", filled.alias("well_filled"))  # one row each
