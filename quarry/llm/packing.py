"""Best-fit packing of documents into sequences of bounded length (large-item matching).

Sizes are whole tokens up to the capacity, so a packing is decided on the
histogram of sizes, which has at most one row for each size however large the
input is. Items above a third of the capacity share a bin with at most one
other such item: they are matched greedily, the largest with the largest that
still fits. Smaller items then take the tightest gap that holds them. The plan
is a list of runs (the sizes in a bin, number of such bins); the n-th item of a
size finds its bin by its rank, so no task ever holds a whole size class.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import give_back, stored, texts, tidy
from quarry.llm.tokens import default_tokenizer, encoded

CAPACITY = 1024
#: Bytes of texts that a worker encodes at a time: fewer than elsewhere, as the pipeline's last stage meets executors whose heaps have grown.
SLICE_BYTES = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, local_rank long"


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Runs (sizes in a bin, number of bins) that hold every item of the histogram {size: count}."""
    left = {s: n for s, n in histogram.items() if n > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    open_bins: dict[int, list[list]] = {}  # gap: runs
    gaps: list[int] = []  # of open_bins, ascending

    def keep(sizes: list[int], count: int) -> None:
        gap = capacity - sum(sizes)
        if gap not in open_bins:
            open_bins[gap] = []
            bisect.insort(gaps, gap)
        open_bins[gap].append([sizes, count])

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        at = bisect.bisect_right(large, capacity - a) - 1
        if at >= 0 and large[at] == a and left[a] == 1:
            at -= 1
        while at >= 0 and not left[large[at]]:
            large.pop(at)  # a size that has run out
            at -= 1
        if at < 0:
            keep([a], left[a])
            left[a] = 0
            continue
        b = large[at]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        left[a] -= n
        left[b] -= n
        keep([a, b], n)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect.bisect_left(gaps, s)
            if at == len(gaps):
                each = capacity // s
                if n >= each:
                    keep([s] * each, n // each)
                    n %= each
                else:
                    keep([s] * n, 1)
                    n = 0
                continue
            gap = gaps[at]
            sizes, count = open_bins[gap].pop()
            if not open_bins[gap]:
                del open_bins[gap]
                gaps.pop(at)
            k = min(n, count)
            if k < count:
                keep(sizes, count - k)
            keep([*sizes, s], k)
            n -= k
    return [(sizes, count) for g in gaps for sizes, count in open_bins[g]]


def slots(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the r-th item of a size goes: sorted keys (size << 44 | first rank), and first rank, first bin, offset."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for sizes, count in plan:
        offset = 0
        for s in sizes:
            low = taken.get(s, 0)
            rows.append((s << 44 | low, low, first, offset))
            taken[s] = low + count
            offset += s
        first += count
    table = np.asarray(sorted(rows), np.int64).reshape(-1, 4)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), table[:, 3].copy()


def cut(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents: those longer than the capacity are cut, the first piece takes what is over.

    shard is the task that made a row and local_rank counts its pieces of the
    same length, so ranks within a length need no ordering of the whole class.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for part, ids in encoded(batches, path, SLICE_BYTES):
            total = np.asarray([len(x) // 4 for x in ids], np.int64)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(ids)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            head = total - (n - 1) * capacity
            start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
            length = np.where(piece == 0, head[row], capacity)
            crc = [zlib.crc32(ids[r][4 * s : 4 * (s + k)]) for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            sizes = length[order]
            rank = np.empty(len(row), np.int64)
            rank[order] = np.arange(len(row)) - np.searchsorted(sizes, sizes) + seen[sizes]
            seen += np.bincount(length, minlength=capacity + 1)
            yield pa.record_batch(
                [
                    part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(row), shard, np.int32)), pa.array(rank),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "shard", "local_rank"],
            )
            give_back()

    return texts(docs).mapInArrow(tidy(run), PIECES)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset of stored pieces (see cut); equal pieces get places of their own, and no pieces give no rows.

    The driver gets one row for each length in use (capacity rows at most).
    """
    counts = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    keys, low, first, offset = slots(plan_bins(histogram, capacity))
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            yield pa.record_batch(
                [batch.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")]
                + [pa.array(first[at] + rank - low[at]), pa.array(offset[at])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    ranked = pieces.join(before, ["length", "shard"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("before")).alias("rank")
    )
    return ranked.mapInArrow(tidy(run), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack the ids of whole documents, each with its end id, into sequences of at most capacity ids.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset. A null or empty text is its end id alone; repeated
    doc_ids are packed as documents of their own; an empty table gives no
    rows; other columns are ignored.
    """
    return place(stored(cut(docs, tokenizer, capacity), "pieces"), capacity)


def sequences(placed: DataFrame, tokens: DataFrame) -> DataFrame:
    """The packed ids: sequence_id, tokens, doc_ids, starts. tokens has doc_id (unique) and its list of ids.

    A group has at most capacity ids. Pieces of a doc_id that tokens lacks, or
    of a null one, are left out; a doc_id that repeats there would repeat its
    pieces.
    """
    cut_ids = placed.join(tokens.select("doc_id", F.col("tokens").alias("ids")), "doc_id").select(
        "sequence_id", "offset", "doc_id", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids")
    )
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return cut_ids.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("tokens"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("starts")
    )
