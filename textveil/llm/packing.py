"""Best-fit packing (operator 6): documents into as few sequences of a fixed length as can be, by exact complements.

Only the number of pieces of each length decides which lengths share a sequence, and there are at most `size` lengths.
So the plan is made on the driver from a table of at most `size` counts, whatever the size of the corpus:

1. Exact complements. From the longest length down, the gap that it leaves is looked up in the indexes of lengths, of
   sums of two and of sums of three lengths; a combination that fills the gap exactly is used as often as all its
   lengths are available.
2. Best fit. What is left goes, longest first, into the fullest sequence that still has room, whole counts at a time.

A plan is a list of patterns (lengths side by side) and how many sequences follow each. The pieces of one length, in a
fixed order, are dealt to the slots of that length. Numbering them needs no task that sees all of a length: each length
is cut by a hash into groups of a bounded size, numbered alone and shifted by the counts of the groups before."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textveil.llm.common import lean, written
from textveil.llm.tokens import encoder

SIZE = 2048
#: Pieces of a length that are numbered together, about.
GROUP = 20_000
PIECES_SQL = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: only the first may be shorter than size."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((at, size) for at in range(first, n, size))]


def _filling(gap: int, counts: np.ndarray) -> tuple[int, ...] | None:
    """One, two or three available lengths, longest first, whose sum is the gap; all of them available together."""
    if gap <= 0:
        return None
    if counts[gap]:
        return (gap,)
    have = counts > 0
    # pairs: a >= b, a + b = gap
    a = np.arange(gap - 1, (gap - 1) // 2, -1)
    found = have[a] & have[gap - a] & ((a != gap - a) | (counts[a] > 1))
    if found.any():
        return (int(a[k := found.argmax()]), int(gap - a[k]))
    for first in np.flatnonzero(have[: gap - 1])[::-1]:  # triples: first >= b >= c
        rest = gap - first
        if rest > 2 * first:
            break
        if rest < 2:
            continue
        b = np.arange(min(first, rest - 1), (rest - 1) // 2, -1)
        c = rest - b
        found = have[b] & have[c] & (counts[b] >= 1 + (b == first) + (b == c)) & (counts[c] >= 1 + (c == first) + (c == b))
        if found.any():
            return (int(first), int(b[k := found.argmax()]), int(c[k]))
    return None


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths whose sum is at most size) and the number of sequences that follow each; uses all counts."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    made: list[tuple[tuple[int, ...], int]] = []
    if left[size]:
        made.append(((size,), int(left[size])))
        left[size] = 0
    for length in range(size - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            rest = _filling(size - length, left)
            left[length] += 1
            if rest is None:
                break
            pattern = (length, *rest)
            times = min(int(left[x]) // pattern.count(x) for x in set(pattern))
            for x in pattern:
                left[x] -= times
            made.append((pattern, times))
    room: dict[int, list[list]] = {}  # room left: open sequences, as [pattern, times]
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fit = min((r for r in room if r >= length), default=None)
            if fit is None:
                per = size // length  # a new sequence takes as many of the same length as fit
                pattern, times = ((length,) * per, n // per) if n >= per else ((length,) * n, 1)
                used = times * len(pattern)
            else:
                old, open_ = room[fit].pop()
                if not room[fit]:
                    del room[fit]
                times = min(n, open_)
                if open_ > times:
                    room.setdefault(fit, []).append([old, open_ - times])
                pattern, used = (*old, length), times
            n -= used
            room.setdefault(size - sum(pattern), []).append([pattern, times])
    return made + [(tuple(p), t) for open_ in room.values() for p, t in open_]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), ascending. Rank r of that length lies at `offset` of sequence
    first sequence + r - first rank, by the last row whose first rank is at most r."""
    rows: dict[int, list] = {}
    dealt: dict[int, int] = {}
    sequence = 0
    for pattern, times in planned:
        offset = 0
        for length in pattern:
            rank = dealt.get(length, 0)
            rows.setdefault(length, []).append((rank, sequence, offset))
            dealt[length] = rank + times
            offset += length
        sequence += times
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 0) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(vocabulary, ranks)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(known.ids(text.as_py()), np.array(end_id, known.dtype)).astype("<u4")
                rows += [(doc_id, k, at, n, zlib.crc32(ids[at : at + n])) for k, (at, n) in enumerate(cut(len(ids), size))]
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(encode), PIECES_SQL)


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    A null or empty text is a document of the end id alone. Rows with the same or a null id are documents of their own.
    Other columns are not looked at. An empty table gives an empty table. Texts are encoded once; they are not shuffled."""
    found = written(pieces(docs, vocabulary, ranks, id_col=id_col, text_col=text_col, size=size, end_id=end_id), "pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    return place(found, counts, size=size, group=group)


def place(found: DataFrame, counts: dict[int, int], *, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """Deals pieces, of which there are `counts` of each length, to the slots of the plan."""
    where = slots(plan(counts, size))
    groups = max([1, *counts.values()]) // group + 1
    # identical pieces (repeated rows) may change places: nothing tells them apart
    order = ["doc_id", "piece", "start", "ids_crc32"]
    keyed = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    sizes = keyed.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("length", "part").orderBy(*order)) - 1)
    ranked = ranked.join(sizes.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("rank", F.col("rank") + F.col("before"))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                row = where[int(n)][np.searchsorted(where[int(n)][:, 0], rank[at], "right") - 1]
                sequence[at], offset[at] = row[:, 1] + rank[at] - row[:, 0], row[:, 2]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3).cast(pa.int64()), batch.column(4), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    columns = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return columns.mapInArrow(lean(deal), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
