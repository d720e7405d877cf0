"""Best-fit-decreasing packing of token sequences.

Documents become pieces of at most ``max_len`` tokens. Best-fit decreasing places pieces from long to
short, each in the fullest open sequence that still has room. Pieces of equal length are alike, so the
plan is made from the histogram of lengths, which has ``max_len`` rows at most whatever the corpus
holds: a segment tree over remaining capacities finds the tightest open sequences in logarithmic
time, and a run of equal pieces takes a run of equal sequences at once. The placements are those that
placing piece by piece would give. Each piece then finds its own place from its rank among the pieces
of its length, which is counted per partition and length, so that a length which half of all rows
share is never gathered in one task.

Nulls: a null text is an empty text, a null doc_id is kept. An empty text is a piece of the end id
alone. A very long text is cut into as many pieces as it needs. Ties (pieces of equal length) are told
apart by their rank. Repeated rows are packed once each. An empty table gives no rows. Further columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import crc32_u32, list_array, map_batches, only, slices, written

PIECES = "part int, rank long, doc_id long, piece int, start long, length int, ids_crc32 long, ids array<int>"
PLACES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Rows of the counts per partition and length that are broadcast; beyond, they meet the pieces in a sort-merge join.
BROADCAST_COUNTS = 200_000


class CapacityTree:
    """A segment tree over capacities 0..limit that knows which of them open sequences have."""

    def __init__(self, limit: int):
        self.leaves = 1 << limit.bit_length()
        self.any = [False] * (2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        i = capacity + self.leaves
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest capacity of at least ``least`` that an open sequence has."""
        i = least + self.leaves
        if not self.any[i]:
            while i & 1 or not self.any[i + 1]:
                i //= 2
                if i <= 1:
                    return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.leaves


def best_fit_decreasing(histogram: dict[int, int], max_len: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length the runs (first rank, first sequence, pieces per sequence, first offset) of its pieces, by rank."""
    tree, open_runs, runs, opened = CapacityTree(max_len), defaultdict(list), defaultdict(list), 0

    def release(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_runs[capacity].append((first, n))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, n = max_len, opened, -(-left // (max_len // length))
                opened += n
            else:
                first, n = open_runs[capacity].pop()
                if not open_runs[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            full = min(n, left // each)
            if full:
                runs[length].append((rank, first, each, max_len - capacity))
                release(capacity - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer than a sequence takes
                runs[length].append((rank, first + full, left, max_len - capacity))
                release(capacity - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            release(capacity, first + full, n - full)
    return dict(runs)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int) -> DataFrame:
    """Token pieces of whole texts, with each piece's rank among those of its length in its partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = tokens.encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(max_len + 1, np.int64)
        for batch in slices(batches):
            ids, offsets = tokens.with_end(*enc.encode(batch.column("text")), end_id)
            n = np.diff(offsets)
            count = -(-n // max_len)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            first = n - (count - 1) * max_len
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * max_len)
            length = np.where(piece == 0, first[doc], max_len)
            order = np.argsort(length, kind="stable")
            by_length = length[order]
            new = np.concatenate(([True], by_length[1:] != by_length[:-1])) if len(order) else np.zeros(0, bool)
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.flatnonzero(new)[np.cumsum(new) - 1] + seen[by_length] if len(order) else 0
            seen += np.bincount(length, minlength=max_len + 1)
            at = offsets[doc] + start
            crc = [crc32_u32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank), batch.column("doc_id").cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()),
                pa.array(start), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), list_array(ids.view(np.int32), np.concatenate((at, offsets[-1:])), pa.int32()),
            ], names=["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return written(map_batches(only(docs, "doc_id", "text"), cut, PIECES), "pieces")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, max_len: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(placements, pieces). Placements: PLACES, one row per piece; pieces: the pieces with their ids, by (doc_id, piece)."""
    cut = pieces(docs, tokenizer, end_id, max_len)
    counts = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "piece-counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # max_len rows at most
    runs = {length: tuple(np.array(x, np.int64) for x in zip(*of, strict=True)) for length, of in best_fit_decreasing(histogram, max_len).items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                ranks, first, each, at = runs[int(x)]
                run = np.searchsorted(ranks, rank[rows], side="right") - 1
                nth = rank[rows] - ranks[run]
                sequence[rows], offset[rows] = first[run] + nth // each[run], at[run] + nth % each[run] * x
            kept = [batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length.astype(np.int64)), batch.column("ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    bases = counts.select("length", "part", "base")
    bases = F.broadcast(bases) if counts.count() <= BROADCAST_COUNTS else bases.hint("merge")
    ranked = cut.drop("ids").join(bases, ["length", "part"])
    return map_batches(ranked, place, PLACES), cut


def sequences(placements: DataFrame, cut: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids, and the documents' places in them. A sequence has max_len pieces at most."""
    parts = placements.join(cut.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return (
        parts.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids"))).alias("parts"))
        .select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: F.struct(p.doc_id, p.piece, p.offset, p.length)).alias("places"))
    )
