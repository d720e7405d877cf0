"""Exact removal of repeated strings by suffix sorting with bucket pointers.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else. Suffixes
are compared by their first ``length`` bytes only, so sorting ends at that depth. It is done by bucket
identifiers, refined from coarse to fine:

1. Initial buckets are q-grams (q = length / 5). A bucket's identifier at depth 2h is made from the
   identifiers at depth h of a suffix and of the suffix h later; the same step is used again from depth
   1 up to the full length. Identifiers are 64-bit hashes of pairs rather than ranks, which a sort of
   the whole corpus for each depth would take; what they claim is put to the proof in the end.
2. A suffix is filed under the least q-gram that starts in its first length - q + 1 places (the
   leftmost of equals). Equal strings have the same one. Neighbouring suffixes under one q-gram make a
   run of at most length - q + 1; only runs are written: bucket, place, and an identifier of all
   the bytes the run spans, about one run in (length - q) / 2 bytes.
3. Runs alone in their bucket have no repeat and are done. Runs whose spans have equal identifiers
   repeat throughout. Only what is left, runs next to a difference, is refined suffix by suffix: its
   suffixes are sorted by their full-depth identifiers against one run of each span in the bucket.
   Equal suffixes of a slice of texts are answered where they are, and one of them moves on.
4. Every repeat names a witness, another place where the same string starts. The bytes of both are
   compared by their SHA-256, of which no two texts are known to share one. Where a pair differs, all is
   done again with other identifiers; equal strings have equal identifiers whatever these are, so
   nothing is lost, and nothing that occurs once is returned.

Counts are pre-aggregated and met by joins that may split a hot bucket; a large bucket is dealt by
identifiers, of which a task gets one for each slice of texts at most; no pairs of a group are made.

Nulls: a null text is empty. Rows with equal or null doc_id are told apart by a number given to
each row, so repeated rows are copies of each other and lose all that is long enough. Very long texts
are read in blocks that overlap. Of ties any other place is the witness. An empty table gives no rows.
Further columns, whatever their names, are ignored by ``repeats`` and kept by ``remove_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, gathered, map_batches, numbered, only, release, slices, written

SHARE = 5
#: Spans of a bucket whose suffixes one task sorts.
SPANS_PER_SHARE = 64
#: Places of which identifiers are held at a time.
BLOCK = 1 << 18
#: Depth up to which identifiers of all places are made; greater ones only where they are asked for.
EVERYWHERE = 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each over all."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of two identifiers, one after the other."""
    x = a * np.uint64(0xD6E8FEB86659FD93)
    x += b
    x ^= x >> np.uint64(32)
    x *= _MULTIPLIER
    return x


class Buckets:
    """Bucket identifiers of the suffixes of a block, depth by depth. Each key gives other ones."""

    def __init__(self, data: np.ndarray, key: int):
        of_byte = _mixed(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER + np.uint64(key << 32))
        self.ids = {1: of_byte[data]}

    @staticmethod
    def halves(h: int) -> tuple[int, int]:
        left = 1 << (h - 1).bit_length() - 1  # the largest power of two below h
        return left, h - left

    def everywhere(self, h: int) -> np.ndarray:
        """Identifiers of the first h bytes from every place on."""
        if h not in self.ids:
            left, right = self.halves(h)
            a, b = self.everywhere(left), self.everywhere(right)
            n = max(len(self.ids[1]) - h + 1, 0)
            self.ids[h] = _paired(a[:n], b[left : left + n])
        return self.ids[h]

    def at(self, h: int, places: np.ndarray) -> np.ndarray:
        """The same from the given places on."""
        if h <= EVERYWHERE or h in self.ids:
            return self.everywhere(h)[places]
        left, right = self.halves(h)
        return _paired(self.at(left, places), self.at(right, places + left))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def blocks_of(texts: list[np.ndarray], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts' bytes, BLOCK places or so at a time: bytes, and of each segment its text, its first place there and its size."""
    segments = [(i, first, min(first + BLOCK, len(x) - length + 1) + length - 1) for i, x in enumerate(texts) for first in range(0, len(x) - length + 1, BLOCK)]
    if segments:
        text, first, end = np.array(segments, np.int64).T
        size = end - first
        for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(np.cumsum(size) // BLOCK)) + 1):
            if len(part):
                yield np.concatenate([texts[text[k]][first[k] : end[k]] for k in part]), text[part], first[part], size[part]


def runs_of(texts: list[np.ndarray], length: int, key: int) -> list[np.ndarray]:
    """Of all runs of the texts' suffixes: text, bucket, span identifier, first and last place."""
    q = length // SHARE
    width = length - q + 1
    kinds = (np.int64, np.uint64, np.uint64, np.int64, np.int64)
    out = [[np.zeros(0, kind) for kind in kinds]]
    for data, text, first, size in blocks_of(texts, length):
        ids = Buckets(data, key)
        gram = ids.everywhere(q)
        order = (_mixed(gram) & ~np.uint64((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)  # a block has fewer than 2 ** 20 places
        least = (_least(order, width) & np.uint64((1 << 20) - 1)).astype(np.int64)
        n = size - length + 1  # suffixes of each segment
        starts = np.cumsum(size) - size
        place = np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())
        segment, gram_at = np.repeat(np.arange(len(n)), n), least[place]
        at = np.flatnonzero(np.concatenate(([True], (segment[1:] != segment[:-1]) | (gram_at[1:] != gram_at[:-1]))))
        low, high = place[at], place[np.concatenate((at[1:], [len(place)])) - 1]
        span = _paired(_paired(ids.at(length, low), ids.at(length, high)), (high - low).astype(np.uint64))
        shift = (first - starts)[segment[at]]
        out.append([text[segment[at]], gram[gram_at[at]], span, low + shift, high + shift])
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def suffix_ids(data: np.ndarray, length: int, low: np.ndarray, high: np.ndarray, key: int) -> np.ndarray:
    """Full-depth identifiers of all suffixes of runs in ``data``, run by run."""
    out, sizes = [np.zeros(0, np.uint64)], high - low + length
    for part in np.split(np.arange(len(low)), np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1):
        if len(part):
            block, n = gathered(data, low[part], sizes[part]), sizes[part] - length + 1
            starts = np.cumsum(sizes[part]) - sizes[part]
            out.append(Buckets(block, key).at(length, np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum())))
    return np.concatenate(out)


def _rows_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", dtype=np.uint8) for x in pc.cast(batch.column("text"), pa.binary()).to_pylist()]


def find_runs(rows: DataFrame, length: int, key: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text, bucket, span, low, high = runs_of(_rows_of(batch), length, key)
            row = batch.column("row").to_numpy()[text]
            span >>= np.uint64(64 - bits)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket.view(np.int64)), pa.array(span.view(np.int64)), pa.array(row), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["bucket", "span", "row", "low", "high"]
            )

    return map_batches(rows, run, "bucket long, span long, row long, low int, high int")


def repeated_intervals(rows: DataFrame, length: int, first_bits: int = 64) -> DataFrame:
    """(row, low, high): suffixes low..high of the row start strings that also start elsewhere. ``first_bits``: of the first identifiers."""
    for key in count():
        found = claimed_intervals(rows, length, key, 64 if key else first_bits)
        if not differ(rows, found, length):
            return found.select("row", "low", "high")
        release(rows.sparkSession, found)


#: Suffixes that move on: of segments (one row, neighbouring places) row, first place, number and whether they ask, and
#: all their identifiers. With a share of -1, intervals that are found: row, first place, number, and the witness's row and place.
SUFFIXES = {"bucket": pa.int64(), "share": pa.int32(), "rows": pa.binary(), "lows": pa.binary(), "sizes": pa.binary(), "asks": pa.binary(), "ids": pa.binary(), "witness_rows": pa.binary(), "witness_lows": pa.binary()}
FOUND = "row long, low int, high int, witness long, witness_low int"


def claimed_intervals(rows: DataFrame, length: int, key: int, bits: int) -> DataFrame:
    """FOUND: intervals of suffixes whose strings start at a witness too, if identifiers are right."""
    spark = rows.sparkSession
    every = written(find_runs(rows, length, key, bits), "runs")
    # counts are written before they are met: a join of two tables can split a hot bucket, one that counts itself can't
    shared = written(every.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "shared-buckets")
    runs = written(every.join(shared, "bucket"), "shared-runs")
    release(spark, every, shared)
    place = F.struct("row", "low", "high")
    spans = written(runs.groupBy("bucket", "span").agg(F.count("*").alias("n"), F.min(place).alias("one"), F.max(place).alias("other")), "spans")
    release(spark)
    buckets = spans.groupBy("bucket").agg(F.count("*").alias("spans"), F.count(F.when(F.col("n") == 1, 1)).alias("alone")).filter("spans > 1 and alone > 0")
    buckets = written(buckets, "open-buckets")
    witness = F.when(place == F.col("one"), F.col("other")).otherwise(F.col("one"))
    whole = runs.join(spans.filter("n > 1").select("bucket", "span", "one", "other"), ["bucket", "span"])
    whole = whole.select("row", "low", "high", witness["row"].alias("witness"), witness["low"].alias("witness_low"))
    # a run alone asks; one run of every other span in its bucket answers; a large bucket is dealt by identifiers
    share = F.ceil(F.col("spans") / SPANS_PER_SHARE).cast("int").alias("shares")
    asked = spans.join(buckets, "bucket").select("bucket", "one.*", (F.col("n") == 1).alias("asks"), share)
    wanted = asked.groupBy("row").agg(F.collect_list(F.struct("bucket", "low", "high", "asks", "shares")).alias("runs"))  # at most the runs of one text

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, of = _rows_of(batch), batch.column("runs")
            n_runs = pc.list_value_length(of).to_numpy()
            bucket, low, high, asks, shares = (x.to_numpy(zero_copy_only=False) for x in of.flatten().flatten())
            low, high = low.astype(np.int64), high.astype(np.int64)
            base = np.cumsum([0, *map(len, texts)])[:-1].repeat(n_runs)
            ids = suffix_ids(np.concatenate(texts), length, base + low, base + high, key) >> np.uint64(64 - bits)
            run = np.repeat(np.arange(len(low)), high - low + 1)
            row, places = batch.column("row").to_numpy().repeat(n_runs)[run], gathered_places(low, high)
            first, partner = _partners(ids)
            asking = asks[run]
            if len(at := np.flatnonzero(asking & (partner >= 0))):
                yield _found_suffixes(row[at], places[at], row[partner[at]], places[partner[at]])
            at = np.flatnonzero(first)  # one of each identifier moves on, asking if it is alone here
            to = (_mixed(ids[at]) % shares[run[at]].astype(np.uint64)).astype(np.int32)
            at, to = (x[np.lexsort((run[at], to, bucket[run[at]]))] for x in (at, to))
            yield from _moving(bucket[run[at]], to, run[at], row[at], places[at], asking[at] & (partner[at] < 0), ids[at])

    suffixes = map_batches(rows.join(wanted, "row").select("row", "text", "runs"), refine, "bucket long, share int, rows binary, lows binary, sizes binary, asks binary, ids binary, witness_rows binary, witness_lows binary")
    sorted_buckets = suffixes.repartition("bucket", "share").sortWithinPartitions("bucket", "share")
    single = written(map_batches(sorted_buckets, _equal_suffixes, FOUND), "equal-suffixes")
    release(spark)
    each = whole.union(single).groupBy("row").agg(F.collect_list(F.struct("low", "high", "witness", "witness_low")).alias("found"))  # at most the suffixes of one text
    intervals = written(map_batches(each, _joined_intervals, FOUND), "intervals")
    release(spark, runs, spans, buckets, single)
    return intervals


def gathered_places(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = high - low + 1
    return np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def _partners(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each identifier: whether it is the one that stands for its equals, and another place of it or -1."""
    order = np.argsort(ids)
    new = np.concatenate(([True], ids[order[1:]] != ids[order[:-1]])) if len(ids) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    n = np.diff(np.concatenate((starts, [len(ids)])))
    first, partner = np.zeros(len(ids), bool), np.empty(len(ids), np.int64)
    first[order[starts]] = True
    partner[order] = np.repeat(order[starts], n)
    partner[order[starts]] = np.where(n > 1, order[np.minimum(starts + 1, len(ids) - 1)], -1) if len(ids) else 0
    return first, partner


def _blobs(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The stretches of values from each start to the next, as bytes."""
    data = np.ascontiguousarray(values)
    ends = np.concatenate((starts, [len(data)])) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _suffix_batch(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in SUFFIXES.items()], names=list(SUFFIXES))


def _intervals(row: np.ndarray, place: np.ndarray, witness: np.ndarray, witness_place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Suffixes as (row, low, number, witness, witness_low): neighbours with neighbouring witnesses together."""
    order = np.lexsort((place, witness_place - place, witness, row))
    row, place, witness, witness_place = (x[order] for x in (row, place, witness, witness_place))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (witness[1:] != witness[:-1]) | (place[1:] != place[:-1] + 1) | (witness_place[1:] != witness_place[:-1] + 1)
    at = np.flatnonzero(new)
    return row[at], place[at], np.diff(np.concatenate((at, [len(row)]))), witness[at], witness_place[at]


def _found_suffixes(row: np.ndarray, place: np.ndarray, witness: np.ndarray, witness_place: np.ndarray) -> pa.RecordBatch:
    row, low, n, witness, witness_low = _intervals(row, place, witness, witness_place)
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    kinds = {"rows": (row, np.int64), "lows": (low, np.int32), "sizes": (n, np.int32), "witness_rows": (witness, np.int64), "witness_lows": (witness_low, np.int32)}
    columns = {"bucket": pa.array(row[starts]), "share": pa.array(np.full(len(starts), -1), pa.int32())}
    return _suffix_batch(columns | {k: _blobs(x.astype(kind), starts) for k, (x, kind) in kinds.items()}, len(starts))


def _moving(bucket: np.ndarray, share: np.ndarray, run: np.ndarray, row: np.ndarray, place: np.ndarray, asks: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by bucket, share and run, as one row for each bucket and share."""
    if not len(ids):
        return
    group = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (share[1:] != share[:-1])))
    segment = group | np.concatenate(([True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + 1) | (asks[1:] != asks[:-1])))
    groups, segments = np.flatnonzero(group), np.flatnonzero(segment)
    sizes, starts = np.diff(np.concatenate((segments, [len(ids)]))), np.searchsorted(segments, groups)
    columns = {"bucket": pa.array(bucket[groups]), "share": pa.array(share[groups], pa.int32()), "ids": _blobs(ids, groups)}
    kinds = {"rows": row[segments], "lows": place[segments].astype(np.int32), "sizes": sizes.astype(np.int32), "asks": asks[segments].astype(np.uint8)}
    yield _suffix_batch(columns | {k: _blobs(x, starts) for k, x in kinds.items()}, len(groups))


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _equal_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket and share: FOUND intervals of asking suffixes whose identifier the share has twice, and those found before."""
    held = None

    def answered(row: np.ndarray, low: np.ndarray, n: np.ndarray, witness: np.ndarray, witness_low: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(low, pa.int32()), pa.array(low + n - 1, pa.int32()), pa.array(witness), pa.array(witness_low, pa.int32())], names=["row", "low", "high", "witness", "witness_low"])

    def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
        before = pc.equal(table.column("share"), -1)
        if len(done := table.filter(before)):
            yield answered(*(_joined(done.column(c), k) for c, k in (("rows", np.int64), ("lows", np.int32), ("sizes", np.int32), ("witness_rows", np.int64), ("witness_lows", np.int32))))
        table = table.filter(pc.invert(before))
        if not len(table):
            return
        low, sizes = (_joined(table.column(c), np.int32).astype(np.int64) for c in ("lows", "sizes"))
        ids, segment = _joined(table.column("ids"), np.uint64), np.repeat(np.arange(len(low)), sizes)
        places = gathered_places(low, low + sizes - 1)
        _, partner = _partners(ids)
        at = np.flatnonzero((partner >= 0) & _joined(table.column("asks"), np.uint8).astype(bool)[segment])
        row = _joined(table.column("rows"), np.int64)
        if len(at):
            yield answered(*_intervals(row[segment[at]], places[at], row[segment[partner[at]]], places[partner[at]]))

    for batch in batches:
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        if not len(table):
            continue
        keys = [table.column(c).to_numpy() for c in ("bucket", "share")]
        group = np.cumsum(np.concatenate(([False], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
        last = int(np.searchsorted(group, group[-1]))  # the last group may go on
        held = table.slice(last)
        if last:
            yield from found(table.slice(0, last))
    if held is not None and len(held):
        yield from found(held)


def _joined_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of each row that touch or overlap and lie alike against the same witness, as one."""
    for batch in batches:
        of = batch.column("found")
        row = np.repeat(batch.column("row").to_numpy(), pc.list_value_length(of).to_numpy())
        low, high, witness, witness_low = (x.to_numpy().astype(np.int64) for x in of.flatten().flatten())
        order = np.lexsort((low, witness_low - low, witness, row))
        row, low, high, witness, shift = (x[order] for x in (row, low, high, witness, witness_low - low))
        if not len(row):
            continue
        other = np.concatenate(([True], (row[1:] != row[:-1]) | (witness[1:] != witness[:-1]) | (shift[1:] != shift[:-1])))
        key = np.cumsum(other) << 32  # the greatest place so far, within each
        upto = np.maximum.accumulate(key + high) - key
        new = other | np.concatenate(([True], low[1:] > upto[:-1] + 1))
        at = np.flatnonzero(new)
        ends = np.concatenate((at[1:], [len(row)])) - 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[at]), pa.array(low[at], pa.int32()), pa.array(upto[ends], pa.int32()), pa.array(witness[at]), pa.array((low + shift)[at], pa.int32())], names=["row", "low", "high", "witness", "witness_low"]
        )


def differ(rows: DataFrame, found: DataFrame, length: int) -> bool:
    """Whether any interval's bytes are others than its witness's, by their SHA-256."""
    size = (F.col("high") - F.col("low") + length).alias("size")
    pairs = found.select("row", "low", size, "witness", "witness_low")
    places = pairs.select("row", "low", "size").union(pairs.select("witness", "witness_low", "size")).distinct()
    wanted = places.groupBy("row").agg(F.collect_list(F.struct("low", "size")).alias("places"))  # at most the suffixes of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            of = batch.column("places")
            n = pc.list_value_length(of).to_numpy()
            low, size = (x.to_numpy() for x in of.flatten().flatten())
            texts, at = [memoryview(x) for x in pc.cast(batch.column("text"), pa.binary()).to_pylist()], np.repeat(np.arange(len(n)), n)
            found = [sha256(texts[i][a : a + k]).digest() for i, a, k in zip(at.tolist(), low.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("row").to_numpy()[at]), pa.array(low), pa.array(size), pa.array(found, pa.binary())], names=["row", "low", "size", "digest"])

    spark = rows.sparkSession
    digests = written(map_batches(rows.join(wanted, "row").select("row", "text", "places"), cut, "row long, low int, size int, digest binary"), "interval-digests")
    release(spark)
    mine = pairs.join(digests.withColumnRenamed("digest", "mine"), ["row", "low", "size"])
    theirs = digests.select(F.col("row").alias("witness"), F.col("low").alias("witness_low"), "size", "digest")
    out = bool(mine.join(theirs, ["witness", "witness_low", "size"]).filter("mine != digest").limit(1).count())
    release(spark, digests)
    return out


def _merged(low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed runs [begin, end) of a text."""
    order = np.argsort(low, kind="stable")
    low, end = low[order].astype(np.int64), np.maximum.accumulate(high[order].astype(np.int64)) + length
    new = np.concatenate(([True], low[1:] > end[:-1]))
    return low[new], end[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(end) - 1]))]


def spans_joined(docs: DataFrame, length: int, name: str, first_bits: int = 64) -> DataFrame:
    """All columns of ``docs`` and ``name``: the intervals of repeated suffixes of each row, null for none."""
    row = fresh_name(docs, "row")
    rows = numbered(docs, row)
    found = repeated_intervals(rows.select(F.col(row).alias("row"), "text"), length, first_bits)
    found = found.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("low", "high")).alias(name))  # at most the suffixes of one text
    return rows.join(found, row, "left").drop(row)


def cut_batches(length: int, name: str, make):
    """A function for mapInArrow: calls make(batch, texts as bytes, [(begins, ends) or None])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = []
            for of in batch.column(name):
                spans.append(_merged(of.values.field(0).to_numpy(), of.values.field(1).to_numpy(), length) if of.is_valid else None)
            yield make(batch, pc.fill_null(pc.cast(batch.column("text"), pa.binary()), b"").to_pylist(), spans)

    return run


def kept_bytes(text: bytes, spans: tuple[np.ndarray, np.ndarray] | None) -> bytes:
    if spans is None:
        return text
    edges = [0, *np.stack(spans, axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeats(docs: DataFrame, length: int = 200, first_bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, spans (begin, end of each removed run) and kept (the remaining bytes) of each row.

    ``first_bits`` of an identifier are used at first; fewer than 64 are for tests of what follows then.
    """

    def make(batch: pa.RecordBatch, texts: list[bytes], spans: list) -> pa.RecordBatch:
        count = np.array([0 if s is None else len(s[0]) for s in spans], dtype=np.int64)
        flat = [np.concatenate([s[i] for s in spans if s is not None] or [np.zeros(0, np.int64)]) for i in (0, 1)]
        offsets = np.concatenate(([0], np.cumsum(count)))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1])], names=["begin", "end"]))
        kept = pa.array([kept_bytes(t, s) for t, s in zip(texts, spans, strict=True)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), lists, kept], names=["doc_id", "n_bytes", "spans", "kept"])

    rows = spans_joined(only(docs, "doc_id", "text"), length, "found", first_bits).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "found")
    return map_batches(rows, cut_batches(length, "found", make), "doc_id long, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.end - s.begin)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """``docs`` with the repeated strings cut out of text, its other columns as they are. A character cut in two goes; texts of which nothing but white space is left go, too."""
    name, columns = fresh_name(docs, "found"), list(docs.columns)

    def make(batch: pa.RecordBatch, texts: list[bytes], spans: list) -> pa.RecordBatch:
        text = batch.column("text")
        if any(s is not None for s in spans):
            old = text.to_pylist()
            text = pa.array([o if s is None else kept_bytes(t, s).decode(errors="ignore") for o, t, s in zip(old, texts, spans, strict=True)], pa.string())
        keep = pa.array([s is None or bool(x.strip()) for s, x in zip(spans, text.to_pylist(), strict=True)])
        out = pa.RecordBatch.from_arrays([text if c == "text" else batch.column(c) for c in columns], names=columns)
        return out.filter(keep)

    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields])
    return map_batches(spans_joined(docs, length, name), cut_batches(length, name, make), schema)
