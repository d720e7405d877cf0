"""SimHash near-duplicates with pivot distance tables.

Fingerprints: bit b of a text is set if more than half of its word shingles, repeats included, have it
set in their XXH64. Equal fingerprints are one node from then on.

Candidates: two fingerprints that differ in at most ``max_bits`` bits agree in all but so many of
``max_bits + shared`` blocks, so they meet in a bucket of ``shared`` equal blocks. Buckets are exact;
none is capped. In a bucket, each fingerprint has a row of Hamming distances to ``pivots`` reference
fingerprints. By the triangle inequality a linked pair's rows differ by at most ``max_bits`` in every
coordinate: pairs with a greater maximum difference are discarded, and survivors verified by the
distance itself. Buckets of more than ``block`` fingerprints are dealt as pairs of blocks, so no task
holds more than two blocks; of a large bucket only a spanning forest of its links is returned, which
has the same components.

Nulls: a null text has no words; without words the fingerprint is zero, and links like any other. A
null doc_id is kept and never becomes a component's id, unless no other is there. Very long texts are
hashed whole, in steps. A bit that exactly half of the shingles have is zero. Repeated rows are kept, as
one node. An empty table gives no rows. Further columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, map_batches, numbered, only, slices, written
from .graph import components

SEED = 42
#: Shingles whose bits are unpacked at a time.
UNPACK = 1 << 16


def shingle_hashes(text: bytes | None, words_per_shingle: int) -> list[int]:
    """XXH64 of each shingle of a text, repeats included."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split() if text else []  # of bytes: A-Z alone, and the six white spaces of ASCII
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    k = min(words_per_shingle, len(words))
    begin = [0, *(ends[: len(words) - k] + 1).tolist()]
    return [digest(joined[a:b], SEED) for a, b in zip(begin, ends[k - 1 :].tolist(), strict=True)]


def hashed_runs(texts: list[bytes | None], words_per_shingle: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(texts with words, where each begins, all their hashes), about UNPACK hashes at a time."""
    rows, counts, flat = [], [], []
    for i, text in enumerate(texts):
        if found := shingle_hashes(text, words_per_shingle):
            rows.append(i), counts.append(len(found))
            flat += found
        if rows and (len(flat) >= UNPACK or i == len(texts) - 1):
            yield rows, np.cumsum(counts) - np.array(counts), np.array(flat, dtype="<u8")
            rows, counts, flat = [], [], []
    if rows:
        yield rows, np.cumsum(counts) - np.array(counts), np.array(flat, dtype="<u8")


def _fingerprints(starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    n = np.diff(np.concatenate((starts, [len(h)])))
    ones = np.zeros((len(n), 64), np.int64)
    for first in range(0, len(h), UNPACK):  # a very long text is added up in steps
        bits = np.unpackbits(h[first : first + UNPACK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = np.flatnonzero((starts < first + UNPACK) & (starts + n > first))
        ones[here] += np.add.reduceat(bits, np.maximum(starts[here] - first, 0), axis=0, dtype=np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprint_batch(texts: list[bytes | None], words_per_shingle: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    for rows, starts, h in hashed_runs(texts, words_per_shingle):
        out[rows] = _fingerprints(starts, h)
    return out


def fingerprints(docs: DataFrame, words_per_shingle: int) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = fingerprint_batch(pc.cast(batch.column("text"), pa.binary()).to_pylist(), words_per_shingle)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(only(docs, "doc_id", "text"), run, "doc_id long, fp long")


def pivot_table(fps: np.ndarray, pivots: int) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints."""
    reference = np.random.default_rng(SEED).integers(0, 1 << 63, size=pivots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.bitwise_count(fps[:, None] ^ reference[None, :]).astype(np.int8)


def _close(a: np.ndarray, b: np.ndarray, table_a: np.ndarray, table_b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs pass the pivots, one coordinate after another, and then the distance itself."""
    left = np.arange(len(a))
    for c in range(table_a.shape[1]):
        left = left[np.abs(table_a[left, c] - table_b[left if len(table_b) == len(a) else slice(None), c]) <= max_bits]
        if not len(left):
            return left
    return left[np.bitwise_count(a[left] ^ b[left if len(b) == len(a) else slice(None)]) <= max_bits]


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, sorted, is ``similarity`` or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both)


def links_of(
    ids: np.ndarray, fps: np.ndarray, signs: np.ndarray | None, group: np.ndarray, max_bits: int, pivots: int, least_equal: int, small: int = 32, sets: list[np.ndarray] | None = None, similarity: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group``: all in small groups, a spanning forest in large ones. With ``sets``, those decide."""
    if not len(fps):
        return ids, ids
    table = pivot_table(fps, pivots)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(fps)])))
    out_a, out_b = [ids[:0]], [ids[:0]]
    size_of, end_of = np.repeat(sizes, sizes), np.repeat(starts + sizes, sizes)

    def linked(rows: np.ndarray, other: np.ndarray) -> np.ndarray:
        got = _close(fps[rows], fps[other], table[rows], table[other], max_bits)
        if signs is not None and len(got):
            o = other[got] if len(other) == len(rows) else other
            got = got[np.count_nonzero(signs[rows[got]] == signs[o], axis=1) >= least_equal]
        if sets is not None and len(got):
            o = other[got] if len(other) == len(rows) else np.repeat(other, len(got))
            got = got[[alike(sets[x], sets[y], similarity) for x, y in zip(rows[got], o, strict=True)]]
        return got

    rows = np.flatnonzero(size_of <= small)
    for step in range(1, small):
        rows = rows[rows + step < end_of[rows]]
        if not len(rows):
            break
        got = linked(rows, rows + step)
        out_a.append(ids[rows[got]])
        out_b.append(ids[rows[got] + step])
    for s, n in zip(starts[sizes > small], sizes[sizes > small], strict=True):
        left = np.arange(s, s + n)
        while len(left):
            frontier, left = [left[0]], left[1:]
            while frontier and len(left):
                x = frontier.pop()
                got = linked(left, np.array([x]))
                if len(got):
                    out_a.append(np.full(len(got), ids[x]))
                    out_b.append(ids[left[got]])
                    frontier.extend(left[got])
                    left = np.delete(left, got)
    return np.concatenate(out_a), np.concatenate(out_b)


def bucket_masks(max_bits: int, shared: int) -> list[int]:
    """The bits of every choice of ``shared`` among ``max_bits + shared`` even blocks of the 64."""
    n = max_bits + shared
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [sum(x) for x in combinations(blocks, shared)]


def blocks_to_share(n: int, max_bits: int, fill: int = 4) -> int:
    """The fewest equal blocks by which buckets of n even fingerprints hold ``fill`` at most. Any number is exact."""
    shared = 1
    while n > fill * 2 ** (64 * shared / (shared + max_bits)):
        shared += 1
    return shared


def links(fps: DataFrame, max_bits: int = 4, shared: int | None = None, pivots: int = 16, block: int = 4096) -> DataFrame:
    """(u, v): links between different fingerprints of ``fps`` (column fp, distinct) that keep its components."""
    shared = shared or blocks_to_share(fps.count(), max_bits)
    signed = [m - (1 << 64) if m >> 63 else m for m in bucket_masks(max_bits, shared)]
    key = F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))).alias("k")
    keyed = fps.select("fp", key).select("k.mask", "k.bits", F.col("fp").alias("id"))
    return links_in_buckets(keyed, None, max_bits, pivots, 0, block)


def links_in_buckets(keyed: DataFrame, nodes: DataFrame | None, max_bits: int, pivots: int, least_equal: int, block: int, similarity: float = 0.0) -> DataFrame:
    """(u, v): links among nodes whose ids share a bucket (mask, bits), and that have ``least_equal`` equal bytes of sign.

    ``nodes`` has fp and sign of each id; without it, ids are the fingerprints. They are met only by
    ids that share a bucket with another. If nodes have shingles too, links have ``similarity`` of these.
    """
    # written before it is met: a join of two tables can split a hot bucket, one that counts itself can't
    sizes = written(keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    full = keyed.join(sizes, ["mask", "bits"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    full = full.join(nodes, "id") if nodes is not None else full.withColumn("fp", F.col("id")).withColumn("sign", F.lit(None).cast("binary"))
    more = [c for c in full.columns if c == "shingles"]
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = full.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("mask", "bits", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "id", "fp", "sign", *more)
    dealt = dealt.repartition("mask", "bits", "i", "j").sortWithinPartitions("mask", "bits", "i", "j", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found(table: pa.Table, group: np.ndarray) -> pa.RecordBatch:
            sign = table.column("sign")
            signs = None if sign.null_count else np.frombuffer(b"".join(sign.to_pylist()), np.uint8).reshape(len(table), -1)
            sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()] if more else None
            a, b = links_of(table.column("id").to_numpy(), table.column("fp").to_numpy().view(np.uint64), signs, group, max_bits, pivots, least_equal, sets=sets, similarity=similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not len(table):
                continue
            keys = [table.column(c).to_numpy() for c in ("mask", "bits", "i", "j")]
            group = np.cumsum(np.concatenate(([False], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
            last = int(np.searchsorted(group, group[-1]))  # the last group may go on
            held = table.slice(last)
            if last:
                yield found(table.slice(0, last), group[:last])
        if held is not None and len(held):
            yield found(held, np.zeros(len(held), np.int64))

    return map_batches(dealt, run, "u long, v long")


def near_duplicates(docs: DataFrame, words_per_shingle: int = 4, max_bits: int = 4, pivots: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) of each row: the smallest doc_id that links reach."""
    each = written(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = written(each.groupBy("fp").agg(F.min("doc_id").alias("least_doc")), "nodes")
    roots = written(components(links(nodes.select("fp"), max_bits, pivots=pivots)).withColumnRenamed("node", "fp"), "roots")
    linked = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = written(linked.groupBy("root").agg(F.min("least_doc").alias("component_id")), "component-ids")
    classes = linked.join(ids, "root").select("fp", "component_id")
    return each.join(classes, "fp").select("doc_id", "fp", "component_id")


#: Minimum hashes of a text: BANDS buckets of BAND_ROWS each find texts that are alike, all HASHES together say how much.
BANDS, BAND_ROWS, HASHES = 16, 3, 160
#: Standard deviations that sketches of texts just alike enough may lie beyond what is expected of them.
DEVIATIONS = 4
#: Texts of a group whose shingles a task compares with those of as many others.
COMPARED = 1024


def distinct_shingles(texts: list[bytes | None], words_per_shingle: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    return [np.unique(np.array(shingle_hashes(t, words_per_shingle), dtype="<u8")) for t in texts]


def sketch_batch(texts: list[bytes | None], words_per_shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the distinct shingles of each text: their digest, fingerprint, and minimum hashes under fixed multipliers."""
    from xxhash import xxh64_intdigest as digest

    odd = np.random.default_rng(SEED).integers(1, 1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    ids, fps, least = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64), np.zeros((len(texts), len(odd)), np.uint64)
    rows, sets, many = [], [], 0
    for i, text in enumerate(texts):
        found = distinct_shingles([text], words_per_shingle)[0]
        ids[i] = digest(found.tobytes(), SEED)
        if len(found):
            rows.append(i), sets.append(found)
            many += len(found)
        if rows and (many >= UNPACK or i == len(texts) - 1):
            h, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
            fps[rows] = _fingerprints(starts, h)
            for k, m in enumerate(odd):
                least[rows, k] = np.minimum.reduceat(h * m, starts)
            rows, sets, many = [], [], 0
    return ids, fps, least


def sketch_bounds(similarity: float) -> tuple[int, int]:
    """The most different bits and the fewest equal minimum hashes of texts of that similarity, but for DEVIATIONS.

    Sets of equal size and Jaccard similarity s have a cosine of 2s / (1 + s); a bit of their
    fingerprints differs with the share that their angle has of a half turn.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    bits = 64 * share + DEVIATIONS * np.sqrt(64 * share * (1 - share))
    equal = HASHES * similarity - DEVIATIONS * np.sqrt(HASHES * similarity * (1 - similarity))
    return int(np.ceil(bits)), int(equal)


def near_copies(rows: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, pivots: int = 16, block: int = 4096) -> DataFrame:
    """(row, root) of ``rows`` (row, text) that have a near copy; equal roots are one group.

    At a similarity of 0.8 fingerprints differ in more bits than equal blocks can find, so buckets are
    bands of minimum hashes, which texts so alike share almost surely. In a bucket the pivots, the
    distance and the minimum hashes discard pairs that can hardly be so alike. What they leave falls
    into rough groups, within which the share of equal shingles itself decides. Texts with the same
    shingles are one node throughout.
    """
    schema = "row long, id long, fp long, sign binary, bands array<long>"
    max_bits, least_equal = sketch_bounds(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest as digest

        for batch in slices(batches):
            ids, fps, least = sketch_batch(pc.cast(batch.column("text"), pa.binary()).to_pylist(), words_per_shingle)
            sign = np.ascontiguousarray((least >> np.uint64(40)).astype(np.uint8))
            bands = np.array([[digest(least[i, b * BAND_ROWS : (b + 1) * BAND_ROWS].tobytes(), b) for b in range(BANDS)] for i in range(len(fps))], dtype=np.uint64).reshape(len(fps), BANDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(ids.view(np.int64)), pa.array(fps.view(np.int64)), pa.array([x.tobytes() for x in sign], pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size * BANDS + 1, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))],
                names=["row", "id", "fp", "sign", "bands"],
            )

    def with_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = distinct_shingles(pc.cast(batch.column("text"), pa.binary()).to_pylist(), words_per_shingle)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("fp"), batch.column("sign"), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "fp", "sign", "shingles"])

    sketched = written(map_batches(rows.select("row", "text"), run, schema), "sketches")
    nodes = sketched.groupBy("id").agg(F.min("fp").alias("fp"), F.min("sign").alias("sign"), F.min("bands").alias("bands"), F.min("row").alias("row"))
    nodes = written(nodes, "nodes")
    keyed = nodes.select("id", F.posexplode("bands").alias("mask", "bits")).select("mask", "bits", "id")
    rough = written(components(links_in_buckets(keyed, nodes.select("id", "fp", "sign"), max_bits, pivots, least_equal, block)).withColumnRenamed("node", "id"), "rough-groups")
    grouped = written(nodes.select("id", "fp", "sign", "row").join(rough.select("id"), "id"), "grouped")  # few: texts need not move where they fit a broadcast
    compared = map_batches(rows.select("row", "text").join(grouped, "row").select("id", "fp", "sign", "text"), with_shingles, "id long, fp long, sign binary, shingles binary")
    keyed = rough.select(F.lit(0).alias("mask"), F.col("root").alias("bits"), "id")
    found = components(links_in_buckets(keyed, compared, max_bits, pivots, least_equal, min(block, COMPARED), similarity))
    roots = written(found.withColumnRenamed("node", "id"), "roots")
    each = sketched.select("row", "id")
    # written before it is met, so that the rows of a text that very many share can be split
    copied = written(each.groupBy("id").agg(F.count("*").alias("n")).join(roots, "id", "left").filter("n > 1 or root is not null"), "copied")
    return each.join(copied, "id").select("row", F.coalesce("root", "id").alias("root"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group of near copies, its least doc_id (a null last, then the first read). Texts without words are copies of each other."""
    name = fresh_name(docs, "row")
    rows = numbered(docs, name)
    groups = near_copies(rows.select(F.col(name).alias("row"), "text"), **options)
    ranked = rows.select(F.col(name).alias("row"), "doc_id").join(groups, "row")
    ranked = written(ranked.select("row", "root", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("rank")), "groups")
    kept = written(ranked.groupBy("root").agg(F.min("rank").alias("least")), "kept-copies")
    gone = ranked.join(kept, "root").filter("rank != least").select(F.col("row").alias(name))
    return rows.join(gone, name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
