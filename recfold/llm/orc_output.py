"""Token ids in ORC files: stripes of run-length encoded integers, row indexes, Bloom filters on doc_id.

Files hold ascending doc_id ranges in the order of their names, each sorted. ORC encodes integer
columns with run lengths, keeps the least and greatest doc_id of every stripe and row group, and a
Bloom filter for each, so a reader takes stripes in parallel and skips those that cannot hold a
document. ``part`` and ``local_start`` give a document's place: the ids of all documents before it are
those of the parts before its own, which one small sum over the files' metadata columns yields.

Nulls: a null text is an empty text; a null doc_id sorts first. Repeated rows are written once each,
those with equal doc_id by length and hash of the text. A very long text is one row. Further columns
are ignored, whatever their names. An empty table gives files without rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import crc32_u32, list_array, list_parts, map_batches, only, slices

#: Rows after which a writer looks whether its stripe is full: they may be long.
CHECK_ROWS = 500
SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_orc(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, stripe_bytes: int = 64 << 20, index_rows: int = 10_000, false_positives: float = 0.01) -> None:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = tokens.encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            ids, offsets = tokens.with_end(*enc.encode(batch.column("text")), end_id)
            n = len(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, part), pa.int32()), batch.column("doc_id").cast(pa.int64()), pa.array(offsets[:-1] + before), pa.array(np.diff(offsets)), list_array(ids.view(np.int32), offsets, pa.int32())],
                names=["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            before += int(offsets[-1])

    ranged = only(docs, "doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.length("text"), F.xxhash64("text"))
    writer = map_batches(ranged, encode, SCHEMA).write.mode("overwrite")
    for key, value in {"orc.compress": "ZSTD", "orc.stripe.size": stripe_bytes, "orc.row.index.stride": index_rows, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": false_positives, "orc.rows.between.memory.checks": CHECK_ROWS}.items():
        writer = writer.option(key, str(value))
    writer.orc(path)


def read_orc(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; filters on doc_id reach the stripes' metadata."""
    return spark.read.schema(SCHEMA).orc(path)


def part_starts(rows: DataFrame) -> DataFrame:
    """The number of ids in the parts before each: one row per file."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from what the files hold."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = list_parts(batch.column("ids"))
            found = [crc32_u32(values[a:b].view(np.uint32)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield batch.drop_columns(["ids", "n_tokens"]).append_column("n_tokens", pa.array(np.diff(offsets).astype(np.int64))).append_column("ids_crc32", pa.array(found, pa.int64()))

    light = map_batches(rows, crc, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return light.join(part_starts(rows), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
