"""What the operators share: the shared folder, written tables and Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Of a written table: what a writer holds in memory before it writes.
ROW_GROUP_BYTES = 32 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Files whose numbers are broadcast.
MOST_FILES = 50_000
#: Bytes of text that a worker holds results of at a time.
SLICE_BYTES = 3 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a temporary one on a single machine, an error on a cluster."""
    path = spark.conf.get(CHECKPOINT_DIR, None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError(f"{CHECKPOINT_DIR} must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="recfold-")
        spark.conf.set(CHECKPOINT_DIR, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it again."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and nothing reads any more, and let Spark drop the shuffle files of finished steps."""
    jvm = spark.sparkContext._jvm
    for df in tables:
        path = jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()  # shuffle files go when the driver finds their plans unreachable


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` is columns of Parquet files as they are."""
    nodes = [line.strip(" :+-") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]
    return all(n.startswith("Project") or n.startswith("Relation") and n.endswith("parquet") for n in nodes if n) and not any("rand" in n or "uuid" in n for n in nodes)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number ``name`` for each row that means the same row in every later read.

    Rows of Parquet files are numbered by file and place in the file, which no other split of the
    files changes. Anything else, or a table of very many files, is written first.
    """
    if is_scan(df):
        files = df.select(df.metadataColumn("_metadata")["file_path"]).distinct().limit(MOST_FILES + 1).collect()
        if 0 < len(files) <= MOST_FILES:
            file, nth, place = (fresh_name(df, x) for x in ("numbered_file", "numbered_nth", "numbered_place"))
            numbers = df.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(sorted(files))], f"{file} string, {nth} long")
            held = df.metadataColumn("_metadata")
            placed = df.select("*", held["file_path"].alias(file), held["row_index"].alias(place))
            number = F.shiftleft(nth, 44) + F.col(place)
            return placed.join(F.broadcast(numbers), file).select(*(F.col(f"`{c}`") for c in df.columns), number.alias(name))
    return written(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone: further columns of the input can't clash with an operator's own."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with this package on the workers' path: they may start in another folder than the driver."""
    env = df.sparkSession.sparkContext.environment
    if PACKAGE_ROOT not in (paths := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":  # the default: as many long texts as that fill a worker's memory
        conf.set(BATCH_ROWS, "1000")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(bounded, schema)


def trim() -> None:
    """Give freed memory back: a worker lives on after its task, and another operator may follow."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where there is no such library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + most, side="right")))
            yield batch.slice(a, b - a)
            a = b


def gathered(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches pool[first : first + size], one after another."""
    ends = np.cumsum(size)
    return pool[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def crc32_u32(values: np.ndarray) -> int:
    """CRC-32 of the values as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(values, dtype="<u4"))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def list_parts(col: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of a list column, whatever slice of its buffers it is."""
    offsets = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], offsets - offsets[0]
