"""Helpers shared by the training-data operators: tables, shared folders, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns into numpy arrays at a time.
CHUNK_BYTES = 2_000_000

#: The same in the operators of the pipeline, whose arrays take some hundred bytes for each byte of text: by then a long-lived
#: executor's heap has grown to its limit, and its Python workers have to do with the rest.
FINE_BYTES = 400_000

#: Bytes of an Arrow batch on its way to a Python worker, and the rows of it that a worker takes at a time.
ARROW_BYTES, PIECE_ROWS = 8 << 20, 1024

#: Largest table (rows, and bytes as JSON) that an operator may broadcast; beyond it the same join is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 2_000_000, 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``, read by Spark whatever the file system."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and all runs on this machine (tests) a
    temporary folder is made and set as the checkpoint folder; a cluster without
    the setting is an error, as its executors wouldn't see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folia-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/folia/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str, *partition_by: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at the files, which any executor can read."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results through Hadoop's file system."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows, which is all it reads, and those at most ``size`` bytes written out."""
    n, held = df.limit(rows + 1).agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n <= rows and (held or 0) <= size


def looked_up(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key, however many rows of ``left`` share a key.

    ``right`` is written first. If it is small it is broadcast and ``left`` doesn't move; else both sides are plain
    shuffles of stored rows, so that adaptive execution splits a key with many rows of ``left`` over several tasks.
    """
    table = stored(right, "looked-up")
    return left.join(F.broadcast(table) if small_enough(table, rows) else table, on, how)


def held_out(mod: int, remainder: int, doc_id: Column | str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with memory bounded by bytes: Arrow batches of at most ARROW_BYTES leave the JVM, a worker
    takes PIECE_ROWS rows of them at a time, and hands freed memory back after each piece.

    Sets the session's ``spark.sql.execution.arrow.maxBytesPerBatch`` where it is larger.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key, None)
    if now is None or not now.lower().rstrip("b").isdigit() or int(now.lower().rstrip("b")) > ARROW_BYTES:
        conf.set(key, f"{ARROW_BYTES}b")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = _trimmer()
        for batch in batches:
            for at in range(0, batch.num_rows, PIECE_ROWS) or (0,):
                yield batch.slice(at, PIECE_ROWS)
            pa.default_memory_pool().release_unused()
            trim(0)

    return df.mapInArrow(lambda batches: run(pieces(batches)), schema)


def _trimmer() -> Callable[[int], object]:
    """The C library's way to return free memory to the system, where it has one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def slices(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts with about ``limit`` bytes together; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)
