"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rolecall.session import ensure_checkpoint_dir, scratch_path

#: Text handled at once inside a task, a little under a power of two; one longer document is handled alone.
BLOCK_BYTES = 1_000_000
#: Rows and bytes that go to a Python worker at once, at most (a longer row goes alone).
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20

pa.set_memory_pool(pa.system_memory_pool())  # gives freed batches back at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: cuts lineage, survives lost executors.

    The write's own shuffle files are dropped when it ends; nothing reads them again.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = scratch_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size where it is larger: whole texts are long rows."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(re.sub(r"\D", "", str(spark.conf.get(key))) or 0) <= most:
            spark.conf.set(key, str(most))


#: Rows of a few numbers each that may be broadcast; more are joined by a shuffle.
FEW_ROWS = 300_000


def staged_few(df: DataFrame, name: str) -> DataFrame:
    """`staged`, marked for broadcast where the write counted at most FEW_ROWS rows."""
    seen = Observation()
    table = staged(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return F.broadcast(table) if (seen.get.get("rows") or 0) <= FEW_ROWS else table


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of text in the whole table; sizes the number of buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def keep_ids(df: DataFrame, ids: DataFrame, key: str, broadcast_rows: int = 500_000) -> DataFrame:
    """Rows of `df` whose key is in `ids` (distinct): broadcast up to `broadcast_rows` ids, shuffled beyond."""
    small = ids.limit(broadcast_rows + 1).count() <= broadcast_rows
    return df.join(F.broadcast(ids) if small else ids, key, "left_semi")


#: Stands for a missing doc_id where documents are ordered: after all others.
NO_ID = (1 << 63) - 1


def identified(documents: DataFrame) -> DataFrame:
    """(doc_id, sub, text): a key for every different row, ordered like doc_id, null texts empty.

    `sub` is 0 unless rows share a doc_id or have none; those are told apart, and
    ordered, by a hash of the text. Rows equal in doc_id and text keep one key.
    """
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = staged(docs.groupBy("doc_id").count().filter(f"count > 1 OR doc_id = {NO_ID}").select("doc_id"), "shared")
    if shared.isEmpty():
        return docs.select("doc_id", F.lit(0).cast("long").alias("sub"), "text")
    marked = docs.join(shared.withColumn("_many", F.lit(True)), "doc_id", "left")
    return marked.select("doc_id", F.when(F.col("_many"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long").alias("sub"), "text")


def real_id(column: str = "doc_id"):
    """The doc_id of an identified row, null again where it was missing."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias("doc_id")


def text_values(column: pa.Array) -> list[bytes]:
    """Every value's bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [v or b"" for v in column.cast(kind).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of about `limit` bytes."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def give_back() -> None:
    """Ask the C library to return freed memory, where it can: a worker is kept for later tasks."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0] .. +counts[0], starts[1] .. +counts[1], ... in one array."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)
