"""What the text operators share: inputs, tuning, hashing of folds, freeing shuffle files."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.session import scratch

# A batch handed to Python holds at most so many rows and bytes, so that very long texts do
# not gather in one batch.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


SMALL_BATCH = BATCH | {"spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def tuned(spark: SparkSession, batch: dict = BATCH) -> SparkSession:
    for key, value in batch.items():
        spark.conf.set(key, value)
    return spark


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` for a task whose process stays for later tasks: what it used goes back to the system at its end."""
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        gc.collect()
        give_back()

    return run


def lean_group(work: Callable) -> Callable:
    """The same for the function of one group."""
    def run(own):
        out = work(own)
        give_back()
        return out

    return run


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so that no other name can clash."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(id_col.cast("string"), F.lit("")), "UTF-8")) % folds


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames nobody holds any more.

    Call it after a checkpoint or a write has made earlier shuffles useless.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    place = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)
