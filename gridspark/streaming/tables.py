"""An upsert table as a base and deltas, so that reads cost its live rows and not its history.

Every micro-batch writes one row per key to a folder of its own and then commits it with a
row in ``manifest``; compaction writes a new base in the same order. What is not in the
manifest does not exist, so a crash between writing and committing neither loses nor
doubles a row: the stream repeats the batch, and its folder is rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

MANIFEST = "kind string, upto bigint"


def _committed(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """Last batch inside the base (-1 if none) and the batches after it.

    The driver sees one number per batch since the last compaction.
    """
    marks = spark.read.option("ignoreMissingFiles", "true").schema(MANIFEST).parquet(f"{path}/manifest/*")
    base = marks.filter("kind = 'base'").agg(F.coalesce(F.max("upto"), F.lit(-1).cast("bigint"))).first()[0]
    later = marks.filter((F.col("kind") == "delta") & (F.col("upto") > base)).select("upto").distinct()
    return base, sorted(r[0] for r in later.collect())


def _commit(spark: SparkSession, path: str, kind: str, upto: int) -> None:
    """One small file whose name is fixed by what it commits: repeating it changes nothing."""
    mark = spark.createDataFrame([(kind, upto)], MANIFEST).coalesce(1)
    mark.write.mode("overwrite").parquet(f"{path}/manifest/{kind}-{upto}")


def create(spark: SparkSession, path: str) -> None:
    """An empty table; harmless on one that exists."""
    _commit(spark, path, "base", -1)


def _last(df: DataFrame, key: str, order: Column) -> DataFrame:
    row = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(row, F.struct(order, "_batch")).alias("_r")).select(key, "_r.*")


def _rows(spark: SparkSession, path: str, schema: StructType, base: int, deltas: list[int]) -> DataFrame:
    places = ([f"{path}/base-{base}"] if base >= 0 else []) + [f"{path}/delta-{b}" for b in deltas]
    full = StructType([*schema.fields, StructField("_batch", LongType())])
    return spark.read.schema(full).parquet(*places) if places else spark.createDataFrame([], full)


def current(spark: SparkSession, path: str, schema: StructType, key: str, order: Column) -> DataFrame:
    """Per key the last row by ``order``; of equal ones that of the later batch."""
    return _last(_rows(spark, path, schema, *_committed(spark, path)), key, order).drop("_batch")


def compact(spark: SparkSession, path: str, schema: StructType, key: str, order: Column) -> int:
    """Fold all committed deltas into a new base; returns the last batch it holds.

    Readers see the old base and deltas until the new base is committed. Replaced folders
    stay for readers that still use them.
    """
    base, deltas = _committed(spark, path)
    if not deltas:
        return base
    _last(_rows(spark, path, schema, base, deltas), key, order).write.mode("overwrite").parquet(f"{path}/base-{deltas[-1]}")
    _commit(spark, path, "base", deltas[-1])
    return deltas[-1]


def upsert_table(path: str, key: str, order: Column, every: int = 16) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: one delta per batch, a new base after each ``every`` of them.

    A batch that is committed already is skipped. Batches come in rising order, as a stream gives them.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id == 0:
            create(spark, path)
        base, deltas = _committed(spark, path)
        if batch_id <= base or batch_id in deltas:
            return
        _last(batch.withColumn("_batch", F.lit(batch_id).cast("bigint")), key, order).write.mode("overwrite").parquet(f"{path}/delta-{batch_id}")
        _commit(spark, path, "delta", batch_id)
        if len(deltas) + 1 >= every:
            compact(spark, path, batch.schema, key, order)

    return write
