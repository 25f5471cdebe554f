"""Exact deduplication as a stream with disk-backed keyed state that never expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from gridspark.session import scratch

from .common import documents, free_shuffles, stored, tuned

WHITE_SPACE = r"[\x20\x09-\x0D]+"
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # The memory of all stores of an executor together.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Each store would otherwise reserve megabytes of disk for files that stay small.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
MICRO_BATCHES = 3  # over a table that lies still; a living source has its own triggers


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def content_digest(text_col: str) -> Column:
    return F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256)


def content_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_hex: int = 64,
                 locator: Column | None = None) -> DataFrame:
    """doc_id, content, text_sha256, digest, n_points, locator of each row, batch or stream.

    ``locator`` says where the content lies; without one the id has to find it. ``digest_hex`` shortens the
    digest that keys the state; tests use it to provoke collisions.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(
        F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content"),
        F.char_length(text).alias("n_points"), (F.lit(None).cast("string") if locator is None else locator).alias("locator"),
    )
    sha = F.sha2(F.encode("content", "UTF-8"), 256)
    return found.withColumn("text_sha256", sha).withColumn("digest", F.substring("text_sha256", 1, digest_hex))


def best(*fields: str) -> Column:
    """Of the rows of a group: most code points, then smallest id (a null id last)."""
    return F.min_by(F.struct("doc_id", *fields), F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id"))


def stream_groups(keys: DataFrame, place: str, available_now: bool = True) -> DataFrame:
    """Keep, for each digest ever seen, the row that stays, where its content lies, and how many rows had it.

    ``keys`` is a stream of ``content_keys``. State is keyed by the digest, lies in RocksDB on the
    executors' disks with its log in ``place``, and has no watermark: it never expires. Rows with one digest
    are combined before the shuffle, so a text that many rows share is no hot key. A later call with
    the same place goes on where the last one stopped. Each batch writes the changed groups under
    its number, so a batch that is repeated overwrites itself; the last batch of a digest holds.
    """
    spark = keys.sparkSession
    for key, value in STATE.items():
        spark.conf.set(key, value)
    state = keys.groupBy("digest").agg(best("n_points", "locator").alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = f"{place}/groups"

    def save(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{groups}/batch={number}")

    query = (
        state.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", f"{place}/state")
        .trigger(**({"availableNow": True} if available_now else {"processingTime": "10 seconds"})).start()
    )
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(groups)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], state.schema)
    written = spark.read.option("basePath", groups).schema(StructType([*state.schema.fields, StructField("batch", IntegerType())])).parquet(groups)
    return written.groupBy("digest").agg(
        F.max_by("keep", "batch").alias("keep"), F.max_by("group_size", "batch").alias("group_size")
    )


def verified(docs: DataFrame, keys: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             digest_hex: int = 64) -> DataFrame:
    """One row for each row of ``keys``: doc_id, keep_id, group_size, kept, text_sha256.

    A hit is a row whose digest other rows have too. The full content of every hit is compared with the
    content of the row that its group keeps. A digest that joins different contents is taken apart
    by content. Rows that repeat an id and a text are members of their own, and all marked as kept if
    theirs is the one that stays.
    """
    spark = keys.sparkSession
    groups = stored(groups, "digest-groups")
    free_shuffles(spark)
    shared = groups.where("group_size > 1").select("digest", F.col("keep.doc_id").alias("keep_id"))
    wanted = keys.join(shared, "digest").select(F.col("doc_id").alias("hit_id"), "digest", "keep_id").distinct()
    # Only the texts of hits are made out after the join; the digest tells apart rows that share an id.
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(
        wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("hit_id")))
    content = normalised(F.col("text"))
    same = F.substring(F.sha2(F.encode(content, "UTF-8"), 256), 1, digest_hex) == F.col("digest")
    hits = stored(found.where(same).select(
        "doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n_points"), content.alias("content"), "digest", "keep_id"), "digest-hits")
    free_shuffles(spark)
    keepers = (
        hits.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.first("content").alias("kept_content"))
    )
    wrong = stored(
        hits.join(keepers, "digest").where("content <> kept_content").select("digest").distinct(), "digest-collisions"
    )
    apart = (
        hits.join(wrong, "digest").groupBy("content").agg(
            best("n_points").alias("keep"), F.count(F.lit(1)).alias("group_size"), F.first("digest").alias("digest"))
        .select(F.sha2(F.encode("content", "UTF-8"), 256).alias("text_sha256"), "digest", "keep", "group_size")
    )
    plain = keys.select("doc_id", "digest", "text_sha256")
    sound = groups.join(wrong, "digest", "left_anti").select("digest", F.col("keep.doc_id").alias("keep_id"), "group_size")
    of_sound = plain.join(sound, "digest")
    of_apart = plain.join(apart.select("digest", "text_sha256", F.col("keep.doc_id").alias("keep_id"), "group_size"), ["digest", "text_sha256"])
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    return of_sound.select(*columns).unionByName(of_apart.select(*columns))


def dedup_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                digest_hex: int = 64, micro_batches: int = MICRO_BATCHES) -> DataFrame:
    """Send a table through ``stream_groups`` and give the fate of each row.

    The keys of all rows are made in one pass over the texts and written; their files are the stream. Null
    counts as empty, and all empty texts are equal. An empty table gives an empty result.
    """
    spark = tuned(docs.sparkSession)
    place = scratch(spark, "dedup")
    content_keys(docs, id_col, text_col, digest_hex, F.input_file_name()).drop("content").write.parquet(f"{place}/keys")
    keys = spark.read.parquet(f"{place}/keys")
    files = max(1, -(-len(keys.inputFiles()) // micro_batches))
    stream = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", files).parquet(f"{place}/keys")
    return verified(docs, keys, stream_groups(stream, place), id_col, text_col, digest_hex)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Which document of each set of equal texts stays."""
    return dedup_table(documents(spark, sf_dir))


# Of equal texts the one with the most code points stays, then the smallest id.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM d WINDOW w AS (PARTITION BY content ORDER BY n DESC, doc_id)
"""
