"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.bpe import WORD_BPE, tokenizer_path
from gridspark.llm.common import id_text
from gridspark.llm.exact_dedup import content_digest, dedup_table
from gridspark.llm.jaccard import similar_classes
from gridspark.llm.packing import pack_documents
from gridspark.llm.suffix_dedup import keyed, without_repeats
from gridspark.llm.toxicity import without_toxic
from gridspark.session import configure, scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half stay; the classifier learns from the table of labels."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents equal but for white space the longest stays. Rows that repeat id and text stay together."""
    fate = dedup_table(docs).where("kept").select(F.col("doc_id").alias("__kept_id__"), F.col("text_sha256").alias("__kept_content__")).distinct()
    named = docs.withColumn("__content__", content_digest("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__kept_id__")) & (F.col("__content__") == F.col("__kept_content__"))
    return named.join(fate.hint("shuffle_hash"), same, "left_semi").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents that share four fifths of their five-word shingles the first stays."""
    named = keyed(docs)  # rows of one id and different texts are documents of their own
    classes = similar_classes(id_text(named, "__key__"), words=5, num=80, den=100)
    gone = classes.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone__"))
    return named.join(gone.hint("shuffle_hash"), F.col("__key__") == F.col("__gone__"), "left_anti").select(*docs.columns)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that an earlier document, or the same one earlier, holds are cut out."""
    return without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens."""
    return pack_documents(id_text(docs), tokenizer_path(WORD_BPE))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("packing", packing),
]

# Scores, classes by similarity and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        place = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return STAGES[-1][1](spark, docs, sf_dir)
