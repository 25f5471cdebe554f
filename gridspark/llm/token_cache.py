"""Token counts with a digest cache: only contents that no run has counted before are encoded."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import scratch

from .bpe import tokenizer_path
from .common import documents, free_shuffles, id_text

TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
LIMIT = 512
CACHE_SCHEMA = "content_digest string, tokenizer_digest string, n_tokens long"
# Letters and signs on which the rank-based encoder surely cuts as the full tokenizer does.
COMMON = "\\t\\n\\x0b-\\r\\x20-\\x7e¡-¬®-ɏ–-‧…€"


def file_digest(*files: str) -> str:
    """Version of a tokenizer: digest of its files."""
    out = hashlib.sha256()
    for file in files:
        with open(file, "rb") as f:
            out.update(hashlib.sha256(f.read()).digest())
    return out.hexdigest()


def token_counter(tokenizer_file: str, ranks_file: str):
    """Text -> number of tokens, as the full tokenizer counts them.

    The rank file holds the same vocabulary and is several times faster; texts with letters beyond
    the common ones go to the full tokenizer, because the two may differ in their letter tables.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(tokenizer_file)
    full.no_truncation()
    full.no_padding()
    special = {t.content: i for i, t in full.get_added_tokens_decoder().items()}
    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    odd = re.compile(f"[^{COMMON}]").search

    def count(text: str) -> int:
        if odd(text):
            return len(full.encode(text, add_special_tokens=False).ids)
        return len(quick.encode(text, allowed_special="all"))

    return count


def read_cache(spark, cache_path: str) -> DataFrame:
    """Stored counts; an absent cache is empty."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_path)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    frame = spark.read.schema(CACHE_SCHEMA)
    return frame.parquet(cache_path) if there else spark.createDataFrame([], CACHE_SCHEMA)


def cached_counts(docs: DataFrame, cache_path: str, tokenizer_file: str, ranks_file: str, limit: int = LIMIT) -> DataFrame:
    """Token counts per document, from the cache at ``cache_path`` and additions to it.

    Contents are normalised by taking null as empty (this vocabulary has no normaliser, so any other
    change could change counts) and named by SHA-256; the tokenizer is named by the digest of its
    files. Steps: join digests to the cache; choose one row for each missing digest, with a map-side
    aggregate, so copies of a text never meet; encode those rows only; append them; join digests
    to the cache again. Repeated rows give repeated rows; an empty table gives an empty result.
    Appends are safe to repeat, since a digest read twice holds the same count.
    """
    spark = docs.sparkSession
    version = file_digest(tokenizer_file, ranks_file)
    named = docs.select(
        "doc_id", "text", F.sha2(F.encode("text", "UTF-8"), 256).alias("content_digest"),
    )
    keys = named.select("doc_id", "content_digest", F.octet_length("text").cast("long").alias("n_bytes"))
    stored = read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
    # One document speaks for each missing content; its text travels once.
    misses = (
        keys.groupBy("content_digest").agg(F.min("doc_id").alias("doc_id"))
        .join(stored.select("content_digest").distinct(), "content_digest", "left_anti")
    )
    chosen = named.join(
        misses.withColumnRenamed("doc_id", "speaker").hint("shuffle_hash"),
        F.col("doc_id").eqNullSafe(F.col("speaker")) & (named["content_digest"] == misses["content_digest"]), "left_semi",
    ).select("content_digest", "text")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(tokenizer_file, ranks_file)
        for batch in batches:
            yield pd.DataFrame({
                "content_digest": batch["content_digest"], "tokenizer_digest": version,
                "n_tokens": [count(text) for text in batch["text"]],
            })

    chosen.mapInPandas(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    del chosen, misses
    free_shuffles(spark)
    counts = (
        read_cache(spark, cache_path).where(F.col("tokenizer_digest") == version)
        .groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens"))
    )
    return keys.join(counts, "content_digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "content_digest",
    )


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts of every text under the byte vocabulary, through a cache that starts empty."""
    return cached_counts(
        id_text(documents(spark, sf_dir)), scratch(spark, "token-cache"), tokenizer_path(TOKENIZER), tokenizer_path(RANKS),
    )
