"""Packing of token sequences by multiway Karmarkar-Karp differencing."""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WORD_BPE, WordBpe, WordCache, tokenizer_path
from .common import SMALL_BATCH, documents, id_text, lean, lean_group, stored, tuned
from .words import chunks

CAPACITY, END_ID = 4096, 2
CHUNK_CHARS = 1 << 20  # letters of texts whose words are held at once
CACHED = 200_000  # words whose ids a task remembers before it starts afresh; no effect on results
GROUP_TOKENS = 1 << 19  # tokens that are balanced together: 128 full windows


def balance(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Multiway differencing of sizes into ``windows`` lists of item numbers.

    A partial partition is a load and a list for each window, smallest load first. Each item starts
    as one. The two of the largest spread are merged with opposing order: the fullest window
    of one meets the emptiest of the other.
    """
    heap = [(-int(sizes[i]), number, None, int(i)) for number, i in enumerate(np.argsort(-sizes, kind="stable"))]
    if windows == 1 or not heap:
        return [[i for _, _, _, i in heap], *([] for _ in range(windows - 1))]
    heapq.heapify(heap)
    if len(heap) == 1:
        return [[heap[0][3]], *([] for _ in range(windows - 1))]
    count = len(heap)
    while len(heap) > 1:
        first, other = heapq.heappop(heap), heapq.heappop(heap)
        if first[2] is None:
            first, other = other, first
        loads, lists = (first[2], first[3])
        if loads is None:
            loads, lists = [0] * (windows - 1) + [-first[0]], [[] for _ in range(windows - 1)] + [[first[3]]]
        if other[2] is None:
            # A single item meets the emptiest window, which then moves up to its place.
            load, own = loads.pop(0) - other[0], lists.pop(0)
            own.append(other[3])
            at = bisect.bisect_right(loads, load)
            loads.insert(at, load)
            lists.insert(at, own)
        else:
            merged = np.array(loads) + np.array(other[2][::-1])
            order = np.argsort(merged, kind="stable")
            both = [a + b for a, b in zip(lists, reversed(other[3]))]
            loads, lists = merged[order].tolist(), [both[i] for i in order.tolist()]
        heapq.heappush(heap, (loads[0] - loads[-1], count, loads, lists))
        count += 1
    return heap[0][3]


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Fewest windows, tried upwards from the total, in which differencing stays within capacity.

    Each item must fit a window, so that as many windows as items always succeed.
    """
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity))
    while True:
        lists = balance(sizes, windows)
        if max(int(sizes[own].sum()) for own in lists) <= capacity:
            return [own for own in lists if own]
        windows += 1


def token_pieces(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cut every document, closed by ``end_id``, at multiples of ``capacity``.

    Columns: doc_id, start, length, ids_crc32, doc_tokens. A text without tokens is one piece of
    the end id alone. Ids never leave the task that made them.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(file)
        cache = WordCache(bpe, lambda ids: ids.astype("<u4").tobytes(), CACHED)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for a, b in chunks([len(t) for t in texts], CHUNK_CHARS):
                words = [bpe.words(text) for text in texts[a:b]]
                known = cache.learn(words)
                rows = []
                for key, own in zip(ids[a:b], words):
                    data = b"".join(map(known.__getitem__, own)) + end
                    for at in range(0, len(data), step):
                        piece = data[at:at + step]
                        rows.append((key, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4))
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        lean(work), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    )


def pack_documents(docs: DataFrame, file: str, capacity: int = CAPACITY, end_id: int = END_ID,
                   group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Assign every piece to a sequence of at most ``capacity`` tokens.

    Full pieces are sequences of their own. Tails are dealt by a hash of document, start, ids and row, so that rows
    without an id and repeated rows are spread like others, into groups of about ``group_tokens`` tokens, whose number follows the input, and each group is
    balanced by itself. A sequence never spans groups. Empty tables give empty results; repeated
    rows are packed as often as they come. Added columns: sequence_id, offset.
    """
    tuned(docs.sparkSession, SMALL_BATCH)
    pieces = stored(token_pieces(docs, file, capacity, end_id), "pieces")
    tails = pieces.where(F.col("length") < capacity)
    total = tails.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def assign(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", ignore_index=True)
        sizes = own["length"].to_numpy()
        window, offset = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for number, members in enumerate(pack(sizes, capacity)):
            window[members] = number
            offset[members] = np.cumsum(sizes[members]) - sizes[members]
        return own.assign(window=window, offset=offset)

    kind = pieces.schema["doc_id"].dataType.simpleString()
    plain = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    dealt = tails.withColumn("deal", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("deal").applyInPandas(lean_group(assign), f"{plain}, deal long, window long, offset long")
    # Sequence ids: even ones for packed windows, odd ones for full pieces, both from (group or
    # partition, number inside), so that no global numbering is needed.
    packed = packed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("deal") * F.lit(1 << 33) + F.col("window") * 2).alias("sequence_id"), "offset",
    )
    full = pieces.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.monotonically_increasing_id() * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return packed.unionByName(full)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 4096 tokens."""
    return pack_documents(id_text(documents(spark, sf_dir)), tokenizer_path(WORD_BPE))
