"""Benchmark passages in training text, found through a positional inverted index."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text, stored
from .words import cut_words, ranges

WINDOW = 10
QUERY_WORDS = 200_000  # words of items that are searched in one pass: what a pass sends to tasks
PIECE_WORDS = 1_000  # longer items are cut, with an overlap of a window less one word
OPEN = 1 << 20  # places that are compared at once
TERM_ROWS = 50_000  # index rows in one Arrow batch
SPAN = 1 << 33  # more than any word number of a block

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BYTES = np.arange(256)
IS_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
TO_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

MATCHES = "block long, doc_no int, doc_id {kind}, item_id string, start long, stop long"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def build_index(docs: DataFrame) -> DataFrame:
    """Positional index of doc_id and text, written to the shared folder.

    A block is a batch of whole documents, as Spark hands them out (bounded in rows and bytes; a longer
    text is a block of its own). Each row holds the places of one term in one block: ``n`` word numbers
    as 32-bit differences. Word numbers run through the block and skip one between documents, so no phrase
    crosses a border. So a term in a third of all rows is spread over all blocks. The row with the empty term
    lists the documents of the block and their word counts. Texts without words have count 0;
    repeated rows are documents of their own; an empty table has an empty index.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            ids, texts = batch.column(0), batch.column(1)
            listed = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            words, counts = cut_words(texts, IS_WORD, TO_LOWER)
            block = part << 32 | number
            # mapInArrow hands out id arrays of its own type; lists of them keep it.
            head = [pa.array([block]), pa.array([""]), pa.array([len(ids)]), pa.array([None], pa.binary()),
                    listed(ids), listed(pa.array(counts))]
            yield pa.RecordBatch.from_arrays(head, NAMES)
            coded = words.dictionary_encode()
            terms = coded.dictionary.cast(pa.binary()).cast(pa.string())
            codes = coded.indices.to_numpy()
            places = np.arange(len(codes)) + np.repeat(np.arange(len(counts)), counts)
            order = np.argsort(codes, kind="stable")
            sizes = np.bincount(codes, minlength=len(terms))
            ends = np.cumsum(sizes)
            steps = np.diff(places[order], prepend=0)
            steps[ends - sizes] = places[order][ends - sizes]
            steps = steps.astype("<u4")
            for at in range(0, len(terms), TERM_ROWS):
                own = slice(at, at + TERM_ROWS)
                n = sizes[own]
                offsets = np.append(0, np.cumsum(n) * 4).astype(np.int32)
                data = steps[ends[at] - sizes[at]:ends[own][-1]]
                lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), block)), terms[own], pa.array(n), lists,
                     pa.nulls(len(n), pa.list_(ids.type)), pa.nulls(len(n), pa.list_(pa.int64()))], NAMES)

    NAMES = ["block", "term", "n", "places", "doc_ids", "doc_words"]
    schema = f"block long, term string, n long, places binary, doc_ids array<{kind}>, doc_words array<long>"
    return stored(docs.select("doc_id", "text").mapInArrow(work, schema), "positions")


def indexed_documents(index: DataFrame) -> DataFrame:
    """block, doc_no, doc_id, n_words of every document of an index."""
    listed = index.where("term = ''").select("block", F.posexplode(F.arrays_zip("doc_ids", "doc_words")).alias("doc_no", "own"))
    return listed.select("block", "doc_no", F.col("own.doc_ids").alias("doc_id"), F.col("own.doc_words").alias("n_words"))


def item_pieces(items: DataFrame, overlap: int) -> DataFrame:
    """item_id, words: items in pieces of at most PIECE_WORDS words that share ``overlap`` words; none for items without words."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    step = PIECE_WORDS - overlap
    count = F.greatest(F.ceil((F.size("words") - F.lit(overlap)) / F.lit(step)), F.lit(1)).cast("int")
    return words.select("item_id", "words", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        "item_id", F.slice("words", F.col("piece") * step + 1, PIECE_WORDS).alias("words"))


def query_passes(pieces: DataFrame) -> Iterator[list]:
    """Lists of pieces of at most QUERY_WORDS words, read from the cluster one partition after the other."""
    batch, size = [], 0
    for row in pieces.toLocalIterator():
        if batch and size + len(row.words) > QUERY_WORDS:
            yield batch
            batch, size = [], 0
        batch.append(row)
        size += len(row.words)
    if batch:
        yield batch


def search(index: DataFrame, items: DataFrame, overlap: int, prepare: Callable, find: Callable) -> DataFrame:
    """Matches of items: rows (block, doc_no, doc_id, item_id, start, stop), words from start up to before stop.

    Items are the stated queries: each pass broadcasts at most QUERY_WORDS of their words, keeps the index rows of these
    terms and brings those of one block together. ``prepare`` turns (pieces, number of each term) into
    arrays; ``find`` gets those and the block's lists.
    """
    spark = index.sparkSession
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    found = spark.createDataFrame([], MATCHES.format(kind=kind))
    for batch in query_passes(item_pieces(items, overlap)):
        number = {term: i for i, term in enumerate(sorted({w for row in batch for w in row.words}))}
        names = sorted({row.item_id or "" for row in batch})
        of_item = {name: i for i, name in enumerate(names)}
        asked = spark.sparkContext.broadcast((names, prepare([(of_item[r.item_id or ""], [number[w] for w in r.words]) for r in batch])))
        terms = spark.createDataFrame([("", -1), *number.items()], "term string, term_no int")
        lists = index.join(F.broadcast(terms), "term").select("block", "term_no", "places", "doc_ids", "doc_words")
        found = found.unionByName(lists.groupBy("block").applyInPandas(_in_block(asked, find), MATCHES.format(kind=kind)))
    return found


def _in_block(asked, find: Callable) -> Callable:
    def work(own: pd.DataFrame) -> pd.DataFrame:
        names, queries = asked.value
        own = own.sort_values("term_no", ignore_index=True)
        ids, sizes = own["doc_ids"][0], np.asarray(own["doc_words"][0], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        lists = [np.cumsum(np.frombuffer(p, "<u4").astype(np.int64)) for p in own["places"][1:]]
        present = own["term_no"].to_numpy()[1:].astype(np.int64)
        keys = np.concatenate([t * SPAN + p for t, p in zip(present, lists)]) if lists else np.zeros(0, np.int64)
        item, start, stop = find(queries, keys)
        doc = np.searchsorted(first, start, "right") - 1
        inside = stop <= (first + sizes)[doc]  # a stretch over the end of its document is none
        item, doc, start, stop = merged(item[inside], doc[inside], start[inside], stop[inside])
        return pd.DataFrame({
            "block": np.full(len(doc), own["block"][0]), "doc_no": doc.astype(np.int32), "doc_id": pd.Series([ids[d] for d in doc], dtype=object),
            "item_id": pd.Series([names[i] for i in item], dtype=object),
            "start": start - first[doc], "stop": stop - first[doc],
        })

    return work


def merged(item: np.ndarray, doc: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Overlapping or touching spans of one item in one document become one span."""
    order = np.lexsort((start, doc, item))
    item, doc, start, stop = item[order], doc[order], start[order], stop[order]
    group = np.cumsum(np.r_[True, (np.diff(item) != 0) | (np.diff(doc) != 0)]) if len(item) else item
    # Adding a multiple of SPAN for each group keeps the running maximum inside groups.
    reach = np.maximum.accumulate(stop + group * SPAN) - group * SPAN
    new = np.r_[True, (np.diff(group) != 0) | (start[1:] > reach[:-1])] if len(item) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(item)) - 1 if len(head) else head
    return item[head], doc[head], start[head], reach[tail]


def list_sizes(keys: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the list of each term begins among the keys, and how long it is."""
    low = np.searchsorted(keys, terms.astype(np.int64) * SPAN)
    return low, np.searchsorted(keys, (terms.astype(np.int64) + 1) * SPAN) - low


def phrase_matches(index: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Where ``window`` consecutive words of an item occur in a document; shorter items count as one window.

    Items without words match nothing. Overlapping matches of an item in a document become one span.
    Equal item ids count as one item; a null id as the empty name.
    """
    def prepare(pieces):
        item, size, terms = [], [], []
        for number, words in pieces:
            for at in range(max(1, len(words) - window + 1)):
                own = words[at:at + window]
                item.append(number)
                size.append(len(own))
                terms.append(own + [-1] * (window - len(own)))
        return np.array(item, np.int64), np.array(size, np.int64), np.array(terms, np.int64)

    def find(queries, keys):
        item, size, terms = queries
        low, n = list_sizes(keys, terms)
        n = np.where(terms < 0, SPAN, n)
        live = np.flatnonzero(n.min(axis=1) > 0)
        order = np.argsort(n, axis=1, kind="stable")  # the rarest term of a window first, the pad last
        rare = order[live, 0]
        begin, many = low[live, rare], n[live, rare]
        out = []
        for own in split(many, OPEN):
            at = np.repeat(np.arange(own.start, own.stop), many[own])
            window_no = live[at]
            begins = keys[ranges(begin[own], many[own])] % SPAN - rare[at]
            for step in range(1, window):
                shift = order[window_no, step]
                term = terms[window_no, shift]
                wanted = term * SPAN + begins + shift
                place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                # A window that begins before the first word would look into the list of another term.
                keep = (term < 0) | ((keys[place] == wanted) & (begins >= 0))
                window_no, begins = window_no[keep], begins[keep]
            keep = begins >= 0
            out.append((window_no[keep], begins[keep]))
        window_no, begins = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2
        return item[window_no], begins, begins + size[window_no]

    return search(index, items, window - 1, prepare, find)


def proximity_matches(index: DataFrame, items: DataFrame, within: int) -> DataFrame:
    """Stretches of at most ``within`` words of a document that hold every distinct word of an item, in any order.

    A stretch begins and ends with a word of the item; overlapping ones become one span. Items are taken in
    pieces of PIECE_WORDS words, so longer ones match by pieces. Items without words match nothing.
    """
    def prepare(pieces):
        return [(number, np.unique(words)) for number, words in pieces]

    def find(queries, keys):
        last = np.append(keys, np.iinfo(np.int64).max)
        out = []
        for item, terms in queries:
            low, n = list_sizes(keys, terms)
            if len(terms) > within or not n.all():
                continue
            rare = int(np.argmin(n))
            begin = np.unique((keys[low[rare]:low[rare] + n[rare]] % SPAN)[:, None] - np.arange(within))
            for own in split(np.full(len(begin), len(terms)), OPEN):
                start = begin[own][begin[own] >= 0]
                nexts = last[np.searchsorted(keys, terms[None, :] * SPAN + start[:, None])] - terms[None, :] * SPAN
                near, far = nexts.min(axis=1), nexts.max(axis=1)
                keep = (near == start) & (far < start + within)
                out.append((np.full(keep.sum(), item), start[keep], far[keep] + 1))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    return search(index, items, 0, prepare, find)


def split(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of consecutive entries whose sizes sum up to about ``most``."""
    total = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield slice(at, end)
        at = end


def contamination_report(index: DataFrame, matches: DataFrame) -> DataFrame:
    """Per indexed document: n_words, n_hit words inside any match, n_items, item_ids and contaminated."""
    spans = F.array_sort(F.collect_list(F.struct("start", "stop")))
    covered = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda seen, span: F.struct(
            F.greatest(seen["upto"], span["stop"]).alias("upto"),
            (seen["n"] + F.greatest(F.lit(0).cast("long"), span["stop"] - F.greatest(seen["upto"], span["start"]))).alias("n")),
        lambda seen: seen["n"],
    )
    found = matches.groupBy("block", "doc_no").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    docs = indexed_documents(index).join(found, ["block", "doc_no"], "left")
    return docs.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def op13_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of ten words of any benchmark item."""
    index = build_index(id_text(documents(spark, sf_dir)))
    report = contamination_report(index, phrase_matches(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")))
    return report.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"), "contaminated",
    )


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS size, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), grams AS (
  SELECT rid, size, i, array_to_string(w[i:i + size - 1], ' ') AS k
  FROM (SELECT d.*, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows))
), hits AS (
  SELECT rid, i, size, item_id FROM grams JOIN windows USING (k, size)
), counted AS (
  SELECT rid, count(DISTINCT place) AS n_hit
  FROM (SELECT rid, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT rid, i, size FROM hits)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS name FROM hits) GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN counted USING (rid) LEFT JOIN items USING (rid)
"""
