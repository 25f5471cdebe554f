"""Removal of repeated passages with suffix arrays by the difference-cover algorithm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.ordered import global_rank

from .common import SMALL_BATCH, documents, free_shuffles, id_text, lean, lean_group, stored, tuned
from .jaccard import BASE, INVERSE, U, mix
from .words import chunks, text_bytes

LENGTH = 100  # bytes of a string that counts as repeated
GRAM = 48  # bytes of an anchor; every string of LENGTH bytes holds one
BUCKET_ANCHORS = 300_000  # anchors that one task compares
BUCKET_BYTES = 400_000  # bytes that one task sorts the suffixes of
CHUNK_BYTES = 1 << 18  # bytes whose anchors are looked for at once
PART_BYTES = 4 << 20  # bytes whose anchors are settled before they leave the task
SPAN_BYTES = 32 << 20  # bytes of text whose removed spans one task merges
CROWD = 8  # different contexts of one anchor in a batch from which the batch settles them as candidates itself


# --- suffix order ---------------------------------------------------------------------------------

def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and the sorted keys. Small keys carry their place in one number, which sorts far faster."""
    bits, keys = len(keys).bit_length(), keys.astype(np.int64, copy=False)
    if len(keys) and int(keys.max()) < 1 << (62 - bits):
        both = np.sort(keys << bits | np.arange(len(keys)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(keys)
    return order, keys[order]


def names_of(keys: np.ndarray) -> np.ndarray:
    """Dense names in the order of the keys, from 1."""
    order, own = ordered(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[True, own[1:] != own[:-1]]) if len(keys) else 0
    return out


def smaller(keys: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of the sorted ``others`` are smaller than each key; asked in order, which is kind to caches."""
    order, own = ordered(keys)
    out = np.empty(len(keys), np.int64)
    out[order] = np.searchsorted(others, own, side="left")
    return out


def difference_cover_ranks(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each suffix of ``symbols`` (whole numbers from 0), equal only if ``depth`` symbols are equal.

    Suffixes at positions 1 and 2 modulo 3 are the cover. Their triples are sorted and named; unless all
    names differ or they already reach the depth, the string of names is ranked by recursion. Suffixes at
    positions 0 modulo 3 follow from one symbol and the rank after it. The merge needs no comparison
    by pairs: a suffix stands behind as many others as are smaller, and for each two residues there is one key that
    both know: symbol and rank (0 and 1), two symbols and rank (0 and 2), or rank (1 and 2).
    """
    n = len(symbols)
    # Symbols, names and ranks have 32 bits, for there are fewer than 2**31 of them; keys of two have 64.
    s = np.concatenate([symbols, np.zeros(3, symbols.dtype)]) if symbols.dtype == np.int64 else np.append(symbols, [0, 0, 0]).astype(np.int32)
    size = int(s.max()) + 1 if n else 1
    if size > n + 1:
        s[:n] = names_of(s[:n].astype(np.int64))
        size = int(s.max()) + 1
    s = s.astype(np.int32)
    key = lambda high, base, low: high.astype(np.int64) * base + low
    # A key holds two numbers of at most n + 1 each, never three, so it fits 63 bits at any number of symbols:
    # pairs of symbols are named first, then pair and third symbol (or rank).
    one, two, zero = (np.arange(k, n, 3, dtype=np.int32) for k in (1, 2, 0))
    cover = np.concatenate([one, two])
    names = names_of(key(names_of(key(s[cover], size, s[cover + 1])), size, s[cover + 2])).astype(np.int32)
    if depth > 3 and len(names) and int(names.max()) < len(names):
        # Zeros part the two halves, so that no triple reads from one into the other.
        deeper = difference_cover_ranks(
            np.concatenate([names[:len(one)], np.zeros(1, np.int32), names[len(one):]]), -(-depth // 3))
        names = names_of(np.concatenate([deeper[:len(one)], deeper[len(one) + 1:]]).astype(np.int64)).astype(np.int32)
        del deeper
    rank = np.zeros(n + 3, np.int32)
    rank[cover] = names
    base = int(names.max(initial=0)) + 1
    by_one = lambda i: key(s[i], base, rank[i + 1])
    ends = np.concatenate([zero, two])
    pair = np.empty(n, np.int32)
    pair[ends] = names_of(key(s[ends], size, s[ends + 1]))  # of both residues together, so that they compare
    del ends, cover
    by_two = lambda i: key(pair[i], base, rank[i + 2])
    sorted_cover = np.sort(names)
    del names
    out = np.empty(n, np.int32)
    own, other = by_one(zero), np.sort(by_one(one))
    out[zero] = smaller(own, np.sort(own)) + smaller(own, other)
    out[one] = smaller(rank[one], sorted_cover) + smaller(by_one(one), np.sort(own))
    own, other = by_two(zero), np.sort(by_two(two))
    out[zero] += smaller(own, other)
    out[two] = smaller(rank[two], sorted_cover) + smaller(by_two(two), np.sort(own))
    return out


def repeated_windows(text: np.ndarray, where: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which of the positions ``where`` start a string of ``length`` that another one of smaller ``place`` starts too.

    Positions are put in suffix order and the prefixes of neighbours are compared.
    """
    if not len(where):
        return np.zeros(0, bool)
    ranks = difference_cover_ranks(text, length)[where]
    order, _ = ordered(ranks)
    at = where[order]
    windows = np.lib.stride_tricks.sliding_window_view(text, length)
    same = np.empty(len(at), bool)
    same[0] = False
    for i in range(1, len(at), 1 << 15):
        j = min(len(at), i + (1 << 15))
        same[i:j] = (windows[at[i:j]] == windows[at[i - 1:j - 1]]).all(1)
    run = np.cumsum(~same) - 1
    first = np.full(run[-1] + 1, np.iinfo(place.dtype).max, place.dtype)
    np.minimum.at(first, run, place[order])
    out = np.empty(len(at), bool)
    out[order] = place[order] > first[run]
    return out


# --- anchors --------------------------------------------------------------------------------------

def sliding(op, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    out, k = values, 1
    while 2 * k <= width:
        out = op(out[:-k], out[k:])
        k *= 2
    return op(out[:len(out) - (width - k)], out[width - k:]) if k < width else out


class Anchors:
    """Positions that equal texts choose alike: the smallest gram of each window of strings.

    Any string of ``length`` bytes holds the smallest of its grams, so two equal strings hold an anchor with
    one fingerprint at one place. The context of an anchor reaches as far as such a string can.
    """

    def __init__(self, length: int, gram: int):
        self.length, self.gram, self.reach = length, gram, length - gram
        self.letter = mix(np.arange(1, 257, dtype=U))
        self.up = self.down = np.ones(1, U)

    def powers(self, size: int) -> None:
        if len(self.up) < size:
            size = max(size, CHUNK_BYTES)
            self.up = np.cumprod(np.r_[U(1), np.full(size - 1, BASE)])
            self.down = np.cumprod(np.r_[U(1), np.full(size - 1, INVERSE)])

    def of(self, raw: list[bytes]):
        """text number, anchor, low, high, fingerprint of the gram, digest of the context."""
        data = np.frombuffer(b"".join(raw), np.uint8)
        bounds = np.cumsum([len(r) for r in raw])
        n = len(data)
        empty = np.zeros(0, np.int64)
        if n < self.length:
            return empty, empty, empty, empty, empty.astype(U), empty.astype(U)
        self.powers(n + 1)
        sums = np.r_[U(0), np.cumsum(self.letter[data] * self.up[:n])]
        digest = lambda a, b: (sums[b] - sums[a]) * self.down[a]
        grams = mix((sums[self.gram:] - sums[:-self.gram]) * self.down[:n - self.gram + 1])
        # Texts stand side by side; windows across a border only add anchors.
        least = sliding(np.minimum, grams, self.reach + 1)
        edge = np.zeros(self.reach, U)
        chosen = np.flatnonzero(grams == sliding(np.maximum, np.concatenate([edge, least, edge]), self.reach + 1))
        text = np.searchsorted(bounds, chosen, side="right")
        begin = np.r_[0, bounds[:-1]][text]
        low, high = np.maximum(chosen - self.reach, begin), np.minimum(chosen + self.length, bounds[text])
        fit = (chosen + self.gram <= bounds[text]) & (high - low >= self.length)
        text, chosen, low, high, begin = text[fit], chosen[fit], low[fit], high[fit], begin[fit]
        context = mix(digest(low, high) ^ ((chosen - low).astype(U) << U(32)) ^ (high - low).astype(U))
        return text, chosen - begin, low - begin, high - begin, grams[chosen], context


PACKED = "bucket long, doc binary, lo binary, hi binary, left binary, q binary, z binary"
KINDS = {"doc": "<i8", "lo": "<u4", "hi": "<u4", "left": "<u1", "q": "<u8", "z": "<u8"}


def packed(bucket: np.ndarray, **columns: np.ndarray) -> pd.DataFrame:
    """One row for each bucket, with its part of every column as bytes. A shuffle then moves few, large rows."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    last = np.r_[first[1:], len(bucket)]
    out = {"bucket": bucket[first]}
    for name, kind in KINDS.items():
        values = columns[name][order].astype(kind) if name in columns else None
        out[name] = [b"" if values is None else values[a:b].tobytes() for a, b in zip(first, last)]
    return pd.DataFrame(out)


def unpacked(rows: pd.DataFrame) -> dict[str, np.ndarray]:
    return {name: np.frombuffer(b"".join(rows[name]), kind) for name, kind in KINDS.items()}


def spread(doc: np.ndarray, count: int) -> np.ndarray:
    return (mix(doc.astype(U)) % U(count)).astype(np.int64)


def settle(doc, lo, hi, left, q, z, crowd: int | None):
    """Split anchors into repeats, candidates and others still open.

    Of equal contexts the first (by document and place) stays; the others lie wholly in earlier strings:
    repeats. A fingerprint with more than one context makes those that stay candidates, whose strings have to be
    compared. With ``crowd`` (one batch among many) only crowded fingerprints become candidates, with one anchor left
    open to speak for them; the rest stays open. Returns masks: repeat, candidate, open.
    """
    order = np.lexsort((lo, doc, z, q))
    q_, z_, doc_, lo_ = q[order], z[order], doc[order], lo[order]
    new_q = np.r_[True, q_[1:] != q_[:-1]] if len(q_) else np.zeros(0, bool)
    new_z = new_q | np.r_[True, z_[1:] != z_[:-1]] if len(q_) else new_q
    first = np.maximum.accumulate(np.where(new_z, np.arange(len(q_)), 0))
    later = (doc_ != doc_[first]) | (lo_ != lo_[first])
    group = np.cumsum(new_q) - 1
    contexts = np.bincount(group, new_z) if len(q_) else np.zeros(0)
    repeat, candidate, open_ = (np.zeros(len(q_), bool) for _ in range(3))
    many = contexts[group] > (1 if crowd is None else crowd) if len(q_) else new_q
    repeat[order] = later
    candidate[order] = new_z & many
    open_[order] = new_z & (~many | new_q)
    return repeat, candidate, open_


def anchor_table(docs: DataFrame, length: int, gram: int, buckets: int, doc_buckets: int) -> DataFrame:
    """Packed rows by bucket of documents: repeats (``q`` empty) and candidates.

    Each part of PART_BYTES settles its own anchors first, so however often a passage occurs, a part sends a few
    anchors for it and no task receives more than that from each.
    """
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1)
            _, at = text_bytes(texts)
            for a, b in chunks(np.diff(at).tolist(), PART_BYTES):
                raw = [t.as_buffer().to_pybytes() for t in texts[a:b]]
                found = [pack for pack in settled(ids[a:b], raw, anchors) if len(pack)]
                del raw
                for pack in found:
                    yield pa.RecordBatch.from_pandas(pack, preserve_index=False)

    def settled(ids: np.ndarray, raw: list[bytes], anchors: Anchors) -> Iterator[pd.DataFrame]:
        parts = []
        for a, b in chunks([len(r) for r in raw], CHUNK_BYTES):
            text, at, lo, hi, q, z = anchors.of(raw[a:b])
            parts.append((ids[a:b][text], lo.astype("<u4"), hi.astype("<u4"), (at - lo).astype("<u1"), q, z))
        doc, lo, hi, left, q, z = map(np.concatenate, zip(*parts))
        repeat, candidate, open_ = settle(doc, lo, hi, left, q, z, CROWD)
        # Rows for documents have negative buckets and pass the comparison untouched.
        home = -1 - spread(doc, doc_buckets)
        yield packed(home[repeat], doc=doc[repeat], lo=lo[repeat], hi=hi[repeat])
        own = candidate
        yield packed(home[own], doc=doc[own], lo=lo[own], hi=hi[own], left=left[own], q=q[own])
        own = open_
        yield packed((q[own] % U(buckets)).astype(np.int64), doc=doc[own], lo=lo[own], hi=hi[own], left=left[own], q=q[own], z=z[own])
        # A crowded fingerprint is one that others meet as well: a second context says so.
        own = open_ & candidate
        yield packed((q[own] % U(buckets)).astype(np.int64), doc=doc[own], lo=lo[own], hi=hi[own], left=left[own], q=q[own], z=~z[own])

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        if own["bucket"].iloc[0] < 0:
            return own
        v = unpacked(own)
        repeat, candidate, _ = settle(v["doc"], v["lo"], v["hi"], v["left"], v["q"], v["z"], None)
        home = -1 - spread(v["doc"], doc_buckets)
        pick = lambda mask, *names: packed(home[mask], **{n: v[n][mask] for n in names})
        return pd.concat([pick(repeat, "doc", "lo", "hi"), pick(candidate, "doc", "lo", "hi", "left", "q")])

    return docs.select("doc_id", "text").mapInArrow(lean(find), PACKED).groupBy("bucket").applyInPandas(lean_group(compare), PACKED)


def per_document(rows: DataFrame, merge: bool) -> DataFrame:
    """doc_id with its spans; ``merge`` joins spans that touch, otherwise they keep ``left`` and ``q``."""
    def work(own: pd.DataFrame) -> pd.DataFrame:
        v = unpacked(own)
        order = np.lexsort((v["hi"], v["lo"], v["doc"])) if merge else np.lexsort((v["q"], v["lo"], v["doc"]))
        v = {name: values[order] for name, values in v.items() if len(values) == len(order)}
        doc, lo, hi = v["doc"], v["lo"].astype(np.int64), v["hi"].astype(np.int64)
        fresh = np.r_[True, doc[1:] != doc[:-1]]
        if merge:
            # Shift each document beyond the one before, then one running maximum serves all.
            number = np.cumsum(fresh) - 1
            reach = np.maximum.accumulate(hi + (number << 33)) - (number << 33)
            begin = fresh | np.r_[True, lo[1:] > reach[:-1]]
            end = np.r_[begin[1:], True]
            v = {"doc": doc[begin], "lo": v["lo"][begin], "hi": reach[end].astype("<u4")}
        else:
            keep = fresh | np.r_[True, (v["lo"][1:] != v["lo"][:-1]) | (v["q"][1:] != v["q"][:-1])]
            v = {name: values[keep] for name, values in v.items()}
        first = np.flatnonzero(np.r_[True, v["doc"][1:] != v["doc"][:-1]])
        last = np.r_[first[1:], len(v["doc"])]
        out = {"key": v["doc"][first]}
        for name in ("lo", "hi", "left", "q"):
            out[name] = [v[name][a:b].tobytes() if name in v else b"" for a, b in zip(first, last)]
        return pd.DataFrame(out)

    return rows.groupBy("bucket").applyInPandas(lean_group(work), "key long, lo binary, hi binary, left binary, q binary")


def candidate_repeats(docs: DataFrame, candidates: DataFrame, length: int, gram: int, buckets: int, doc_buckets: int) -> DataFrame:
    """Packed spans of repeats among the candidates.

    The contexts of candidates are dealt by fingerprint, so that equal strings meet; a task then sorts
    the suffixes of its contexts. All contexts of one anchor meet in one task, however many they are.
    """
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, *spans in zip(batch["key"], batch["text"], batch["lo"], batch["hi"], batch["q"]):
                data = text.encode()
                lo, hi, q = (np.frombuffer(s, k) for s, k in zip(spans, ("<u4", "<u4", "<u8")))
                target = (q % U(buckets)).astype(np.int64)
                rows += [(t, key, a, data[a:b]) for t, a, b in zip(target.tolist(), lo.tolist(), hi.tolist())]
            if rows:
                frame = pd.DataFrame(rows, columns=["bucket", "key", "lo", "text"]).sort_values("bucket", kind="stable")
                yield frame.groupby("bucket", sort=False).agg(
                    key=("key", lambda x: x.to_numpy("<i8").tobytes()), lo=("lo", lambda x: x.to_numpy("<u4").tobytes()),
                    size=("text", lambda x: x.str.len().to_numpy("<u4").tobytes()), text=("text", lambda x: b"".join(x)),
                ).reset_index()

    def compare(own: pd.DataFrame) -> pd.DataFrame:
        key, lo = np.frombuffer(b"".join(own["key"]), "<i8"), np.frombuffer(b"".join(own["lo"]), "<u4").astype(np.int64)
        size = np.frombuffer(b"".join(own["size"]), "<u4").astype(np.int64)
        data = np.frombuffer(b"".join(own["text"]), np.uint8)
        # Symbols from 1; strings need no gaps, because only windows inside them are asked for.
        begin = np.cumsum(size) - size
        count = size - length + 1
        string = np.repeat(np.arange(len(size), dtype=np.int32), count)
        inside = (np.arange(len(string)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        order = np.lexsort((lo[string] + inside, key[string])).astype(np.int32)
        doc, at = key[string[order]], lo[string[order]] + inside[order]
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]) if len(order) else 0
        del doc, at
        found = np.flatnonzero(repeated_windows(data, (begin[string] + inside).astype(np.int32), place, length)[order])
        own = order[found]
        doc, at = key[string[own]], lo[string[own]] + inside[own]
        if not len(doc):
            return packed(np.zeros(0, np.int64))
        # Windows that overlap or touch in one document make one span.
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)]
        first, last = np.flatnonzero(fresh), np.r_[np.flatnonzero(fresh)[1:], len(doc)] - 1
        return packed(-1 - spread(doc[first], doc_buckets), doc=doc[first], lo=at[first], hi=at[last] + length)

    wanted = per_document(candidates, merge=False)
    texts = docs.select(F.col("doc_id").alias("key"), "text").join(wanted.hint("shuffle_hash"), "key")
    return texts.mapInPandas(lean(cut), "bucket long, key binary, lo binary, size binary, text binary").groupBy("bucket").applyInPandas(lean_group(compare), PACKED)


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """key (the document), lo and hi: packed bounds of the byte spans that earlier strings cover.

    ``docs`` has doc_id (whole numbers) and text without nulls; rows without an id are left out. Rows with one id
    have one text (see ``keyed``) and count as one document. Works in three steps, each a shuffle of packed rows:

    1. Anchors: about one byte in 25, chosen by content, each with a digest of its context. Equal contexts
       keep their first; whatever occurs once at its anchor is left aside.
    2. The contexts that share an anchor but are not equal, the borders of repeats, are dealt by anchor and
       their suffixes sorted with a difference cover; neighbours that share ``length`` bytes are repeats.
    3. Spans of one document are merged.
    """
    spark = tuned(docs.sparkSession, SMALL_BATCH)
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    doc_buckets = max(1, total // SPAN_BYTES)
    buckets = max(1, 2 * total // (length - gram + 2) // BUCKET_ANCHORS)
    table = stored(anchor_table(docs, length, gram, buckets, doc_buckets), "anchors")
    free_shuffles(spark)
    candidates = table.where(F.octet_length("q") > 0)
    strings = candidates.agg(F.sum(F.octet_length("q") / 8)).first()[0] or 0
    sort_buckets = max(1, int(strings * (2 * length - gram)) // BUCKET_BYTES)
    borders = stored(candidate_repeats(docs, candidates, length, gram, sort_buckets, doc_buckets), "borders")
    free_shuffles(spark)
    repeats = table.where(F.octet_length("q") == 0).unionByName(borders)
    spans = stored(per_document(repeats, merge=True), "spans").select("key", "lo", "hi")
    free_shuffles(spark)
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``__key__``, equal exactly for rows of one id and one text, in the order of the ids.

    It is the id itself. Only if some id has different texts, every pair of id and text (named by SHA-256) gets
    its rank among all pairs, from a range sort. Null ids have no key.
    """
    named = docs.withColumn("__key__", F.col("doc_id").cast("long"))
    mark = F.struct(F.xxhash64("text"), F.octet_length("text"))
    several = named.where("__key__ is not null").groupBy("__key__").agg(F.min(mark).alias("a"), F.max(mark).alias("b")).where("a <> b")
    if several.isEmpty():
        return named
    named = named.withColumn("__content__", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256))
    pairs = named.where("__key__ is not null").select(F.col("__key__").alias("__own__"), F.col("__content__").alias("__other__")).distinct()
    ranks = stored(global_rank(pairs, ["__own__", "__other__"], "__rank__"), "pairs")
    same = (F.col("__key__") == F.col("__own__")) & (F.col("__content__") == F.col("__other__"))
    return named.join(ranks, same, "left").select(*docs.columns, F.col("__rank__").cast("long").alias("__key__"))


def with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Every row of ``docs`` with a struct column ``__spans__`` (lo, hi), null where nothing goes."""
    named = keyed(docs)
    texts = named.select(F.col("__key__").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = repeated_spans(texts, length, gram).select(F.col("key").alias("__spans_of__"), F.struct("lo", "hi").alias("__spans__"))
    return named.join(own.hint("shuffle_hash"), F.col("__key__") == F.col("__spans_of__"), "left").drop("__spans_of__", "__key__")


def kept_parts(data: bytes, lo: np.ndarray, hi: np.ndarray) -> bytes:
    edges = [0, *np.stack([lo, hi], 1).reshape(-1).tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def whole_letters(data: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans drawn in to the borders of UTF-8 letters."""
    tail = (np.frombuffer(data + b"a", np.uint8) & 0xC0) == 0x80
    lo, hi = lo.astype(np.int64), hi.astype(np.int64)
    while tail[lo].any():
        lo = lo + tail[lo]
    while tail[hi].any():
        hi = hi - tail[hi]
    return lo, np.maximum(lo, hi)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``docs`` (doc_id, text, any others) with each text less its repeated spans, drawn in to whole letters.

    A null text stays null; a text that consists of repeats becomes empty and its row stays. Of rows with one id and
    different texts, the order of their digests says which is the earlier one.
    """
    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.DataFrame) -> pd.Series:
        out = []
        for own, lo, hi in zip(text, spans["lo"], spans["hi"]):
            if own is not None and lo is not None:
                data = own.encode()
                own = kept_parts(data, *whole_letters(data, np.frombuffer(lo, "<u4"), np.frombuffer(hi, "<u4"))).decode()
            out.append(own)
        return pd.Series(out, dtype=object)

    return with_spans(docs, length, gram).withColumn("text", cut("text", "__spans__")).select(*docs.columns)


def removal_report(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row. Texts shorter than ``length`` lose nothing."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, lo, hi in zip(batch["doc_id"], batch["text"], batch["lo"], batch["hi"]):
                data, removed, spans = text.encode(), 0, 0
                kept = data
                if lo is not None:
                    lo, hi = np.frombuffer(lo, "<u4"), np.frombuffer(hi, "<u4")
                    kept, removed, spans = kept_parts(data, lo, hi), int(hi.sum(dtype=np.int64) - lo.sum(dtype=np.int64)), len(lo)
                rows.append((key, len(data), removed, spans, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_spans(texts, length, gram).select("doc_id", "text", "__spans__.lo", "__spans__.hi").mapInPandas(
        lean(work), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What stays of every text when strings of 100 bytes that occur earlier are removed."""
    return removal_report(id_text(documents(spark, sf_dir)))
