"""Alignment of two tokenizers over a corpus in which each distinct text is tokenised once."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_letters, tokenizer_path
from .common import documents, id_text, stored
from .token_cache import COMMON, RANKS, TOKENIZER

PIECES = "piece_bpe_32k.model"
OUT_TEXTS = 2_000  # rows in one Arrow batch on the way back
# A lone space between signs that are no white space. Both tokenizers begin a token there: A's pattern takes such a space
# only as the first sign of a match, and of B's pieces only runs of spaces hold one behind their first sign.
CUT = re.compile(r"(?<=\S) (?=\S)")
KNOWN_PARTS, PART_LETTERS = 300_000, 64  # parts that a task keeps at most, and the longest of them
AT_ONCE, LEARN_TEXTS = 4_000, 500  # parts tokenised together, and texts whose parts are gathered


class Aligner:
    """Tokenizer A over a space and the text, tokenizer B over the text, and their common ends.

    A is a byte-level vocabulary. Its rank file gives the same ids several times faster; texts with letters
    beyond the common ones go to the full tokenizer. B puts the space itself. Special strings inside texts
    are plain text to both.
    """

    def __init__(self, file_a: str, ranks_a: str, file_b: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(file_a)
        self.full.no_truncation()
        self.full.no_padding()
        self.full.encode_special_tokens = True
        with open(ranks_a, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.odd = re.compile(f"[^{COMMON}]").search
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        byte_of = {letter: i for i, letter in enumerate(byte_letters())}
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in table]) for table in (self.bytes_a, self.bytes_b))
        # A pair of ids as one number.
        self.pair = np.dtype("<u4" if len(self.bytes_a) * len(self.bytes_b) <= 1 << 32 else "<u8")
        self.parted = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.get_piece_size()))
        number = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.names = np.array([f"{i}{sign}" for sign in ",|;" for i in number], object)
        self.known: dict[str, tuple | None] = {}

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        text_a = " " + text
        a = self.full.encode(text_a, add_special_tokens=False).ids if self.odd(text_a) else self.quick.encode_ordinary(text_a)
        return a, self.b.encode(text, num_threads=1)

    def align(self, text: str):
        """(ids of A, ids of B, which of A end a group, which of B do), or None if the text has no tokens.

        A text has no tokens if it is empty or the joined bytes of one side are not those of the text.
        """
        if not text:
            return None
        a, b = self.tokens(text)
        data = b" " + text.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != data or b"".join(map(self.bytes_b.__getitem__, b)) != data:
            return None
        a, b = np.array(a), np.array(b)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        last_a = end_b[np.searchsorted(end_b, end_a)] == end_a
        last_b = end_a[np.searchsorted(end_a, end_b)] == end_b
        return a, b, last_a, last_b

    def measured(self, parts: list[str]) -> list[tuple] | None:
        """(number of A, number of B, groups as text, packed links) of parts that a text holds with a space between them.

        Groups are ``a1,a2|b1;a3|b2,b3;``, with the sign at the end. None if the text has no tokens.
        """
        found = self.align(" ".join(parts))
        if found is None:
            return None
        a, b, last_a, last_b = found
        size, n = len(self.names) // 3, np.arange
        stop_a, stop_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
        name = np.empty(len(a) + len(b), np.int64)
        name[n(len(a)) + np.append(0, stop_b)[np.cumsum(last_a) - last_a]] = a + size * last_a
        name[n(len(b)) + stop_a[np.cumsum(last_b) - last_b]] = b + 2 * size * last_b
        names = self.names[name].tolist()
        links = (a[last_a].astype(self.pair) * self.pair.type(len(self.bytes_b)) + b[last_b].astype(self.pair)).tobytes()
        ends = np.cumsum([len(x.encode()) + 1 for x in parts])
        cut_a, cut_b = (np.append(0, np.searchsorted(np.cumsum(size[ids]), ends) + 1) for size, ids in ((self.size_a, a), (self.size_b, b)))
        cut_link = (np.append(0, np.cumsum(last_a))[cut_a] * self.pair.itemsize).tolist()
        cut_name, n_a, n_b = (cut_a + cut_b).tolist(), np.diff(cut_a).tolist(), np.diff(cut_b).tolist()
        return [
            (n_a[k], n_b[k], "".join(names[cut_name[k]:cut_name[k + 1]]), links[cut_link[k]:cut_link[k + 1]])
            for k in range(len(parts))
        ]

    def learn(self, parts: set[str]) -> None:
        """Tokenise short parts, many at once; those with letters beyond the common ones apart, for the full tokenizer."""
        plain, odd = [], []
        for x in parts:
            if len(x) <= PART_LETTERS and x == x.strip():
                (odd if self.odd(x) else plain).append(x)
        for own in (plain, odd):
            for at in range(0, len(own), AT_ONCE):
                some = own[at:at + AT_ONCE]
                found = self.measured(some)
                if found is None:  # one of them has no tokens
                    found = [(self.measured([x]) or [None])[0] for x in some]
                self.known.update(zip(some, found))

    def measures(self, texts: list[str]) -> Iterator[tuple | None]:
        """As ``measured`` for each text as a whole, None if it has no tokens.

        Groups end at cuts, so those of the parts between, one after the other, are those of the text; parts
        recur, and are tokenised once while they are known.
        """
        split = []
        for text in texts:
            parts = text.split()
            split.append(parts if " ".join(parts) == text else CUT.split(text))
        for at in range(0, len(texts), LEARN_TEXTS):
            wanted = set().union(*split[at:at + LEARN_TEXTS])
            new = wanted.difference(self.known)
            if len(self.known) + len(new) > KNOWN_PARTS:
                self.known, new = {}, wanted
            if self.parted:
                self.learn(new)
            for text, parts in zip(texts[at:at + LEARN_TEXTS], split[at:at + LEARN_TEXTS]):
                rows = [self.known.get(x) for x in parts]
                if None in rows:  # long parts, parts with white space at an end, parts without tokens
                    rows = [row or (self.measured([x]) or [None])[0] for x, row in zip(parts, rows)] if self.parted else [None]
                if None in rows:
                    rows = text and self.measured([text])
                if not rows:
                    yield None
                    continue
                n_a, n_b, groups, links = zip(*rows)
                yield sum(n_a), sum(n_b), "".join(groups), b"".join(links)


def aligned_texts(docs: DataFrame, file_a: str, ranks_a: str, file_b: str) -> DataFrame:
    """One row per distinct text with tokens: text_sha256, copies, n_a, n_b, n_groups, groups_sha256, links.

    The shuffle is by full text; copies are counted before it, so a text in a third of all rows meets as one row per task.
    ``links`` packs the linked id pairs, in order, as numbers a * (size of B) + b.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(file_a, ranks_a, file_b)
        for batch in batches:
            rows, (digests, texts, copies) = [], (batch.column(i).to_pylist() for i in range(3))
            for digest, n, found in zip(digests, copies, aligner.measures(texts)):
                if found is not None:
                    n_a, n_b, groups, links = found
                    # A group has one link.
                    rows.append((digest, n, n_a, n_b, len(links) // aligner.pair.itemsize, hashlib.sha256(groups[:-1].encode()).hexdigest(), links))
            for at in range(0, len(rows), OUT_TEXTS):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[at:at + OUT_TEXTS])], COLUMNS)

    COLUMNS = ["text_sha256", "copies", "n_a", "n_b", "n_groups", "groups_sha256", "links"]
    distinct = docs.where("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    named = distinct.select(content_name("text"), "text", "copies")
    schema = "text_sha256 string, copies long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary"
    return stored(named.mapInArrow(work, schema), "aligned")


def content_name(text: str):
    return F.sha2(F.encode(text, "UTF-8"), 256).alias("text_sha256")


def pair_counts(aligned: DataFrame, dtype: np.dtype, size_b: int) -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold a pair, copies included.

    Two linked tokens end together, so the bytes of one end with those of the other: the number of pairs
    is bounded by the vocabularies (``most_pairs``), however large the corpus.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, sizes = unpacked(batch.column(1), dtype)
            pairs, at = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, at, np.repeat(batch.column(0).to_numpy(), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

    counts = aligned.select("copies", "links").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return counts.select(F.floor(F.col("pair") / size_b).alias("a_id"), (F.col("pair") % size_b).alias("b_id"), "n")


def most_pairs(aligner: Aligner) -> int:
    """How many id pairs have bytes of which one ends with the other."""
    def suffixes(longer: list[bytes], shorter: list[bytes], equal: bool) -> int:
        count: dict[bytes, int] = {}
        for x in shorter:
            count[x] = count.get(x, 0) + 1
        return sum(count.get(x[i:], 0) for x in longer for i in range(0 if equal else 1, len(x)))

    return suffixes(aligner.bytes_a, aligner.bytes_b, True) + suffixes(aligner.bytes_b, aligner.bytes_a, False)


def unpacked(lists: pa.Array, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of packed numbers, one after the other, and how many each row has."""
    packed = lists.to_pylist()
    return np.frombuffer(b"".join(packed), dtype), np.array([len(x) // dtype.itemsize for x in packed], np.int64)


def link_measures(aligned: DataFrame, counts: DataFrame, dtype: np.dtype, size_b: int) -> DataFrame:
    """Adds n_links, n_best and count_sum to the texts; ``counts`` goes to every task, bounded by the vocabularies."""
    best = counts.groupBy("b_id").agg(F.max("n").alias("best"))
    known = counts.join(best, "b_id").select((F.col("a_id") * size_b + F.col("b_id")).alias("pair"), "n", (F.col("n") == F.col("best")).alias("top"))
    known = known.toArrow().sort_by("pair")
    table = aligned.sparkSession.sparkContext.broadcast(tuple(known.column(c).to_numpy() for c in ("pair", "n", "top")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, top = table.value
        for batch in batches:
            pairs, sizes = unpacked(batch.column(5), dtype)
            at = np.searchsorted(keys, pairs.astype(np.int64))
            ends = np.cumsum(sizes)
            total = lambda values: pa.array(np.diff(np.append(0, np.cumsum(values))[np.append(0, ends)]).astype(np.int64))
            sums = [total(np.ones(len(at), np.int64)), total(top[at].astype(np.int64)), total(n[at])]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + sums, COLUMNS)

    COLUMNS = ["text_sha256", "n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
    schema = "text_sha256 string, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long"
    return aligned.select("text_sha256", "n_a", "n_b", "n_groups", "groups_sha256", "links").mapInArrow(work, schema)


def token_alignment(docs: DataFrame, file_a: str, ranks_a: str, file_b: str) -> DataFrame:
    """Measures of every document, from those of its distinct text.

    Null and empty texts, and texts that a tokenizer changes, have zeros and an empty groups_sha256. Repeated
    rows give repeated rows, each counted in the corpus. Texts are named by SHA-256 when measures return
    to their documents. An empty table gives an empty result.
    """
    aligner = Aligner(file_a, ranks_a, file_b)
    dtype, size_b = aligner.pair, len(aligner.bytes_b)
    aligned = aligned_texts(docs, file_a, ranks_a, file_b)
    measures = link_measures(aligned, pair_counts(aligned, dtype, size_b), dtype, size_b)
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return docs.select("doc_id", content_name("text")).join(measures, "text_sha256", "left").select(
        "doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def token_groups(docs: DataFrame, file_a: str, ranks_a: str, file_b: str) -> DataFrame:
    """doc_id and the groups themselves: an array of (ids of A, ids of B); empty where a text has no tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(file_a, ranks_a, file_b)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = aligner.align(text)
                parts = [] if found is None else [
                    [x.tolist() for x in np.split(ids, np.flatnonzero(last)[:-1] + 1)] for ids, last in zip(found[:2], found[2:])]
                out.append([{"a": a, "b": b} for a, b in zip(*parts)])
            kinds = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kinds)], ["doc_id", "groups"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, groups array<struct<a: array<int>, b: array<int>>>")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Byte-level and piece vocabulary aligned over all documents."""
    return token_alignment(id_text(documents(spark, sf_dir)), *map(tokenizer_path, (TOKENIZER, RANKS, PIECES)))
