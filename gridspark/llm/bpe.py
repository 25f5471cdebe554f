"""Byte-pair encoding of whole texts by batched numpy merge rounds."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import documents, id_text

WORD_BPE = "word_bpe_49k.json"
CACHE_WORDS = 400_000  # words a task remembers before it starts afresh; no effect on results
LONG_WORD = 2_000  # bytes from which a word is merged by places of its ranks; no effect on results

# Fixed values of the vocabulary file: how it cuts a text into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same cut for texts whose only characters beyond ASCII are precomposed Latin letters.
LATIN = "À-ÖØ-öø-ſ"
PLAIN_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|[a-z{LATIN}]+|[0-9]|[^\sa-z0-9{LATIN}]+"
NOT_PLAIN = rf"[^\x09-\x0d\x20-\x7e{LATIN}]"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary with word ends. Encodes many words at once.

    The symbols of all words lie in one flat array. In each round every word merges its pair of
    lowest rank, wherever it occurs in the word from left to right. Ranks are found by binary
    search over the sorted keys ``left * size + right``.
    """

    def __init__(self, file: str):
        self.file, self.library = file, None
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: token for token, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.size = max(self.pieces) + 1
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        merges = spec["model"]["merges"]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.plain, self.full, self.odd = re.compile(PLAIN_PATTERN), regex.compile(WORD_PATTERN), re.compile(NOT_PLAIN)

    def words(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if "<|" in text:
            out = []
            for i, part in enumerate(self.split(text)):
                out += [part] if i % 2 else self._words(part)
            return out
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if not self.odd.search(text):
            return self.plain.findall(text.lower())
        if any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._library_words(text)
        # Lower case letter by letter: no special form of a final sigma.
        return self.full.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def _library_words(self, text: str) -> list[str]:
        """The cut of the library, for letters younger than the tables here."""
        if self.library is None:
            self.library = Tokenizer.from_file(self.file)
            self.byte_of = {letter: i for i, letter in enumerate(byte_letters())}
        pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in pieces]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids, and where each word ends in them. No word may be empty or special."""
        raw = [w.encode() for w in words]
        long = [i for i, w in enumerate(raw) if len(w) >= LONG_WORD]
        if not long:
            return self._encode_flat(raw)
        # One long word would keep the common rounds going for as many ranks as it has.
        apart = set(long)
        ids, ends = self._encode_flat([w for i, w in enumerate(raw) if i not in apart])
        rest = iter(np.split(ids, ends[:-1]) if len(ends) else [])
        parts = [self._encode_long(w) if i in apart else next(rest) for i, w in enumerate(raw)]
        return np.concatenate(parts), np.cumsum([len(p) for p in parts])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of ranks where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.ranks))

    def _encode_long(self, raw: bytes) -> np.ndarray:
        """Ids of one word, in time near linear in its length.

        The same rounds as for many words, but symbols stay in place, linked to their
        neighbours. Places are kept by rank, and a round looks only at the places of the
        lowest rank and searches only the pairs beside its merges.
        """
        data = np.frombuffer(raw, np.uint8)
        n, never = len(data), len(self.ranks)
        symbols = self.inner[data]
        symbols[-1] = self.last[data[-1]]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank = np.full(n + 1, never, np.int64)  # of the pair that starts at a place; merged places have none
        rank[:n - 1] = self._rank(symbols[:-1], symbols[1:])
        places, queue = {}, []

        def file(own: np.ndarray) -> None:
            own = own[rank[own] < never]
            if not len(own):
                return
            order = np.argsort(rank[own], kind="stable")
            own, ranks = own[order], rank[own[order]]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for value, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(own, cuts)):
                if value not in places:
                    places[value] = []
                    heapq.heappush(queue, value)
                places[value].append(part)

        file(np.arange(n - 1))
        while queue:
            best = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(best)))
            at = at[rank[at] == best]  # others were merged away or have new neighbours
            if not len(at):
                continue
            # In a run of equal symbols, pairs overlap: take every second one from the left.
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            symbols[at] = self.merged[best]
            rank[gone] = never
            after[at] = after[gone]
            symbols[gone] = -1
            behind = after[at]
            before[behind[behind < n]] = at[behind < n]
            touched = np.unique(np.r_[at, before[at]])
            touched = touched[touched >= 0]
            rank[touched] = never
            paired = touched[after[touched] < n]
            rank[paired] = self._rank(symbols[paired], symbols[after[paired]])
            file(paired)
        return symbols[symbols >= 0]

    def _encode_flat(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words together, in one flat array."""
        sizes = np.array([len(w) for w in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)
        if len(ends):
            symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), sizes)
        done_owner, done_symbols = [], []
        never = len(self.ranks)
        while len(symbols):
            key = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(symbols), never, np.int64)
            rank[:-1] = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], never)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            open_ = best < never
            done_owner.append(owner[~open_])
            done_symbols.append(symbols[~open_])
            hit = open_ & (rank == best)
            # In a run of equal symbols, pairs overlap: take every second one from the left.
            place = np.flatnonzero(hit)
            if not len(place):
                break
            run = np.cumsum(np.r_[True, np.diff(place) > 1]) - 1
            first = place[np.r_[True, np.diff(place) > 1]]
            place = place[(place - first[run]) % 2 == 0]
            symbols[place] = self.merged[rank[place]]
            open_[place + 1] = False
            symbols, owner = symbols[open_], owner[open_]
        owner = np.concatenate(done_owner) if done_owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate(done_symbols)[order] if done_symbols else np.zeros(0, np.int64)
        return ids, np.cumsum(np.bincount(owner, minlength=len(raw)))

    def decode(self, ids) -> str:
        """The pieces joined by one space: these vocabularies come without a decoder."""
        return " ".join([self.pieces[int(i)] for i in ids])


class WordCache:
    """word -> what ``form`` makes of its ids; unknown words of a batch are encoded together."""

    def __init__(self, bpe: WordBpe, form, cached: int = CACHE_WORDS):
        self.bpe, self.form, self.cached, self.known = bpe, form, cached, {}

    def learn(self, texts_words: list[list[str]]) -> dict:
        new = set().union(*texts_words).difference(self.known)
        if len(self.known) + len(new) > self.cached:
            self.known, new = {}, set().union(*texts_words)
        for token, i in self.bpe.special.items():
            if token in new:
                new.discard(token)
                self.known[token] = self.form(np.array([i]))
        words = list(new)
        ids, ends = self.bpe.encode(words)
        start = 0
        for word, end in zip(words, ends.tolist()):
            self.known[word] = self.form(ids[start:end])
            start = end
        return self.known


def bpe_round_trip(docs: DataFrame, file: str) -> DataFrame:
    """Encode every text, decode the ids again, return counts and digests.

    Null and empty texts have no tokens and the digest of the empty text. Equal texts give equal
    values; ids and texts of any length are whole. Special strings inside a text are one token.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(file)
        cache = WordCache(bpe, lambda ids: (" ".join(map(str, ids.tolist())), bpe.decode(ids), len(ids)))
        for batch in batches:
            words = [bpe.words(text) for text in batch["text"]]
            known = cache.learn(words)
            rows = []
            for key, own in zip(batch["doc_id"], words):
                ids, texts, counts = zip(*map(known.__getitem__, own)) if own else ((), (), ())
                rows.append((
                    key, sum(counts), hashlib.sha256(" ".join(ids).encode()).hexdigest(),
                    hashlib.sha256(" ".join(texts).encode()).hexdigest(),
                ))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        work, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def bpe_tokens(docs: DataFrame, file: str) -> DataFrame:
    """doc_id and the token ids themselves, for use outside the digest query."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = WordBpe(file)
        cache = WordCache(bpe, lambda ids: ids.tolist())
        for batch in batches:
            words = [bpe.words(text) for text in batch["text"]]
            known = cache.learn(words)
            ids = [[i for w in own for i in known[w]] for own in words]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": ids})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {kind}, ids array<int>")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every text with the word vocabulary."""
    return bpe_round_trip(id_text(documents(spark, sf_dir)), tokenizer_path(WORD_BPE))
