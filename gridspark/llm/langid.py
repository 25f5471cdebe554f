"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, free_shuffles, stored

ORDER = 3  # bytes of the longest context
FOLDS, HELD_FOLD = 4, 2
UNKNOWN = "und"
PAD = b"\n" * ORDER  # stands before each text, so that every byte has a full context
BLOCK = 1 << 20


def blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about a megabyte together; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, each after a pad, as one array; and where each text starts and ends."""
    data = np.frombuffer(PAD + PAD.join(texts) if texts else b"", np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + ORDER)
    return data, ends - sizes, ends


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, gram, n: how often each byte follows each three bytes. ``gram`` holds four bytes, oldest first.

    Each task adds up its own counts, so that at most one row for a gram and language leaves it.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, list] = {}

        def settle(lang: str) -> None:
            grams, counts = zip(*found[lang])
            grams, counts = np.concatenate(grams), np.concatenate(counts)
            order = np.argsort(grams, kind="stable")
            grams, counts = grams[order], counts[order]
            first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, np.int64)
            found[lang] = [(grams[first], np.add.reduceat(counts, first) if len(first) else counts)]

        for batch in batches:
            for lang, own in batch.groupby("lang")["text"]:
                texts = [text.encode() for text in own]
                for a, b in blocks(texts):
                    data, starts, ends = padded(texts[a:b])
                    word = data.astype(np.uint32)
                    grams = word[:-3] << 24 | word[1:-2] << 16 | word[2:-1] << 8 | word[3:]
                    inside = np.zeros(len(data) + 1, np.int8)
                    np.add.at(inside, starts, 1)
                    np.add.at(inside, ends, -1)
                    found.setdefault(lang, []).append(
                        np.unique(grams[np.cumsum(inside[ORDER:-1]) > 0], return_counts=True))
                    if len(found[lang]) > 16:
                        settle(lang)
        for lang in found:
            settle(lang)
            grams, counts = found[lang][0]
            yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": counts.astype(np.int64)})

    counted = docs.select("lang", "text").mapInPandas(work, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def counted_trees(grams: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages by name; and of each counted gram the number of its language, its four bytes and how often it occurs."""
    rows = grams.select("lang", "gram", "n").toArrow()
    lang = rows["lang"].combine_chunks().dictionary_encode()
    names = lang.dictionary.to_pylist() if len(rows) else []
    langs = sorted(names)
    number = np.array([langs.index(name) for name in names], np.int64)
    return langs, number[lang.indices.to_numpy()] if langs else number, rows["gram"].to_numpy().astype(np.uint32), rows["n"].to_numpy()


class FrozenTrees:
    """Code lengths of each byte in each context, for every language.

    A context node with N counts of q different bytes codes a byte seen n times with n / (N + q)
    and an escape with q / (N + q), after which the next shorter context is asked; below the empty
    context all 256 bytes are alike. A language that has not met a context starts at a shorter one.
    Every counted context is held. For each order ``grams`` has the sorted strings (context and byte) that occur in any
    language and ``cost[order][language]`` their code lengths; ``contexts`` and ``escape`` serve bytes that no language has seen there.
    Size follows the strings that occur.
    """

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.grams, self.cost, self.contexts, self.escape = [], [], [], []
        for order in range(ORDER + 1):
            own = gram & np.uint32((1 << 8 * (order + 1)) - 1)
            grams, at = np.unique(own, return_inverse=True)
            contexts, place = np.unique(grams >> np.uint32(8), return_inverse=True)
            below = np.searchsorted(self.grams[-1], grams & np.uint32((1 << 8 * order) - 1)) if order else None
            cost = np.empty((len(langs), len(grams)), np.float32)
            escape = np.zeros((len(langs), len(contexts) + 1), np.float32)  # the last one stands for contexts nobody has met
            for i in range(len(langs)):
                mine = lang == i
                seen = np.bincount(at[mine], n[mine], len(grams))
                total, kinds = np.bincount(place, seen, len(contexts)), np.bincount(place, seen > 0, len(contexts))
                shorter = self.cost[-1][i, below] if order else np.float32(8.0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    escape[i, :-1] = np.where(total == 0, 0, -np.log2(kinds / (total + kinds)))
                    cost[i] = np.where(seen > 0, -np.log2(seen / (total + kinds)[place]), shorter + escape[i, place])
            self.grams.append(grams)
            self.cost.append(cost)
            self.contexts.append(contexts)
            self.escape.append(escape)

    @classmethod
    def of(cls, state: dict) -> FrozenTrees:
        """From the plain arrays that were broadcast."""
        trees = cls.__new__(cls)
        trees.__dict__.update(state)
        return trees

    def bits(self, gram: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Bits of the last byte of each gram under each language, one row for a language."""
        if order < 0:
            return np.full((len(self.langs), len(gram)), 8.0, np.float32)
        own = gram & np.uint32((1 << 8 * (order + 1)) - 1)
        grams, contexts = self.grams[order], self.contexts[order]
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        out = self.cost[order][:, at]
        unseen = np.flatnonzero(grams[at] != own)
        if len(unseen):
            context = own[unseen] >> np.uint32(8)
            at = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            at[contexts[at] != context] = len(contexts)
            out[:, unseen] = self.bits(gram[unseen], order - 1) + self.escape[order][:, at]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        for a, b in blocks(texts):
            data, starts, ends = padded(texts[a:b])
            word = data.astype(np.uint32)
            # Equal grams are looked up once; one more stands behind the last text, where no sum reads.
            gram, cell = np.unique(np.append(word[:-3] << 24 | word[1:-2] << 16 | word[2:-1] << 8 | word[3:], word[:1]), return_inverse=True)
            bounds = np.stack([starts - ORDER, ends - ORDER], 1).reshape(-1)
            for i, cost in enumerate(self.bits(gram)):
                sums = np.add.reduceat(cost[cell], bounds, dtype=np.float64)[::2]
                out[a:b, i] = np.where(ends > starts, sums, 0)
        return out


def train(docs: DataFrame) -> FrozenTrees | None:
    """Frozen trees from columns lang and text; null languages and null texts teach nothing. None without rows."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    trees = counted_trees(stored(gram_counts(rows), "grams"))
    free_shuffles(docs.sparkSession)
    return FrozenTrees(*trees) if trees[0] else None


def identify(docs: DataFrame, model: FrozenTrees | None) -> DataFrame:
    """Add lang_pred and score to doc_id, text and held_out.

    The language with the shortest code wins, ties go to the first by name; score is its share of
    the posterior under equal priors. Null texts, texts without letters and all texts of an empty model get
    ``und`` and 0.
    """
    frozen = docs.sparkSession.sparkContext.broadcast(vars(model) if model else None)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = FrozenTrees.of(frozen.value) if frozen.value else None
        for batch in batches:
            texts = [t if t is not None and trees and any(map(str.isalpha, t)) else "" for t in batch["text"]]
            named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if trees:
                bits = trees.lengths([t.encode() for t in texts])
                winner = bits.argmin(1)
                share = 1 / np.exp2(np.minimum(0, bits.min(1, keepdims=True) - bits)).sum(1)
                named = [trees.langs[w] if t else UNKNOWN for t, w in zip(texts, winner)]
                score = np.where([bool(t) for t in texts], share, 0.0)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "lang_pred": named, "score": score})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "held_out", "text").mapInPandas(
        work, f"doc_id {kind}, held_out boolean, lang_pred string, score double"
    )


def op8_langid(spark, sf_dir: str) -> DataFrame:
    """Language of every text; the fold with remainder 2 is never learned from."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", fold(F.col("doc_id"), FOLDS) == HELD_FOLD)
    return identify(docs, train(docs.where(~F.col("held_out"))))
