"""Toxicity of texts whose words may be disguised: noisy-channel restoration, then a word classifier."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, fold, lean, stored, tuned

FOLDS, HELD_FOLD = 5, 0
TRAIN_ROWS = 40_000  # labelled rows that the classifier is fitted on at most, chosen by a hash of the id
MAX_FEATURES = 50_000  # features that the classifier holds at most, the strongest
MIN_SUPPORT = 3
PREFIXES = (4, 5, 6)
CACHE_TOKENS = 400_000  # tokens a task remembers before it starts afresh; no effect on results

# Signs that stand for letters.
SIGNS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "€": "e", "(": "c", "*": "aeiou",
}
# Costs of the channel in nats: a sign read as a letter, a sign kept, a repeat dropped, a gap closed or kept.
SIGN_READ, SIGN_KEPT, REPEAT_DROPPED, GAP_CLOSED, GAP_KEPT = 1.0, 9.0, 0.7, 0.5, 3.0
BOUNDARY = "\n"
LETTERS = BOUNDARY + "".join(map(chr, [*range(97, 123), *(c for c in range(0xDF, 0x180) if chr(c).isalpha() and chr(c).islower())]))

_SIGN = re.escape("".join(SIGNS))
SUSPECT = re.compile(rf"(?=.*[^\W\d_])(?:.*[{_SIGN}]|.*([^\W\d_])\1\1)", re.S)
SPACED = re.compile(rf"(?<![^\s])(?:[^\W_][ ._*\-])(?:[^\W_{_SIGN}]|[{_SIGN}])(?:[ ._*\-](?:[^\W_]|[{_SIGN}]))+(?![^\s.,;:?!])")
# What every match of SPACED holds behind its first character; led by a separator, so quick to rule out.
GAPS = re.compile(rf"[ ._*\-](?<![^\s]..)(?<=[^\W_].)(?:[^\W_{_SIGN}]|[{_SIGN}])[ ._*\-](?:[^\W_]|[{_SIGN}])")
EDGE = ".,;:?\"'()[]{}<>«»“”„…"


def spaced(text: str) -> list[str]:
    """Stretches of single characters with gaps between them."""
    return [m.group() for m in SPACED.finditer(text)] if GAPS.search(text) else []


class CharModel:
    """Trigram model over lower-case letters, interpolated with bigrams and letters."""

    def __init__(self, trigrams: dict[int, int]):
        size = len(LETTERS)
        self.code = {c: i for i, c in enumerate(LETTERS)}
        self.size = size
        self.three = trigrams
        self.two_base: Counter = Counter()
        self.two: Counter = Counter()
        self.one: Counter = Counter()
        for key, n in trigrams.items():
            self.two_base[key // size] += n
            self.two[key % (size * size)] += n
            self.one[key % size] += n
        self.one_base: Counter = Counter()
        for key, n in self.two.items():
            self.one_base[key // size] += n
        self.total = sum(self.one.values())
        self.known: dict[tuple, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """Nats of ``c`` after ``a`` and ``b``; a letter outside the alphabet counts as a boundary."""
        key = (a, b, c)
        found = self.known.get(key)
        if found is None:
            i, j, k = (self.code.get(x, 0) for x in key)
            size = self.size
            p = (self.one[k] + 0.5) / (self.total + 0.5 * size)
            p = (self.two[j * size + k] + 2 * p) / (self.one_base[j] + 2)
            p = (self.three.get((i * size + j) * size + k, 0) + 2 * p) / (self.two_base[i * size + j] + 2)
            found = self.known[key] = -math.log(p)
        return found


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each character, or run of one letter, the strings it may stand for, with channel costs."""
    out, at = [], 0
    while at < len(token):
        char, end = token[at], at + 1
        while end < len(token) and token[end] == char:
            end += 1
        count = end - at
        if char in " ._-":
            out.append([("", GAP_CLOSED), (" ", GAP_KEPT)])
        elif char in SIGNS:
            for _ in range(count):
                out.append([(c, SIGN_READ) for c in SIGNS[char]] + [(char, SIGN_KEPT)])
                if char == "*":
                    out[-1].append(("", GAP_CLOSED + SIGN_READ))
        elif count > 2:
            out.append([(char, REPEAT_DROPPED), (char * 2, REPEAT_DROPPED), (char * 3, 2 * REPEAT_DROPPED)])
        else:
            out.append([(char * count, 0.0)])
        at = end
    return out


def restore(token: str, model: CharModel) -> str:
    """The likeliest reading of a lower-case token: Viterbi over its lattice, states being two letters.

    Work and memory follow the length of the token: readings are kept as back pointers.
    """
    best = {(BOUNDARY, BOUNDARY): (0.0, None)}
    known, cost_of = model.known, model.cost
    for choices in [*lattice(token), [(BOUNDARY, 0.0)]]:
        after: dict = {}
        for (a, b), (cost, path) in best.items():
            for text, channel in choices:
                total, x, y = cost + channel, a, b
                for c in text:
                    total += known.get((x, y, c)) or cost_of(x, y, c)
                    x, y = y, (BOUNDARY if c == " " else c)
                state = (x, y)
                other = after.get(state)
                if other is None or total < other[0]:
                    after[state] = (total, (path, text))
        best = after
    _, path = min(best.values(), key=lambda v: v[0])
    parts = []
    while path:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts)).strip()


def char_counts(docs: DataFrame) -> dict[int, int]:
    """Trigram counts of all texts. The alphabet is fixed, so at most ``len(LETTERS) ** 3`` rows come back."""
    size = len(LETTERS)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(0x180, np.uint32)
        for i, c in enumerate(LETTERS):
            table[ord(c)] = i
        keys, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        for batch in batches:
            rest = ["\n\n" + t.lower() + "\n" for t in batch["text"] if t]
            while rest:
                part, size_ = [], 0
                while rest and size_ < 1 << 20:
                    part.append(rest.pop())
                    size_ += len(part[-1])
                points = np.frombuffer("".join(part).encode("utf-32-le"), "<u4")
                code = table[np.where(points < len(table), points, 0)]
                found, n = np.unique((code[:-2] * size + code[1:-1]) * size + code[2:], return_counts=True)
                keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        yield pd.DataFrame({"gram": keys.astype(np.int64), "n": counts})

    rows = docs.select("text").mapInPandas(lean(work), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    return dict(zip(rows["gram"].tolist(), rows["n"].tolist()))


class Reader:
    """Texts to distinct restored words; remembers up to ``cached`` tokens it has seen."""

    def __init__(self, model: CharModel, cached: int = CACHE_TOKENS):
        self.model, self.known, self.cached = model, {}, cached

    def words(self, token: str) -> tuple[str, ...]:
        """Plain words of a token; if it looks disguised, those of its restored form as well."""
        found = self.known.get(token)
        if found is None:
            plain = token.strip(EDGE + "!*")
            forms = [plain] if plain else []
            if SUSPECT.match(token):  # from the start: what holds later in a token holds there
                read = restore(token.strip(EDGE).rstrip("!"), self.model)
                forms += [w for w in read.split(" ") if w and w != plain]
            found = tuple(forms)
            if self.cached:
                if len(self.known) >= self.cached:
                    self.known.clear()
                self.known[token] = found
        return found

    def distinct(self, text: str) -> set[str]:
        text = text.lower()
        out = set()
        for token in set(text.split()):
            out.update(self.words(token))
        for stretch in spaced(text):
            out.update(restore(stretch, self.model).split(" "))
        return out


def features(word: str) -> list[str]:
    """The word itself and its beginnings, so that inflected forms share evidence."""
    return [word, *(word[:n] + "~" for n in PREFIXES if len(word) > n)]


def labelled(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Texts of at most ``rows`` labelled documents outside the held-out fold; that bounds the broadcast."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_FOLD))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, trigrams: dict[int, int], rows: int = TRAIN_ROWS) -> dict:
    """Weights of the words and beginnings that tell toxic texts from others beyond chance.

    A feature counts once for a text. It is held if at least MIN_SUPPORT texts have it and its likelihood
    ratio statistic exceeds what the best of so many features would reach by chance; a logistic
    regression then weighs the held ones together. Without labels of both kinds none is held.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trigrams)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counts = Reader(CharModel(shared.value)), (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                own = set()
                for word in reader.distinct(text or ""):
                    own.update(features(word))
                counts[int(toxic)].update(own)
                counts[int(toxic)][""] += 1
        names = list(counts[0].keys() | counts[1].keys())
        for at in range(0, len(names), 50_000):
            part = names[at:at + 50_000]
            yield pd.DataFrame({"feature": part, "t": [counts[1][f] for f in part], "c": [counts[0][f] for f in part]})

    counted = (
        labelled(docs, labels, rows).mapInPandas(lean(work), "feature string, t long, c long")
        .groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") + F.col("c") >= MIN_SUPPORT)
    )
    counted = stored(counted, "features")
    whole = counted.where("feature = ''").first()
    n_toxic, n_clean = (whole["t"], whole["c"]) if whole else (0, 0)
    if not n_toxic or not n_clean:
        return {"weights": {}, "bias": -3.0}
    tested = counted.count()
    t, c = F.col("t"), F.col("c")
    total = float(n_toxic + n_clean)

    def part(seen, of, having):
        expected = having * (of / total)
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    have, lack = t + c, F.lit(total) - t - c
    statistic = 2 * (
        part(t, n_toxic, have) + part(c, n_clean, have)
        + part(F.lit(n_toxic) - t, n_toxic, lack) + part(F.lit(n_clean) - c, n_clean, lack)
    )
    held = (
        counted.where("feature <> ''").select("feature", statistic.alias("g"))
        .where((F.col("g") > 2 * math.log(max(tested, 2)) + 2) & (t * n_clean > c * n_toxic))
        .orderBy(F.desc("g"), "feature").limit(MAX_FEATURES).toPandas()["feature"].tolist()
    )
    number = {feature: i for i, feature in enumerate(held)}
    shared_held = docs.sparkSession.sparkContext.broadcast((trigrams, number))

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, numbers = shared_held.value
        reader = Reader(CharModel(counts))
        for batch in batches:
            own = [
                sorted({numbers[f] for w in reader.distinct(text or "") for f in features(w) if f in numbers})
                for text in batch["text"]
            ]
            yield pd.DataFrame({"toxic": batch["toxic"], "own": own})

    # At most TRAIN_ROWS short rows.
    rows_ = labelled(docs, labels, rows).mapInPandas(lean(vectors), "toxic int, own array<int>").toPandas()
    weights, bias = regress(rows_["own"].tolist(), rows_["toxic"].to_numpy(np.float64), len(held))
    return {"weights": dict(zip(held, weights.tolist())), "bias": bias}


def regress(own: list, truth: np.ndarray, size: int, rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse 0/1 rows with a unit Gaussian prior on the weights."""
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    column = np.concatenate([np.asarray(x, np.int64) for x in own]) if len(row) else np.zeros(0, np.int64)
    w = np.zeros(size + 1)
    w[-1] = math.log((truth.sum() + 1) / (len(truth) - truth.sum() + 1))
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, rounds + 1):
        error = 1 / (1 + np.exp(-np.bincount(row, w[column], len(own)) - w[-1])) - truth
        slope = np.append(np.bincount(column, error[row], size) + w[:-1], error.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope ** 2
        w = w - rate * (mean / (1 - 0.9 ** k)) / (np.sqrt(square / (1 - 0.99 ** k)) + 1e-9)
    return w[:-1], float(w[-1])


class Scorer:
    """Chance that a text is toxic, from a character model and fitted weights."""

    def __init__(self, trigrams: dict[int, int], model: dict):
        # What a token says is remembered here, so its words need not be.
        self.reader, self.weights, self.bias = Reader(CharModel(trigrams), 0), model["weights"], model["bias"]
        self.known: dict[str, tuple[str, ...]] = {}

    def held(self, words) -> tuple[str, ...]:
        return tuple({f for w in words for f in features(w) if f in self.weights})

    def evidence(self, token: str) -> tuple[str, ...]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= CACHE_TOKENS:
                self.known.clear()
            found = self.known[token] = self.held(self.reader.words(token))
        return found

    def score(self, text: str | None) -> float:
        text = (text or "").lower()
        found: set[str] = set()
        for own in map(self.evidence, set(text.split())):
            if own:
                found.update(own)
        for stretch in spaced(text):
            found.update(self.held(restore(stretch, self.reader.model).split(" ")))
        total = self.bias + sum(map(self.weights.__getitem__, sorted(found)))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, total))))


def score_texts(docs: DataFrame, trigrams: dict[int, int], model: dict) -> DataFrame:
    """doc_id, score: chance that a text is toxic. Null counts as empty; a text without evidence gets
    the bias; equal texts score alike."""
    shared = docs.sparkSession.sparkContext.broadcast((trigrams, model))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [scorer.score(t) for t in batch["text"]]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(lean(work), f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below one half. No shuffle of texts."""
    tuned(docs.sparkSession)
    trigrams = char_counts(docs)
    shared = docs.sparkSession.sparkContext.broadcast((trigrams, fit(docs, labels, trigrams, rows)))
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(lean(work), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    The character model counts all texts of both tables; the classifier learns from ``labels`` and the texts
    of ``train_docs`` (``docs`` if not given).
    """
    tuned(docs.sparkSession)
    read = docs if train_docs is None else docs.select("text").unionByName(train_docs.select("text"))
    trigrams = char_counts(read)
    model = fit(docs if train_docs is None else train_docs, labels, trigrams, rows)
    return score_texts(docs, trigrams, model).select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_FOLD).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels outside the held-out fold."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
