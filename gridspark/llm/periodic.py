"""Periodic runs of words, found at the boundaries of a Re-Pair grammar."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, id_text
from .words import cut_words, ranges, text_bytes

MIN_WORDS, MIN_COPIES = 6, 4
SLICE_BYTES = 4 << 20  # texts that share one flat array; a longer text has one to itself
SHORT = 8  # shorter periods are tried one by one, longer ones come from recurring grams of words

SPACE = r"[^\x20\x09-\x0D]+"
IS_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
PRIME = 0x9E3779B97F4A7C15  # any odd number
GAP = 1 << 40


@dataclass
class Grammar:
    """Rules of all texts of a slice. Symbols below ``words`` are words, symbol ``words + k`` is rule k."""

    words: int
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray  # words that each symbol stands for, word symbols included
    first: np.ndarray  # where the first occurrence of each rule begins
    rounds: list[slice]  # the rules that each round made; they use earlier ones only
    symbols: np.ndarray  # what is left of all texts, in order
    at: np.ndarray  # where each of these begins


def re_pair(codes: np.ndarray, doc: np.ndarray) -> Grammar:
    """Replace repeated pairs of symbols by new symbols until no pair repeats inside a text.

    Words of different texts have different codes. A round takes pairs in order of their counts
    (overlapping occurrences count once), all those at once that no more frequent pair overlaps.
    A pair that occurs once never repeats later, so its place is closed; texts without open places leave.
    """
    words = int(codes.max()) + 1 if len(codes) else 0
    symbols, at, done = codes.astype(np.int64), np.arange(len(codes)), []
    size = [np.ones(words, np.int64)]
    sizes_now = size[0]
    left, right, first, rounds, rules = [], [], [], [], 0
    open_ = np.append(doc[1:] == doc[:-1], False)[:len(codes)]
    limit = 2 * len(codes) + 1  # each rule takes at least one symbol away
    while True:
        place = np.flatnonzero(open_)
        if not len(place):
            break
        # In a run of one symbol every second pair counts.
        twin = place[symbols[place] == symbols[place + 1]]
        if len(twin):
            new = np.r_[True, np.diff(twin) > 1]
            odd = (twin - twin[new][np.cumsum(new) - 1]) % 2 == 1
            counted = np.ones(len(symbols), bool)
            counted[twin[odd]] = False
            place = place[counted[place]]
        key = symbols[place] * limit + symbols[place + 1]
        order = np.argsort(key, kind="stable")
        place, key = place[order], key[order]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        count = np.bincount(group)
        repeats = count[group] > 1
        open_[place[~repeats]] = False
        place, group = place[repeats], group[repeats]
        if not len(place):
            break
        score = np.full(len(symbols) + 1, -1)  # the last entry serves as neighbour of the first symbol
        own = count[group] * (len(count) + 1) + group
        score[place] = own
        taken = (own > score[place - 1]) & (own > score[place + 1])
        place, group = place[taken], group[taken]
        repeats = np.bincount(group, minlength=len(count))[group] > 1
        place, group = place[repeats], group[repeats]
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        a, b = symbols[place[head]], symbols[place[head] + 1]
        left.append(a)
        right.append(b)
        first.append(at[place[head]])
        size.append(sizes_now[a] + sizes_now[b])
        sizes_now = np.concatenate([sizes_now, size[-1]])
        rounds.append(slice(rules, rules + len(head)))
        symbols[place] = words + rules + np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1
        rules += len(head)
        keep = np.ones(len(symbols), bool)
        keep[place + 1] = False
        changed = np.zeros(len(symbols), bool)
        changed[place] = True
        symbols, at, doc, open_, changed = symbols[keep], at[keep], doc[keep], open_[keep], changed[keep]
        changed[:-1] |= changed[1:]
        open_ |= changed
        open_[:-1] &= doc[1:] == doc[:-1]
        open_[-1] = False
        busy = np.zeros(int(doc[-1]) + 1, bool)
        busy[doc[open_]] = True
        stay = busy[doc]
        if np.count_nonzero(stay) < 0.9 * len(stay):
            done.append((symbols[~stay], at[~stay]))
            symbols, at, doc, open_ = symbols[stay], at[stay], doc[stay], open_[stay]
    done.append((symbols, at))
    symbols, at = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(at, kind="stable")
    flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Grammar(words, flat(left), flat(right), sizes_now, flat(first), rounds, symbols[order], at[order])


class Fingerprints:
    """Equality of stretches of words by polynomial fingerprints modulo 2**64; equal words always agree."""

    def __init__(self, codes: np.ndarray):
        value = codes.astype(np.uint64) + np.uint64(1)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            value = (value ^ (value >> np.uint64(shift))) * np.uint64(factor)
        power = np.full(len(codes) + 1, PRIME, np.uint64)
        back = np.full(len(codes) + 1, pow(PRIME, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.append(np.uint64(0), np.cumsum(value * np.cumprod(power)[:-1]))

    def gram(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.back[at]

    def same(self, a: np.ndarray, b: np.ndarray, size) -> np.ndarray:
        return self.gram(a, size) == self.gram(b, size)

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Words, up to ``most``, that agree from a and b onwards, or before them."""
        low, high = np.zeros_like(most), np.maximum(most, 0)
        while len(most) and (low < high).any():
            middle = (low + high + 1) // 2
            shift = middle if back else 0
            ok = self.same(a - shift, b - shift, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low


def recurring_periods(prints: Fingerprints, maybe: np.ndarray, stop: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray):
    """(boundary, period, where the first copy begins) for periods of at least SHORT words.

    A period q with size <= q < 2 * size shows as a gram of ``size`` words that recurs at distance q:
    after the boundary, or ending at it. Grams that do not recur are dropped before the size doubles.
    If the gram has a smaller period d that lasts x words, periods up to x - d are no smallest ones
    (theorem of Fine and Wilf) and are passed over.
    """
    found = []
    size = SHORT
    # Places where SHORT words in a row occur elsewhere in the text.
    lone = np.append(0, np.cumsum(~maybe))
    place = np.arange(max(0, len(maybe) - size + 1))
    place = place[(lone[place + size] == lone[place]) & (place + size <= stop[place])]
    while len(place):
        grams = prints.gram(place, size)
        order = np.argsort(grams, kind="stable")
        grams, place = grams[order], place[order]
        new = np.r_[True, grams[1:] != grams[:-1]]
        group = np.cumsum(new) - 1
        recurs = np.bincount(group)[group] > 1
        place, group = place[recurs], group[recurs]
        if not len(place):
            break
        key = group * GAP + place
        rank = np.full(len(maybe) + 1, -1)
        rank[place] = np.arange(len(place))
        for back in (False, True):
            gram_at = m - size if back else m
            ok = np.flatnonzero((gram_at >= low) & (m + (0 if back else 2 * size) <= high) & (m - (2 * size if back else 0) >= low))
            ok = ok[rank[gram_at[ok]] >= 0]
            base, own = gram_at[ok], group[rank[gram_at[ok]]]
            step = -1 if back else 1
            near = rank[base] + step
            inside = (near >= 0) & (near < len(place))
            near = np.where(inside, near, 0)
            d = np.where(inside & (group[near] == own), np.abs(place[near] - base), 0)
            least = np.full(len(ok), size)
            dense = np.flatnonzero((d > 0) & (d < size))
            if len(dense):
                b, e = m[ok[dense]], d[dense]
                if back:
                    x = prints.reach(b - e, b, b - e - low[ok[dense]], back=True)
                else:
                    x = prints.reach(b, b + e, high[ok[dense]] - b - e)
                least[dense] = np.maximum(size, x + 1)
            next_ = np.searchsorted(key, own * GAP + base + least) if not back else np.searchsorted(key, own * GAP + base - least, "right") - 1
            while len(ok):
                inside = (next_ >= 0) & (next_ < len(place))
                at = np.where(inside, next_, 0)
                q = np.abs(place[at] - base)
                room = m[ok] - 2 * q >= low[ok] if back else m[ok] + 2 * q <= high[ok]
                live = inside & (group[at] == own) & (q < 2 * size) & room
                ok, base, own, next_, q = ok[live], base[live], own[live], next_[live], q[live]
                begin = m[ok] - 2 * q if back else m[ok]
                hit = prints.same(begin, begin + q, q)
                found.append((ok[hit], q[hit], begin[hit]))
                next_ = next_ + step
        alive = np.zeros(len(maybe) + 1, bool)
        alive[place] = True
        place = np.sort(place)
        place = place[(place + 2 * size <= stop[place])]
        place = place[alive[place + size]]
        size *= 2
    return found


def boundary_runs(codes: np.ndarray, maybe: np.ndarray, stop: np.ndarray, m: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Runs inside the window [low, high) of each boundary m: (boundary, start, end, period).

    A run of four periods has two of them on one side of the boundary, so a square of its period begins or ends there.
    """
    prints = Fingerprints(codes)
    found = recurring_periods(prints, maybe, stop, m, low, high)
    for q in range(1, SHORT):
        equal = np.append(codes[:-q] == codes[q:], np.zeros(q, bool)) if len(codes) > q else np.zeros(len(codes), bool)
        for begin, room in ((m, m + 2 * q <= high), (m - 2 * q, m - 2 * q >= low)):
            ok = np.flatnonzero(room)
            ok = ok[equal[begin[ok]]]
            ok = ok[prints.same(begin[ok], begin[ok] + q, q)]
            found.append((ok, np.full(len(ok), q), begin[ok]))
    which, q, begin = (np.concatenate(x) for x in zip(*found))
    end = begin + 2 * q + prints.reach(begin + q, begin + 2 * q, high[which] - begin - 2 * q)
    start = begin - prints.reach(begin, begin + q, begin - low[which], back=True)
    long_ = end - start >= np.maximum(MIN_WORDS, MIN_COPIES * q)
    which, start, end, q = smallest(which[long_], start[long_], end[long_], q[long_])
    return exact(codes, which, start, end, q)


def smallest(which: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray):
    """Of equal stretches of a boundary the one with the smallest period; multiples of it cover the same words."""
    order = np.lexsort((q, end, start, which))
    which, start, end, q = which[order], start[order], end[order], q[order]
    new = np.r_[True, (np.diff(which) != 0) | (np.diff(start) != 0) | (np.diff(end) != 0)][:len(which)]
    return which[new], start[new], end[new], q[new]


def exact(codes: np.ndarray, which: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray):
    """Compare the words themselves; a stretch whose fingerprints agreed by chance falls into its true parts."""
    bad = [i for i, (s, e, p) in enumerate(zip(start.tolist(), end.tolist(), q.tolist())) if (codes[s:e - p] != codes[s + p:e]).any()]
    if not bad:
        return which, start, end, q
    more = []
    for i in bad:
        s, e, p = int(start[i]), int(end[i]), int(q[i])
        edges = np.flatnonzero(np.diff(np.r_[0, codes[s:e - p] == codes[s + p:e], 0].astype(np.int8)))
        more += [(which[i], s + a, s + b + p, p) for a, b in edges.reshape(-1, 2) if b - a + p >= max(MIN_WORDS, MIN_COPIES * p)]
    keep = np.ones(len(which), bool)
    keep[bad] = False
    added = np.array(more, np.int64).reshape(-1, 4).T
    return smallest(*(np.concatenate([a[keep], b]) for a, b in zip((which, start, end, q), added)))


def periodic_runs(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end, period of all runs in texts that lie one after the other, ``counts`` words each.

    Each run crosses the boundary of the lowest grammar node that holds it. So the runs at the boundary of each rule
    are looked for once, at its first occurrence, and carried to all places of the rule; boundaries between the
    symbols that are left are looked at where they are. Merging what overlaps by a period leaves the maximal runs.
    """
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(doc * (int(codes.max()) + 1 if len(codes) else 1) + codes, kind="stable")
    new = np.r_[True, (np.diff(codes[order]) != 0) | (np.diff(doc[order]) != 0)][:len(codes)]
    own = np.cumsum(new) - 1
    maybe = np.zeros(len(codes), bool)
    maybe[order] = np.bincount(own)[own] > 1 if len(own) else own
    codes = np.empty(len(order), np.int64)
    codes[order] = own
    stops = np.cumsum(counts)
    stop, begin = np.repeat(stops, counts), np.repeat(stops - counts, counts)
    grammar = re_pair(codes, doc)
    words, size = grammar.words, grammar.size
    inner = grammar.at[grammar.at != begin[grammar.at]] if len(codes) else grammar.at
    m = np.concatenate([grammar.first + size[grammar.left], inner])
    low = np.concatenate([grammar.first, begin[inner]])
    high = np.concatenate([grammar.first + size[words:], stop[inner]])
    wide = np.flatnonzero(high - low >= MIN_WORDS)
    if not len(wide):
        return (np.zeros(0, np.int64),) * 3
    which, start, end, q = boundary_runs(codes, maybe, stop, m[wide], low[wide], high[wide])
    which = wide[which]
    rules = len(grammar.left)
    in_rule = which < rules
    place, run = derivation_places(grammar, which[in_rule])
    shift = place - grammar.first[which[in_rule][run]]
    start = np.concatenate([start[~in_rule], start[in_rule][run] + shift])
    end = np.concatenate([end[~in_rule], end[in_rule][run] + shift])
    q = np.concatenate([q[~in_rule], q[in_rule][run]])
    return maximal(start, end, q)


def derivation_places(grammar: Grammar, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place where the given rules are derived: (place, index into ``rule``); ``rule`` is sorted."""
    words, count = grammar.words, len(grammar.left)
    number = np.bincount(rule, minlength=count)
    needed = np.append(np.zeros(words, bool), number > 0)
    for own in grammar.rounds:
        needed[words + own.start:words + own.stop] |= needed[grammar.left[own]] | needed[grammar.right[own]]
    begin = np.cumsum(number) - number
    symbols, at = grammar.symbols, grammar.at
    places, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while True:
        keep = needed[symbols]
        symbols, at = symbols[keep] - words, at[keep]
        if not len(symbols):
            return np.concatenate(places), np.concatenate(runs)
        runs.append(ranges(begin[symbols], number[symbols]))
        places.append(np.repeat(at, number[symbols]))
        left, right = grammar.left[symbols], grammar.right[symbols]
        symbols, at = np.concatenate([left, right]), np.concatenate([at, at + grammar.size[left]])


def maximal(start: np.ndarray, end: np.ndarray, q: np.ndarray):
    """Stretches of one period that overlap by a period or more are one run. Sorted by start, then period."""
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    reach = np.maximum.accumulate(end + q * GAP) - q * GAP
    new = np.r_[True, (np.diff(q) != 0) | (start[1:] > reach[:-1] - q[1:])][:len(start)]
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    _, start, end, q = smallest(np.zeros(len(head), np.int64), start[head], reach[tail[:len(head)]], q[head])
    order = np.lexsort((q, start))
    return start[order], end[order], q[order]


RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def run_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs and collapsed text of each document; needs doc_id and text.

    Runs have at least six words and four periods, are sorted by start, then period, and count words from 0. The
    collapsed text joins by one space the words that no run contains after its first period. Texts without
    words have no runs and an empty collapsed text. No rows meet: equal and repeated rows give equal results.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at = text_bytes(batch.column(1))
            part, begin = at[:-1] // SLICE_BYTES, 0
            for end in [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]:
                if end > begin:
                    yield sliced(batch.column(0)[begin:end], batch.column(1)[begin:end])
                begin = end

    def sliced(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words, counts = cut_words(texts, IS_WORD)
        start, end, q = periodic_runs(words.dictionary_encode().indices.to_numpy().astype(np.int64), counts)
        begin = np.cumsum(counts) - counts
        doc = np.searchsorted(begin + counts, start, "right")
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, start + q, 1)
        np.add.at(change, end, -1)
        kept = np.cumsum(change)[:-1] == 0
        whole = np.logical_and.reduceat(np.append(kept, True), np.minimum(begin, len(kept))) | (counts == 0)
        data, at = text_bytes(texts)
        data = data.tobytes()
        lines = []
        for d, plain in enumerate(whole.tolist()):
            own = data[at[d]:at[d + 1]].split()
            if not plain:
                mask = kept[begin[d]:begin[d] + counts[d]].tolist()
                own = [w for w, stays in zip(own, mask) if stays]
            lines.append(b" ".join(own))
        runs = pa.StructArray.from_arrays([pa.array(start - begin[doc]), pa.array(end - start), pa.array(q)], ["start", "length", "period"])
        ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(counts)))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), runs), pa.array(lines, pa.binary()).cast(pa.string())],
            ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_words long, runs {RUN}, collapsed string")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """The documents of the contract: every tenth by crc32 of its id gets a tail that repeats its own words."""
    h = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    g = F.floor(h / 10)
    chosen = docs.withColumn("w", F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(SPACE), F.lit(0))))
    n = F.size("w").cast("long")
    a = g % n
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
    whole = lambda c: c.cast("int")
    block = F.slice("w", whole(a + 1), whole(p))
    tail = F.slice(F.flatten(F.array_repeat(block, whole(F.ceil((n - a) / p)))), F.lit(1), whole(n - a))
    text: Column = F.when(F.size("w") > 0, F.array_join(F.concat(F.slice("w", F.lit(1), whole(a)), tail), " ")).otherwise(F.col("text"))
    return chosen.select("doc_id", text.alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, and digests of them and of the text without their repetitions."""
    table = run_table(with_periodic_tails(id_text(documents(spark, sf_dir))))
    best = F.array_sort("runs", lambda a, b: F.coalesce(
        *[F.when(x < y, -1).when(x > y, 1) for x, y in ((b["length"], a["length"]), (a["start"], b["start"]), (a["period"], b["period"]))],
        F.lit(0)))[0]
    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    text = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return table.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        sha(text).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


# crc32 from its polynomial, eight shifts a byte; then every pair of equal words of a document.
OP12_SQL = rf"""
WITH RECURSIVE crc(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8
), crcs AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crcs
), tail AS (
  SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, h // 10 AS g FROM d
), changed AS (
  SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
    THEN list_transform(range(len(w)), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (len(w) - a) // (3 + g % 8)) + 1] END)
    ELSE w END AS w
  FROM tail
), word AS (
  SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i, len(w) AS n FROM changed
), equal AS (
  SELECT a.rid, b.i - a.i AS q, a.i FROM word a JOIN word b ON a.rid = b.rid AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
), island AS (
  SELECT rid, q, i, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS k FROM equal
), stretch AS (
  SELECT rid, min(i) AS s, count(*) + q AS n, q FROM island GROUP BY rid, q, k HAVING count(*) + q >= greatest({MIN_WORDS}, {MIN_COPIES} * q)
), runs AS (
  SELECT rid, s, n, min(q) AS q FROM stretch GROUP BY rid, s, n
), dropped AS (
  SELECT DISTINCT rid, unnest(range(s + q, s + n)) AS i FROM runs
), kept AS (
  SELECT rid, string_agg(x, ' ' ORDER BY i) AS text FROM word ANTI JOIN dropped USING (rid, i) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first(struct_pack(s := s, n := n, q := q) ORDER BY n DESC, s, q) AS best
  FROM runs GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.n AS length, best.q AS period, 1000 * best.n // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM changed LEFT JOIN found USING (rid) LEFT JOIN kept USING (rid)
"""
