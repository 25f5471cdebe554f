"""Similarity join of word n-gram sets by T-occurrence search."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_BATCH, documents, free_shuffles, id_text, lean, lean_group, stored, tuned
from .components import components, forest

# Counters of shingle frequency, and the rows they travel in. The counters only order shingles: more of them keep
# unrelated documents apart for longer as the input grows, none changes a result.
COUNTERS, SLICES = 1 << 22, 64
CHUNK_BYTES = 1 << 18  # bytes of texts that are hashed at once
BLOCK_DOCS = 1024  # documents that one task searches together
FEW_ROWS = 500_000  # ids that are sent to every task at most; more of them meet the texts in a shuffle
HUBS = 16  # best linked documents of a large group that are compared with all of it
SKETCH_BLOCK = 4096  # documents whose sketches a task compares with as many others
SKETCH_BITS = 1 << 16  # bits of a sketch at most
SKIP = 0.05  # weight of the merge in choosing how many long lists are only probed

U = np.uint64
BASE, INVERSE = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64 over all."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Distinct word n-grams of texts as 64-bit hashes, many texts at a time.

    Only A-Z are lowered; words are parted by space, tab, line feed, vertical tab, form feed and carriage
    return. A text with fewer words than ``words`` is one shingle of all of them; one without words has none.
    """

    def __init__(self, words: int):
        self.words = words
        self.letter = mix(np.arange(1, 257, dtype=U))
        self.letter[65:91] = self.letter[97:123]
        self.gap = np.zeros(256, bool)
        self.gap[[9, 10, 11, 12, 13, 32]] = True
        self.up = self.down = np.ones(1, U)

    def powers(self, size: int) -> None:
        if len(self.up) < size:
            size = max(size, CHUNK_BYTES)
            self.up = np.cumprod(np.r_[U(1), np.full(size - 1, BASE)])
            self.down = np.cumprod(np.r_[U(1), np.full(size - 1, INVERSE)])

    def sets(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Sorted distinct hashes of each text."""
        raw = [t.encode() for t in texts]
        start = size = 0
        for i, data in enumerate(raw):
            if size and size + len(data) > CHUNK_BYTES:
                yield from self._sets(raw[start:i])
                start, size = i, 0
            size += len(data) + 1
        if start < len(raw):
            yield from self._sets(raw[start:])

    def _sets(self, raw: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        self.powers(len(data) + 1)
        gap = self.gap[data]
        edge = np.diff(np.r_[True, gap, True].astype(np.int8))
        begin, end = np.flatnonzero(edge[:-1] == -1), np.flatnonzero(edge == 1)
        sums = np.r_[U(0), np.cumsum(self.letter[data] * self.up[:len(data)])]
        word = mix((sums[end] - sums[begin]) * self.down[begin])
        bounds = np.cumsum([len(r) + 1 for r in raw])
        last = np.searchsorted(begin, bounds)
        n = self.words
        gram = mix(np.full(max(0, len(word) - n + 1), n, U))
        for k in range(n):
            gram = mix(gram * BASE + word[k:len(word) - n + 1 + k]) if len(gram) else gram
        first = 0
        for stop in last.tolist():
            count = stop - first
            if count >= n:
                yield np.unique(gram[first:stop - n + 1])
            elif count:
                own = mix(np.array([count], U))
                for w in word[first:stop]:
                    own = mix(own * BASE + w)
                yield own
            else:
                yield np.zeros(0, U)
            first = stop


def needed(size, num: int, den: int):
    """Least overlap that a set of this size can have with a partner."""
    return -(-size * num // den)


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles and a 128-bit digest of the set; rows of frequency counters among them, with ``slice`` set."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, counts = Shingler(words), np.zeros(COUNTERS, np.uint32)
        for batch in batches:
            rows = []
            for key, own in zip(batch["doc_id"], shingler.sets(batch["text"].tolist())):
                np.add.at(counts, (own % U(COUNTERS)).astype(np.int64), 1)
                spread = mix(own ^ U(0x5851F42D4C957F2D))
                second = np.bitwise_xor.reduce(mix(spread)) if len(own) else U(0)
                rows.append((key, len(own), int(spread.sum(dtype=U).view(np.int64)), int(second.view(np.int64))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "d1", "d2"]).assign(slice=None, counts=None)
        for i, part in enumerate(counts.reshape(SLICES, -1)):
            if part.any():
                packed = zlib.compress(part.astype("<u4").tobytes(), 1)
                yield pd.DataFrame([(None, 0, 0, 0, i, packed)], columns=["doc_id", "n_shingles", "d1", "d2", "slice", "counts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInPandas(
        lean(work), "doc_id long, n_shingles long, d1 long, d2 long, slice int, counts binary")


def frequencies(rows: DataFrame) -> np.ndarray:
    """The counters of all tasks together, up to 65,535; their number is fixed, and so is the size of what is broadcast."""
    def add(own: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(COUNTERS // SLICES, np.int64)
        for part in own["counts"]:
            total += np.frombuffer(zlib.decompress(part), "<u4")
        return pd.DataFrame([(own["slice"].iloc[0], np.minimum(total, 65_535).astype("<u2").tobytes())], columns=["slice", "counts"])

    parts = rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(lean_group(add), "slice int, counts binary")
    out = np.zeros((SLICES, COUNTERS // SLICES), np.uint16)
    for row in parts.collect():
        out[row["slice"]] = np.frombuffer(row["counts"], "<u2")
    return out.reshape(-1)


def short_lists(docs: DataFrame, speakers: DataFrame, counters: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """Entries of the short inverted lists: key, lo, hi, doc.

    A set of n shingles needs T = ceil(threshold * n) of them in a partner, so a partner must occur in the
    lists of its n - T + 1 rarest ones (order: frequency counter, then hash), whatever the longer
    lists hold. Documents that a task finds in one list are linked by entries under a key of
    their own, and go on as a single entry for each run of sizes, from ``lo`` to ``hi``; so a
    list has at most a few entries from each task however common its shingle is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, order = Shingler(words), shared.value
        for batch in batches:
            rows = []
            for key, own in zip(batch["doc_id"], shingler.sets(batch["text"].tolist())):
                n = len(own)
                if n:
                    rare = own[np.lexsort((own, order[(own % U(COUNTERS)).astype(np.int64)]))[:n - needed(n, num, den) + 1]]
                    rows.append((key, n, rare.astype("<u8").tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "rare"])

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            count = np.array([len(r) // 8 for r in batch["rare"]])
            key = np.frombuffer(b"".join(batch["rare"]), "<u8")
            doc = np.repeat(batch["doc_id"].to_numpy(np.int64), count)
            n = np.repeat(batch["n"].to_numpy(np.int64), count)
            order = np.lexsort((doc, n, key))
            key, doc, n = key[order], doc[order], n[order]
            fresh = np.r_[True, (key[1:] != key[:-1]) | (n[:-1] * den < n[1:] * num)]
            run = np.cumsum(fresh) - 1
            first = np.flatnonzero(fresh)
            last = np.r_[first[1:], len(key)] - 1
            yield pd.DataFrame({"key": key[first].view(np.int64), "lo": n[first], "hi": n[last], "doc": doc[first]})
            own = (last > first)[run]
            if own.any():
                salt = mix(key[own] ^ mix(doc[first][run[own]].astype(U) + U(1)))
                yield pd.DataFrame({"key": salt.view(np.int64), "lo": n[own], "hi": n[own], "doc": doc[own]})

    wide = docs.select("doc_id", "text").mapInPandas(lean(prefixes), "doc_id long, n long, rare binary")
    return wide.join(speakers, "doc_id", "left_semi").mapInPandas(lean(entries), "key long, lo long, hi long, doc long")


def candidate_links(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Chains through each list in order of size, broken where sizes are too far apart to be similar."""
    in_list = Window.partitionBy("key").orderBy("lo", "doc")
    reach = F.max("hi").over(in_list.rowsBetween(Window.unboundedPreceding, -1))
    chained = entries.select("doc", "lo", F.lag("doc").over(in_list).alias("before"), reach.alias("reach"))
    return chained.where((F.col("before") != F.col("doc")) & (F.col("reach") * den >= F.col("lo") * num)).select(
        F.col("doc").alias("a"), F.col("before").alias("b"))


def candidate_groups(docs: DataFrame, speakers: DataFrame, counters: np.ndarray, words: int, num: int, den: int, block: int) -> DataFrame:
    """doc, component, blocks: groups that hold every link, and in how many blocks each has to be searched."""
    return sized_groups(components(candidate_links(short_lists(docs, speakers, counters, words, num, den), num, den)), block)


def sized_groups(found: DataFrame, block: int) -> DataFrame:
    """The groups of ``components`` as doc, component, blocks, written."""
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    grouped = stored(found.join(sizes, "component").select(
        F.col("node").alias("doc"), "component", F.ceil(F.col("n") / block).cast("long").alias("blocks")), "candidates")
    free_shuffles(found.sparkSession)
    return grouped


def sketch(own: np.ndarray) -> bytes:
    """Parity of the shingles that fall on each of some bits: a power of two of them, one for each shingle at least.

    A shingle that one of two sets lacks turns one bit, so the sets differ in no fewer shingles than their sketches in bits.
    """
    size = min(SKETCH_BITS, max(64, 1 << (len(own) - 1).bit_length()))
    hits = np.bincount((mix(own ^ U(0x2545F4914F6CDD1D)) % U(size)).astype(np.int64), minlength=size)
    return np.packbits((hits & 1).astype(np.uint8)).tobytes()


def near_links(ids: np.ndarray, size: np.ndarray, sketches: list[bytes], role: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Links that hold every pair whose sketches leave it open that num/den of their union is common.

    Rows of role 0 meet all others, those of 1 and 2 each other only. A longer sketch is folded to the shorter one's bits.
    Documents that are linked already are not compared again.
    """
    order = np.lexsort((ids, size))
    ids, size, role, sketches = ids[order], size[order], role[order], [sketches[i] for i in order]
    width = np.array([len(s) for s in sketches])  # grows with the size, or stays
    label, links = np.arange(len(ids)), []
    upto = np.searchsorted(size, size * den // num, side="right")
    for own in np.unique(width).tolist():
        begin, end = np.searchsorted(width, [own, own + 1]).tolist()
        last = int(upto[end - 1])
        table = np.stack([np.bitwise_xor.reduce(np.frombuffer(s, np.uint64).reshape(-1, own // 8), axis=0) for s in sketches[begin:last]])
        for i in range(begin, end):
            later = slice(i + 1, int(upto[i]))
            j = i + 1 + np.flatnonzero((label[later] != label[i]) & ((role[later] != role[i]) | (role[i] == 0)))
            if not len(j):
                continue
            differ = np.bitwise_count(table[j - begin] ^ table[i - begin]).sum(axis=1, dtype=np.int64)
            both = size[i] + size[j]
            for other in j[differ <= both - 2 * -(-both * num // (num + den))].tolist():
                if label[other] != label[i]:
                    links.append((int(ids[i]), int(ids[other])))
                    label[label == label[other]] = label[i]
    return links


def near_groups(docs: DataFrame, crowd: DataFrame, words: int, num: int, den: int, block: int) -> DataFrame:
    """doc, component, blocks as from ``candidate_groups`` for documents of large groups, by pairs of sketches.

    A sketch takes a bit or two where a set takes 64, and pairs that only share some rare shingles do not pass. The sketches
    of a group are dealt into blocks, and each two blocks meet in one task.
    """
    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            found = [(len(own), sketch(own)) for own in shingler.sets(batch["text"].tolist())]
            yield batch[["doc", "component", "width"]].assign(n=[n for n, _ in found], sketch=[s for _, s in found])

    def work(own: pd.DataFrame) -> pd.DataFrame:
        links = near_links(own["doc"].to_numpy(np.int64), own["n"].to_numpy(np.int64), own["sketch"].tolist(), own["role"].to_numpy(np.int64), num, den)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    counted = crowd.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / SKETCH_BLOCK).cast("long").alias("width"))
    wanted = stored(crowd.select("doc", "component").join(counted, "component"), "sketched")
    rows = docs.select(F.col("doc_id").alias("doc"), "text").join(by_size(wanted), "doc").mapInPandas(
        lean(sketched), "doc long, component long, width long, n long, sketch binary")
    home = F.pmod(F.xxhash64("doc", F.lit(5)), F.col("width"))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("width") - 1), lambda k: F.struct(
        F.xxhash64("component", F.least(home, k), F.greatest(home, k)).alias("place"),
        F.when(home == k, 0).when(home < k, 1).otherwise(2).alias("role")))
    dealt = rows.withColumn("meets", F.explode(meets)).select("meets.place", "meets.role", "doc", "n", "sketch")
    pairs = dealt.groupBy("place").applyInPandas(lean_group(work), "a long, b long")
    return sized_groups(components(pairs), block)


def similar_links(ids: np.ndarray, sets: list[np.ndarray], labels: np.ndarray, num: int, den: int,
                  queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """T-occurrence search with DivideSkip over the inverted lists of some sets.

    For each query set the long lists are put aside; the short ones are merged and counted, and only
    documents that occur often enough to reach T with the help of the long lists are looked up in those, by binary
    search. Links found are exact. Of each class one spanning forest comes out; documents that
    share a label, or are linked already, are not looked up again.
    """
    size = np.array([len(s) for s in sets], np.int64)
    order = np.lexsort((ids, size))
    ids, size, labels = ids[order], size[order], labels[order]
    sets = [sets[i] for i in order]
    query = np.ones(len(ids), bool) if queries is None else queries[order]
    items = np.concatenate(sets) if sets else np.zeros(0, U)
    owner = np.repeat(np.arange(len(sets)), size)
    by_item = np.argsort(items, kind="stable")
    sorted_items, posting = items[by_item], owner[by_item]
    fresh = np.flatnonzero(np.r_[True, sorted_items[1:] != sorted_items[:-1]]) if len(items) else np.zeros(0, np.int64)
    length = np.diff(np.r_[fresh, len(items)])
    list_of = np.empty(len(items), np.int64)
    list_of[by_item] = np.repeat(np.arange(len(fresh)), length)
    start = np.r_[0, np.cumsum(size)]
    names, group = np.unique(labels, return_inverse=True)
    above = list(range(len(names)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    links = []
    for i in range(len(ids)):
        if not query[i] or not size[i]:
            continue
        lists = list_of[start[i]:start[i + 1]]
        n = length[lists]
        lists, n = lists[n > 1], n[n > 1]
        # Partners are at least threshold * size, hence this overlap at least, or more for larger ones.
        least = int(needed(size[i], num, den))
        if len(lists) < least:
            continue
        long_count = min(least - 1, int(least / (SKIP * np.log2(n.max() + 1) + 1)))
        by_length = np.argsort(n, kind="stable")
        short, long_ = lists[by_length[:len(lists) - long_count]], lists[by_length[len(lists) - long_count:]]
        n = length[short]
        place = np.repeat(fresh[short] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        counts = np.bincount(posting[place], minlength=len(ids))
        counts[i] = 0
        found = np.flatnonzero(counts >= least - long_count)
        found = found[(size[found] * den >= size[i] * num) & (size[found] * num <= size[i] * den)]
        mine = top(group[i])
        # Each pair of queries once.
        found = found[[(j < i or not query[j]) and top(group[j]) != mine for j in found.tolist()]] if len(found) else found
        if not len(found):
            continue
        overlap = counts[found]
        for one in long_:
            own = posting[fresh[one]:fresh[one] + length[one]]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            overlap = overlap + (own[at] == found)
        for j, common in zip(found.tolist(), overlap.tolist()):
            if common * den >= (int(size[i]) + int(size[j]) - common) * num and top(group[j]) != top(group[i]):
                links.append((int(ids[i]), int(ids[j])))
                x, y = top(group[i]), top(group[j])
                above[max(x, y)] = min(x, y)
    return links


def searched(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) found inside each ``place``; columns place, doc, label, query, shingles."""
    def work(own: pd.DataFrame) -> pd.DataFrame:
        links = similar_links(
            own["doc"].to_numpy(np.int64), [np.frombuffer(s, "<u8") for s in own["shingles"]],
            own["label"].to_numpy(np.int64), num, den, own["query"].to_numpy(bool),
        )
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return sets.groupBy("place").applyInPandas(lean_group(work), "a long, b long")


def by_size(ids: DataFrame) -> DataFrame:
    """Marks a written table of ids for a broadcast if it is small; it is counted first."""
    return F.broadcast(ids) if ids.limit(FEW_ROWS + 1).count() <= FEW_ROWS else ids.hint("shuffle_hash")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Whole sets of the documents in ``wanted``, with its columns."""
    names = [c for c in wanted.columns if c != "doc"]
    kinds = ", ".join(f"{c} {wanted.schema[c].dataType.simpleString()}" for c in names)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for batch in batches:
            packed = [s.astype("<u8").tobytes() for s in shingler.sets(batch["text"].tolist())]
            yield batch[["doc", *names]].assign(shingles=packed)

    joined = docs.select(F.col("doc_id").alias("doc"), "text").join(by_size(wanted), "doc")
    return joined.mapInPandas(lean(work), f"doc long, {kinds}, shingles binary")


def similar_classes(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, block: int = BLOCK_DOCS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link when num/den of their union is common.

    ``docs`` has doc_id (whole numbers) and text without nulls. Equal sets are one node, found by digest.
    Null ids have no component; texts without words are components of their own; rows with one id are one node.

    1. Digests of all sets and frequency counters, in one pass.
    2. Short inverted lists (``short_lists``); chains through them give candidate groups that hold every link. Documents
       of groups beyond ``block`` are counted and listed anew among themselves as long as that shrinks the groups. Of what
       stays in such groups, only pairs whose sketches (``sketch``) leave it open that they are similar hold a group together.
    3. Inside groups, T-occurrence search on whole sets. Groups of up to ``block`` documents are
       searched whole, several in a task. Larger ones are dealt into blocks twice, by two hashes; then the best linked
       documents, and last those outside the largest class found so far, are searched against every block, being dealt into
       blocks themselves. So no search holds more than about two blocks, and no pair of different classes is left out.
    """
    spark = tuned(docs.sparkSession, SMALL_BATCH)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stored(fingerprints(docs, words), "fingerprints")
    plain = rows.where("slice is null").select("doc_id", "n_shingles", "d1", "d2")
    filled = plain.where("n_shingles > 0 and doc_id is not null")
    speakers = filled.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("speaker"))
    named = speakers.select(F.col("speaker").alias("doc_id"))
    grouped = candidate_groups(docs, named, frequencies(rows), words, num, den, block)
    before, crowd_docs = None, docs
    while True:
        # Counted among themselves, the documents of large groups show which shingles are rare there.
        crowd = grouped.where("blocks > 1").select(F.col("doc").alias("doc_id"))
        size = crowd.count()
        if not size or before and size > 0.8 * before:
            break
        before = size
        crowd_docs = stored(crowd_docs.select("doc_id", "text").join(by_size(crowd), "doc_id", "left_semi"), "crowd")
        counters = frequencies(stored(fingerprints(crowd_docs, words), "fingerprints"))
        again = candidate_groups(crowd_docs, crowd, counters, words, num, den, block)
        grouped = stored(grouped.where("blocks = 1").unionByName(again), "candidates")
        free_shuffles(spark)
    if size:
        near = near_groups(crowd_docs, grouped.where("blocks > 1"), words, num, den, block)
        grouped = stored(grouped.where("blocks = 1").unionByName(near), "candidates")
        free_shuffles(spark)
    total = grouped.count()
    tasks = max(1, -(-total // block))
    # Small groups share a place by hash; blocks of large groups have their own. Negative and
    # positive numbers keep the two apart.
    salted = F.explode(F.when(F.col("blocks") == 1, F.array(-1 - F.pmod(F.xxhash64("component"), F.lit(tasks)))).otherwise(
        F.array(*[F.abs(F.xxhash64("component", F.lit(s), F.pmod(F.xxhash64("doc", F.lit(s)), F.col("blocks")))) for s in (1, 2)])))
    first = shingle_sets(docs, grouped, words).withColumn("place", salted)
    links = stored(forest(searched(
        first.select("place", "doc", F.col("doc").alias("label"), F.lit(True).alias("query"), "shingles"), num, den)), "similar")
    free_shuffles(spark)
    if grouped.where("blocks > 1").limit(1).count():
        links = links.unionByName(hub_links(crowd_docs, grouped, links, words, num, den))
        links = links.unionByName(across_blocks(crowd_docs, grouped, links, words, num, den, block))
    classes = components(links)
    members = plain.join(speakers, ["n_shingles", "d1", "d2"], "left").join(
        classes.withColumnRenamed("node", "speaker"), "speaker", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "speaker", "doc_id"))
    return members.select("doc_id", "n_shingles", own.alias("component_id"))


def hub_links(docs: DataFrame, grouped: DataFrame, links: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links of the documents with most links so far to all blocks of their large group.

    Copies of one original are often nearer to it than to each other; the original then joins all blocks at once.
    """
    large = grouped.where("blocks > 1")
    ends = links.select(F.col("a").alias("doc")).unionByName(links.select(F.col("b").alias("doc")))
    most = Window.partitionBy("component").orderBy(F.desc("n"), "doc")
    hubs = (
        ends.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(large, "doc")
        .withColumn("rank", F.row_number().over(most)).where(F.col("rank") <= HUBS).select("doc", F.lit(True).alias("query"))
    )
    classes = components(links).select(F.col("node").alias("doc"), F.col("component").alias("class"))
    wanted = stored(
        large.join(classes, "doc", "left").join(hubs, "doc", "left").select(
            "doc", "component", "blocks", F.coalesce("class", "doc").alias("label"), F.coalesce("query", F.lit(False)).alias("query"),
            F.lit(1).cast("long").alias("parts")), "hubs")
    return stored(forest(searched(in_blocks(docs, wanted, words), num, den)), "hub-links")


def in_blocks(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Sets of ``wanted`` (doc, component, blocks, label, query, parts): queries meet every block of their group.

    The queries of a group are dealt into ``parts``. A place holds one part of them and one block of all, so its size does
    not grow with the group; a query counts as one of its own block where other parts ask.
    """
    home, part = F.pmod(F.xxhash64("doc", F.lit(1)), F.col("blocks")), F.pmod(F.xxhash64("doc", F.lit(3)), F.col("parts"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    asks = F.transform(upto("blocks"), lambda at: F.struct(at.alias("at"), part.alias("part"), F.lit(True).alias("query")))
    asked = F.transform(upto("parts"), lambda x: F.struct(home.alias("at"), x.alias("part"), F.lit(False).alias("query")))
    where = F.explode(F.when(F.col("query"), F.concat(asks, F.filter(asked, lambda x: x["part"] != part))).otherwise(asked))
    sets = shingle_sets(docs, wanted, words).withColumn("role", where)
    return sets.select(F.xxhash64("component", "role.at", "role.part").alias("place"), "doc", "label", "role.query", "shingles")


def across_blocks(docs: DataFrame, grouped: DataFrame, links: DataFrame, words: int, num: int, den: int, block: int) -> DataFrame:
    """Links between blocks of large groups that do not follow from those found."""
    classes = components(links)
    large = grouped.where("blocks > 1").join(classes.withColumnRenamed("node", "doc").withColumnRenamed("component", "class"), "doc", "left")
    large = large.select("doc", "component", "blocks", F.coalesce("class", "doc").alias("label"))
    counted = large.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"),
        F.ceil((F.sum("n") - F.max("n")) / block).cast("long").alias("parts"))
    open_ = stored(large.join(main.where("labels > 1"), "component").select(
        "doc", "component", "blocks", "label", (F.col("label") != F.col("main")).alias("query"), "parts"), "open")
    if not open_.limit(1).count():
        return links.limit(0)
    return stored(forest(searched(in_blocks(docs, open_, words), num, den)), "across")


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of three-word shingles link at nine tenths."""
    return similar_classes(id_text(documents(spark, sf_dir)), words=3, num=90, den=100)
