"""Exact dedup, repeated passages and similarity classes against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import compare, connect
from gridspark.llm import chat, exact_dedup, jaccard, suffix_dedup
from gridspark.llm.common import documents, id_text
from gridspark.llm.components import components
from gridspark.llm.queries import ORACLES, QUERIES
from gridspark.session import scratch
from text_tables import SMALL, odd_texts, table  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    assert compare(spark, connect(SMALL), QUERIES[name], ORACLES[name], SMALL) == ""


# --- exact ----------------------------------------------------------------------------------------

def exact_groups(texts):
    groups = collections.defaultdict(list)
    for key, text in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), key))
    return {key: (min(own)[1], len(own), hashlib.sha256(content.encode()).hexdigest())
            for content, own in groups.items() for _, key in own}


@pytest.mark.parametrize("digest_hex", [64, 1])
def test_exact_fate_of_every_row(table, odd_texts, digest_hex):
    """With a digest of four bits nearly every hit is a collision, which the full comparison takes apart."""
    texts = odd_texts + ["a b", "ab", "a  b", "\x0bab", "é", "é"]
    rows = exact_dedup.dedup_table(table(texts), digest_hex=digest_hex).collect()
    wanted = exact_groups(enumerate(texts))
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in rows} == wanted and len(rows) == len(texts)
    assert all(r.kept == (r.keep_id == r.doc_id) for r in rows)


def test_exact_repeated_rows_and_empty_table(table):
    rows = exact_dedup.dedup_table(table(["t", "t", "u", "t"], [5, 5, 5, None])).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in rows) == [
        (-1, 5, 3, False), (5, 5, 1, True), (5, 5, 3, True), (5, 5, 3, True)]
    assert exact_dedup.dedup_table(table([])).count() == 0


def test_state_outlives_the_stream(spark, table):
    """A later run with the same place knows what an earlier one has seen, and keeps the longer text."""
    place = scratch(spark, "stream")

    def send(texts, ids):
        exact_dedup.content_keys(table(texts, ids)).drop("content").write.mode("append").parquet(f"{place}/in")
        schema = spark.read.parquet(f"{place}/in").schema
        stream = spark.readStream.schema(schema).parquet(f"{place}/in")
        groups = exact_dedup.stream_groups(stream, place).select("keep.doc_id", "group_size").collect()
        return sorted((r.doc_id, r.group_size) for r in groups)

    assert send(["one", "two"], [1, 2]) == [(1, 1), (2, 1)]
    assert send(["o ne", "three", "two"], [3, 4, 5]) == [(2, 2), (3, 2), (4, 1)]


# --- passages -------------------------------------------------------------------------------------

def removed(texts, length):
    """(doc_id, removed mask) by looking at every string."""
    seen, out = set(), {}
    for key, text in texts:
        data = (text or "").encode()
        mask = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            own = data[at:at + length]
            if own in seen:
                mask[at:at + length] = True
            seen.add(own)
        out[key] = mask
    return out


def check_removal(docs, texts, length, gram):
    rows = {r.doc_id: r for r in suffix_dedup.removal_report(docs, length, gram).collect()}
    masks = removed(sorted(texts), length)
    assert len(rows) == len(masks)
    for key, text in texts:
        data, mask, row = (text or "").encode(), masks[key], rows[key]
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        spans = int((np.diff(np.r_[0, mask.astype(int)]) == 1).sum())
        assert (row.n_bytes, row.n_removed, row.n_spans) == (len(data), int(mask.sum()), spans), key
        assert row.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_passages_against_brute_force(table, odd_texts, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_ANCHORS", 50)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    draw = random.Random(4)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 7)))
    passage = " ".join(word() for _ in range(60))
    texts = []
    for i in range(60):
        own = [word() for _ in range(draw.randint(0, 120))]
        if i % 2:
            own[draw.randint(0, len(own)):0] = [passage[draw.randint(0, 80):len(passage) - draw.randint(0, 80)]]
        texts.append(" ".join(own))
    texts += texts[:5] + ["ab" * 90, "ab" * 40 + "c", passage, passage * 3, "short", passage[:99]] + odd_texts
    rows = list(enumerate(texts))
    draw.shuffle(rows)
    check_removal(id_text(table([t for _, t in rows], [i for i, _ in rows])), rows, 100, 48)
    check_removal(id_text(table([t for _, t in rows], [i for i, _ in rows])), rows, 30, 12)


def test_passages_on_the_smallest_documents(spark):
    docs = id_text(documents(spark, SMALL))
    check_removal(docs, [(r.doc_id, r.text) for r in docs.collect()], 100, 48)


def test_passages_repeated_rows_nulls_and_whole_letters(table):
    draw = random.Random(5)
    long = "é" + "".join(draw.choice("éüabcdefg") for _ in range(150))
    assert suffix_dedup.removal_report(id_text(table([]))).count() == 0
    twice = suffix_dedup.removal_report(id_text(table([long, long, long], [1, 1, None]))).collect()
    assert [r.n_removed for r in twice] == [0, 0, 0]
    docs = table([long, "ü" + long[1:], None, long], [1, 2, 3, 4])
    rows = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert rows[1].text == long and rows[3].text is None and rows[4].text == "" and rows[4].lo == "l"
    # One byte of the first shared letter may be left by the bytes; the letter stays whole.
    assert rows[2].text.startswith("ü") and len(rows[2].text) <= 2


def test_one_id_with_several_texts(table):
    """Each text of a repeated id is a document of its own, in the order of digests; equal rows count as one."""
    draw = random.Random(6)
    texts = ["".join(draw.choice("abcdefgh") for _ in range(150)) for _ in range(3)]
    rows = [(5, texts[0]), (5, texts[1] + texts[0]), (5, texts[1] + texts[0]), (-3, texts[2]), (9, texts[2] + "tail"), (None, texts[0]), (5, "short")]
    docs = table([t for _, t in rows], [i for i, _ in rows])
    order = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).hexdigest()))
    masks = removed([((i, t), t) for i, t in order], 100)
    left = lambda row: row[1] if row[0] is None else bytes(np.frombuffer(row[1].encode(), np.uint8)[~masks[row]]).decode()
    assert sorted(r.text for r in suffix_dedup.without_repeats(docs).collect()) == sorted(map(left, rows))
    report = suffix_dedup.removal_report(id_text(docs)).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in report) == sorted((len(t), len(t) - len(left((i, t)))) for i, t in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=50), st.integers(1, 40))
def test_ranks_follow_suffix_order(symbols, depth):
    ranks = suffix_dedup.difference_cover_ranks(np.array(symbols, np.int64), depth)
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    for a, b in zip(order, order[1:]):
        equal = symbols[a:a + depth] == symbols[b:b + depth]
        assert ranks[a] < ranks[b] or (equal and True)
        assert ranks[a] != ranks[b] or equal


def test_ranks_of_more_than_two_million_symbols():
    """Three of these symbols do not fit 63 bits. Repeats stand at all residues modulo 3."""
    draw = np.random.default_rng(6)
    once = draw.permutation((1 << 21) + 1000) + 1
    symbols = np.concatenate([once, once[5:70_000], once[-90_000:], once[7:60_000]])
    ranks = suffix_dedup.difference_cover_ranks(symbols, 9)
    windows = np.lib.stride_tricks.sliding_window_view(np.r_[symbols, np.zeros(8, np.int64)], 9)
    order = np.lexsort(windows.T[::-1])
    fresh = np.r_[True, (windows[order[1:]] != windows[order[:-1]]).any(1)]
    first = np.flatnonzero(fresh)
    lowest, highest = np.minimum.reduceat(ranks[order], first), np.maximum.reduceat(ranks[order], first)
    assert len(once) > 1 << 21 and len(first) < len(symbols) and (highest[:-1] < lowest[1:]).all()


# --- similarity -----------------------------------------------------------------------------------

def shingles(text, words):
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i:i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def classes(texts, words, num, den):
    sets = {i: shingles(t, words) for i, t in texts}
    above = {i: i for i in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                above[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in sets}


def check_classes(docs, texts, words, num, den, block=1024):
    rows = jaccard.similar_classes(docs, words, num, den, block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == classes(texts, words, num, den)
    assert len(rows) == len(texts)


@pytest.mark.parametrize("words, num, block", [(3, 90, 1024), (5, 80, 3)])
def test_classes_against_brute_force(table, odd_texts, words, num, block):
    """Small blocks make the search go across them."""
    draw = random.Random(7)
    texts = []
    for i in range(12):
        own = [f"w{draw.randint(0, 400)}" for _ in range(draw.randint(30, 160))]
        for k in range(draw.randint(1, 12)):
            texts.append(" ".join(own))
            own = list(own)
            for _ in range(draw.randint(0, 2)):
                own[draw.randint(0, len(own) - 1)] = f"v{draw.randint(0, 9)}"
    texts += odd_texts + ["A b C", "a B c", "one two", "ONE  two", "one"]
    check_classes(id_text(table(texts)), list(enumerate(texts)), words, num, 100, block)


def test_no_place_receives_all_open_documents(table, monkeypatch):
    """A ring of texts that share two thirds with their neighbours: one candidate group without a large class."""
    draw, places, search = random.Random(8), [], jaccard.searched

    def counted(sets, num, den):
        places.extend(r["count"] for r in sets.groupBy("place").count().collect())
        return search(sets, num, den)

    monkeypatch.setattr(jaccard, "searched", counted)
    parts = [" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(40)) for _ in range(60)]
    texts = [" ".join(parts[(i + k) % 60] for k in range(3)) for i in range(60)]
    texts += [t + " more" for t in texts[::20]]
    check_classes(id_text(table(texts)), list(enumerate(texts)), 3, 80, 100, block=6)
    assert max(places) <= 30


def test_texts_that_only_chain_are_not_moved_to_all_blocks(table, monkeypatch):
    """The same ring: sketches part it before whole sets are dealt, whatever the number of its blocks."""
    draw, moved, search = random.Random(8), [], jaccard.searched

    def counted(sets, num, den):
        moved.append(sets.count())
        return search(sets, num, den)

    monkeypatch.setattr(jaccard, "searched", counted)
    parts = [" ".join(f"w{draw.randint(0, 10**6)}" for _ in range(40)) for _ in range(60)]
    texts = [" ".join(parts[(i + k) % 60] for k in range(3)) for i in range(60)]
    texts += [t + " more" for t in texts[::20]]
    check_classes(id_text(table(texts)), list(enumerate(texts)), 3, 80, 100, block=6)
    assert sum(moved) <= 2 * len(texts)


def test_sketches_lose_no_pair():
    """Sets of all sizes, in blocks of both kinds: sketches differ in no more bits than sets, and links hold all similar pairs."""
    draw, sets = np.random.default_rng(3), []
    for n in (1, 2, 9, 60, 64, 70, 500, 4000, 70_000):
        own = draw.integers(0, 1 << 62, n).astype(np.uint64)
        for kept in (1, 0.97, 0.9, 0.82, 0.5):
            sets.append(np.unique(np.r_[own[:max(1, int(kept * n))], draw.integers(0, 1 << 62, n // 20).astype(np.uint64)]))
    ids, size, sketches = np.arange(len(sets)), np.array([len(s) for s in sets]), [jaccard.sketch(s) for s in sets]
    for role in (ids * 0, 1 + ids % 2):
        above = dict(zip(ids.tolist(), ids.tolist()))
        for a, b in jaccard.near_links(ids, size, sketches, role, 80, 100):
            above = {x: above[a] if top == above[b] else top for x, top in above.items()}
        for a in ids.tolist():
            for b in ids[:a].tolist():
                common = len(np.intersect1d(sets[a], sets[b]))
                if len(sketches[a]) == len(sketches[b]):
                    turned = np.frombuffer(sketches[a], np.uint8) ^ np.frombuffer(sketches[b], np.uint8)
                    assert np.bitwise_count(turned).sum() <= size[a] + size[b] - 2 * common
                if 100 * common >= 80 * (size[a] + size[b] - common) and (role[a] == 0 or role[a] != role[b]):
                    assert above[a] == above[b]
        assert len(set(above.values())) >= 9


def test_classes_on_the_smallest_documents(spark):
    docs = id_text(documents(spark, SMALL))
    check_classes(docs, [(r.doc_id, r.text) for r in docs.collect()], 5, 80, 100)


def test_classes_without_ids_or_rows(table):
    assert jaccard.similar_classes(id_text(table([]))).count() == 0
    rows = jaccard.similar_classes(id_text(table(["a b c", "a b c", "a b c"], [None, 4, 4]))).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, None), (4, 4), (4, 4)]


@pytest.mark.parametrize("few", [0, 500_000])
def test_components_of_a_chain(spark, few):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    found = {r.node: r.component for r in components(links.repartition(5), few).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
