"""Phrase and proximity search against plain loops, the query against SQL."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import compare, connect
from gridspark.llm import decontaminate as op
from gridspark.llm.common import id_text
from text_tables import SMALL, odd_texts, table  # noqa: F401

ITEMS = "item_id bigint, text string, doc_id string, block string, words string, places string"
WORD = re.compile(op.WORD)


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(op.UPPER, op.LOWER)))


def plain_phrases(texts, items, window):
    """Per text: words inside any window and the items that have one there."""
    out = []
    for text in texts:
        own, hit, found = words(text), set(), set()
        for name, item in items:
            w = words(item)
            for at in range(max(1, len(w) - window + 1) if w else 0):
                part = w[at:at + window]
                for start in range(len(own) - len(part) + 1):
                    if own[start:start + len(part)] == part:
                        hit |= set(range(start, start + len(part)))
                        found.add("" if name is None else str(name))
        out.append((len(own), len(hit), sorted(found)))
    return out


@pytest.fixture(scope="module")
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, "d", "b", "w", "p") for i, t in rows], ITEMS)


def random_texts(seed, count, most, letters):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(list(letters), rng.integers(0, most))) for _ in range(count)]


@pytest.mark.parametrize("query_words, piece_words", [(200_000, 1_000), (9, 6)])
def test_phrases_equal_a_plain_search(table, items, odd_texts, monkeypatch, query_words, piece_words):
    """Also with many passes and items cut in pieces; items may be null, empty, equal or share an id."""
    monkeypatch.setattr(op, "QUERY_WORDS", query_words)
    monkeypatch.setattr(op, "PIECE_WORDS", piece_words)
    texts = random_texts(1, 40, 60, "abc") + odd_texts + ["a b c", "A-b,C", "x a b c a b c a b c a b c y"] * 2
    rows = [(1, "a b c a"), (2, "c b a c b a"), (2, "b b b"), (3, None), (4, ""), (None, "a a a a"), (10, "same TEXT here"),
            (5, " ".join("abcab")), (6, " ".join("abcabcabcabcabcabcab")), (6, " ".join("abcabcabcabcabcabcab")), (7, "never there"), (8, "naïve straße")]
    index = op.build_index(id_text(table(texts)))
    report = op.contamination_report(index, op.phrase_matches(index, items(rows), window=4)).collect()
    wanted = plain_phrases(texts, rows, 4)
    assert sorted(r.doc_id for r in report) == list(range(len(texts)))
    for r in report:
        assert (r.n_words, r.n_hit, r.item_ids) == wanted[r.doc_id]
        assert r.contaminated == (r.n_hit > 0)


def test_spans_do_not_cross_documents_and_ids_may_repeat(table, items):
    texts = ["x one two", "three four", "one two three four", "one two three four"]
    index = op.build_index(id_text(table(texts, [7, None, 9, 9])))
    found = op.phrase_matches(index, items([(1, "one two three four")]), window=4).collect()
    assert sorted((r.doc_id, r.item_id, r.start, r.stop) for r in found) == [(9, "1", 0, 4)] * 2
    assert op.indexed_documents(index).count() == 4


def test_empty_tables(table, items):
    index = op.build_index(id_text(table([])))
    assert op.contamination_report(index, op.phrase_matches(index, items([(1, "a b")]))).count() == 0
    index = op.build_index(id_text(table(["a b", None])))
    report = op.contamination_report(index, op.phrase_matches(index, items([]))).collect()
    assert sorted((r.doc_id, r.n_hit, r.item_ids, r.contaminated) for r in report) == [(0, 0, [], False), (1, 0, [], False)]


def plain_proximity(text, item, within):
    own, wanted, places = words(text), set(words(item)), set()
    for start in range(len(own)):
        if not wanted or own[start] not in wanted:
            continue
        for stop in range(start + 1, min(start + within, len(own)) + 1):
            if wanted <= set(own[start:stop]):
                places |= set(range(start, stop))
                break
    return places


def test_proximity_equals_a_plain_search(table, items):
    texts = random_texts(2, 60, 40, "abcdefgh") + [None, "", "a d", "d x x a"]
    rows = [(1, "a d"), (2, "e f g"), (3, "h h"), (4, "a b c d e f g h"), (5, None), (6, "a zzz")]
    index = op.build_index(id_text(table(texts)))
    found = {}
    for r in op.proximity_matches(index, items(rows), within=5).collect():
        found.setdefault((r.doc_id, int(r.item_id)), set()).update(range(r.start, r.stop))
    for i, text in enumerate(texts):
        for name, item in rows:
            assert found.get((i, name), set()) == plain_proximity(text, item, 5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2), st.integers(0, 30), st.integers(1, 9)), max_size=30))
def test_spans_are_merged(rows):
    item, doc, start, size = np.array(rows, np.int64).reshape(-1, 4).T
    got = {}
    for i, d, s, e in zip(*op.merged(item, doc, start, start + size)):
        for place in range(s, e):
            assert (i, d, place) not in got
            got[i, d, place] = True
    assert set(got) == {(i, d, p) for i, d, s, n in rows for p in range(s, s + n)}


def test_query_equals_sql(spark):
    assert compare(spark, connect(SMALL), op.op13_decontaminate, op.OP13_SQL, SMALL) == ""
