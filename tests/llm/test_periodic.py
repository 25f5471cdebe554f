"""Runs against a plain search over all periods, the grammar against its text, the query against SQL."""

import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import compare, connect
from gridspark.llm import periodic as op
from gridspark.llm.common import id_text
from text_tables import SMALL, odd_texts, table  # noqa: F401


def plain_runs(words):
    """(start, length, period) of all runs, by looking at every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in found.items())


def split(text):
    return re.findall(op.SPACE, text or "")


def check(rows, texts):
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for row in rows:
        words = split(texts[row.doc_id])
        runs = plain_runs(words)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert row.n_words == len(words)
        assert [tuple(r) for r in row.runs] == sorted(runs, key=lambda r: (r[0], r[2]))
        assert row.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


blocks = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=24), st.integers(1, 9)), max_size=5)


def codes_of(texts):
    codes = [[c for block, times in text for c in block * times] for text in texts]
    return np.array(sum(codes, []), np.int64), np.array([len(c) for c in codes])


@settings(max_examples=300, deadline=None)
@given(st.lists(blocks, min_size=1, max_size=5))
def test_runs_equal_a_plain_search(texts):
    codes, counts = codes_of(texts)
    start, end, q = op.periodic_runs(codes, counts)
    ends, wanted = np.cumsum(counts), []
    for e, n in zip(ends.tolist(), counts.tolist()):
        wanted += [(s + e - n, length, p) for s, length, p in plain_runs(codes[e - n:e].tolist())]
    assert list(zip(start.tolist(), (end - start).tolist(), q.tolist())) == sorted(wanted, key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(blocks, min_size=1, max_size=4))
def test_the_grammar_derives_its_text_and_leaves_no_repeated_pair(texts):
    codes, counts = codes_of(texts)
    doc = np.repeat(np.arange(len(counts)), counts)
    codes = codes + 4 * doc
    grammar = op.re_pair(codes, doc)

    def expand(symbol):
        rule = symbol - grammar.words
        return [symbol] if rule < 0 else expand(grammar.left[rule]) + expand(grammar.right[rule])

    assert [c for s in grammar.symbols for c in expand(s)] == codes.tolist()
    for rule in range(len(grammar.left)):
        own = expand(rule + grammar.words)
        first = grammar.first[rule]
        assert len(own) == grammar.size[rule + grammar.words] and own == codes[first:first + len(own)].tolist()
    last = {}
    for i, pair in enumerate(zip(grammar.symbols, grammar.symbols[1:])):
        if grammar.at[i + 1] not in np.cumsum(counts):
            assert pair not in last or last[pair] == i - 1
            last.setdefault(pair, i)


def test_agreement_by_chance_is_found_out():
    codes = np.array([0, 1] * 5 + [2] + [0, 1] * 4)
    found = op.exact(codes, np.array([3]), np.array([0]), np.array([19]), np.array([2]))
    assert [x.tolist() for x in found] == [[3, 3], [0, 11], [10, 19], [2, 2]]


def test_table_of_odd_texts(table, odd_texts):
    line = "the same line of seven words again"
    texts = odd_texts + ["a " * 6, "a " * 5, "é é é é é é", " ".join([line] * 5), f"x {line} y " * 4, "a b " * 4, "a b " * 3,
                         " ".join("aabaabaabaab" * 3 + "c" * 50 + "ab" * 30), "z\x00 " * 9, " ".join(["u v w"] * 1_000)]
    check(op.run_table(id_text(table(texts))).collect(), texts)
    assert op.run_table(id_text(table([]))).count() == 0


def test_texts_over_several_slices(table, monkeypatch):
    monkeypatch.setattr(op, "SLICE_BYTES", 64)
    texts = [" ".join("ab" * i + "c" * (i % 9)) for i in range(60)]
    check(op.run_table(id_text(table(texts))).collect(), texts)


def test_tails_repeat_their_own_words(table):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(40)] + [None]
    ids = list(range(40)) + [None]
    for row in op.with_periodic_tails(id_text(table(texts, ids))).collect():
        h = zlib.crc32(b"" if row.doc_id is None else str(row.doc_id).encode())
        words = split(None if row.doc_id is None else texts[row.doc_id])
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        assert split(row.text) == words


def test_query_equals_sql(spark):
    assert compare(spark, connect(SMALL), op.op12_periodic_runs, op.OP12_SQL, SMALL) == ""
