"""BPE, packing and token counts against the tokenizers library."""

import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridspark.llm import bpe, packing, token_cache
from gridspark.llm.common import id_text
from gridspark.session import scratch
from text_tables import odd_texts, table  # noqa: F401

FILE = bpe.tokenizer_path(bpe.WORD_BPE)
LIBRARY, OWN = Tokenizer.from_file(FILE), bpe.WordBpe(FILE)
ALPHABET = "abcdeilmorstvABCΣσςİıé́ñ \n\t\x1c\x85 ²½٣中🙂'-_.,<|endoftext|>ßﬁ0129"


def own_ids(text):
    cache = bpe.WordCache(OWN, lambda ids: ids.tolist())
    words = OWN.words(text)
    known = cache.learn([words])
    return [i for w in words for i in known[w]]


@settings(max_examples=400, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=30))
def test_ids_and_decoding_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    found = LIBRARY.encode(text, add_special_tokens=False).ids
    assert own_ids(text) == found
    assert OWN.decode(found) == LIBRARY.decode(found, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text("abehinorst'", min_size=1, max_size=80) | st.text("aab", min_size=1, max_size=60) | st.text(ALPHABET, min_size=1, max_size=40))
def test_long_words_merge_as_short_ones(text):
    for word in OWN.words(text):
        if word not in OWN.special:
            assert OWN._encode_long(word.encode()).tolist() == OWN._encode_flat([word.encode()])[0].tolist()


def test_time_is_near_linear_in_the_length_of_a_word():
    """Random letters: ids equal the library's; fifty times the letters end in reasonable time."""
    rng = np.random.default_rng(3)
    word = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    for text in (word(5_000), "ab" + "x" * 5_001, word(2_500) + " it " + word(3_000) + " 中" + word(30)):
        assert own_ids(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    assert len(own_ids(word(250_000))) > 50_000
    assert time.process_time() - began < 20


def test_round_trip_query(table, odd_texts):
    rows = bpe.bpe_round_trip(id_text(table(odd_texts)), FILE).collect()
    assert len(rows) == len(odd_texts)
    for row in rows:
        ids = LIBRARY.encode(odd_texts[row.doc_id] or "", add_special_tokens=False).ids
        text = LIBRARY.decode(ids, skip_special_tokens=False)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.bpe_round_trip(id_text(table([])), FILE).count() == 0


def test_tokens_are_the_ids(table, odd_texts):
    for row in bpe.bpe_tokens(id_text(table(odd_texts)), FILE).collect():
        assert list(row.ids) == LIBRARY.encode(odd_texts[row.doc_id] or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_windows_hold_every_item_once(sizes):
    sizes = np.array(sizes, np.int64)
    lists = packing.pack(sizes, 64) if len(sizes) else []
    assert sorted(i for own in lists for i in own) == list(range(len(sizes)))
    assert all(sizes[own].sum() <= 64 for own in lists)


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(0).integers(1, 1000, 600)
    loads = [sizes[own].sum() for own in packing.balance(sizes, 40)]
    assert len(loads) == 40 and max(loads) - min(loads) < 60


def test_packing_is_a_partition(table, odd_texts):
    rows = packing.pack_documents(id_text(table(odd_texts + ["copy me"] * 3)), FILE, group_tokens=1 << 14).collect()
    texts, sequences, documents = odd_texts + ["copy me"] * 3, {}, {}
    for row in rows:
        sequences.setdefault(row.sequence_id, []).append((row.offset, row.length))
        documents.setdefault(row.doc_id, []).append(row)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.CAPACITY
    assert sorted(documents) == list(range(len(texts)))
    for key, parts in documents.items():
        ids = np.array(LIBRARY.encode(texts[key] or "", add_special_tokens=False).ids + [packing.END_ID], "<u4")
        at = 0
        for row in sorted(parts, key=lambda r: r.start):
            assert row.start == at and row.doc_tokens == len(ids)
            assert row.ids_crc32 == zlib.crc32(ids[at:at + row.length].tobytes())
            at += row.length
        assert at == len(ids)
    assert packing.pack_documents(id_text(table([])), FILE).count() == 0


def test_rows_without_an_id_are_spread_over_all_groups(table):
    """400 equal rows without an id: each group of the deal gets its share."""
    rows = packing.pack_documents(id_text(table(["some words here"] * 400, [None] * 400)), FILE, group_tokens=100).collect()
    groups = {}
    for row in rows:
        groups[row.sequence_id >> 33] = groups.get(row.sequence_id >> 33, 0) + row.length
    assert len(rows) == 400 and len(groups) > 8 and max(groups.values()) < 300


def counts(spark, docs, place):
    return token_cache.cached_counts(
        docs, place, bpe.tokenizer_path(token_cache.TOKENIZER), bpe.tokenizer_path(token_cache.RANKS))


def test_counts_come_from_the_cache(spark, table, odd_texts):
    full = Tokenizer.from_file(bpe.tokenizer_path(token_cache.TOKENIZER))
    place = scratch(spark, "cache")
    docs = id_text(table(odd_texts + odd_texts))
    rows = counts(spark, docs, place).collect()
    assert len(rows) == 2 * len(odd_texts)
    for row in rows:
        text = odd_texts[row.doc_id % len(odd_texts)] or ""
        assert row.n_tokens == len(full.encode(text, add_special_tokens=False).ids)
        assert (row.n_bytes, row.over_limit) == (len(text.encode()), row.n_tokens > 512)
    stored = spark.read.parquet(place)
    distinct = len({t or "" for t in odd_texts})
    assert stored.count() == distinct
    # A second run finds all of them and appends only what is new.
    counts(spark, id_text(table(odd_texts + ["never seen"])), place).collect()
    assert spark.read.parquet(place).count() == distinct + 1
    assert counts(spark, id_text(table([])), place).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=30))
def test_quick_counts_equal_the_library(text):
    text = text.encode("utf-8", "replace").decode()
    assert COUNT(text) == len(FULL.encode(text, add_special_tokens=False).ids)


FULL = Tokenizer.from_file(bpe.tokenizer_path(token_cache.TOKENIZER))
COUNT = token_cache.token_counter(bpe.tokenizer_path(token_cache.TOKENIZER), bpe.tokenizer_path(token_cache.RANKS))
