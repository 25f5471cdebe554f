"""Alignment of two tokenizers against plain loops over all pairs of tokens."""

import hashlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridspark.llm import alignment as op
from gridspark.llm.bpe import byte_letters, tokenizer_path
from gridspark.llm.common import id_text
from gridspark.llm.token_cache import RANKS, TOKENIZER
from text_tables import SMALL, odd_texts, table  # noqa: F401

FILES = tuple(map(tokenizer_path, (TOKENIZER, RANKS, op.PIECES)))
A, B, OWN = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[2]), op.Aligner(*FILES)
A.encode_special_tokens = True
LETTER = {c: i for i, c in enumerate(byte_letters())}
ALPHABET = "abcdeilmorstvABCΣςσİıé́ñ \n\t\x1c\x85 ²½٣中🙂'-_.,<|endoftext|>ßﬁ0129▁s/"


def plain_tokens(text):
    """(id, end) of both sides; nothing where the bytes are not those of the text."""
    if not text:
        return [], []
    data = b" " + text.encode()
    out = []
    for ids, piece in (
        (A.encode(" " + text, add_special_tokens=False).ids, lambda i: bytes(LETTER[c] for c in A.id_to_token(i))),
        (B.encode(text), lambda i: bytes([int(B.id_to_piece(i)[1:-1], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()),
    ):
        joined, tokens = b"", []
        for i in ids:
            joined += piece(i)
            tokens.append((i, len(joined)))
        if joined != data:
            return [], []
        out.append(tokens)
    return out


def plain_rows(texts):
    tokens = [plain_tokens(t) for t in texts]
    links = [[(x, y) for x, e in a for y, f in b if e == f] for a, b in tokens]
    count = Counter(pair for own in links for pair in own)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    rows = []
    for (a, b), own in zip(tokens, links):
        ends = sorted({e for _, e in a} & {f for _, f in b})
        low, groups = 0, []
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, end in side if low < end <= e) for side in (a, b)))
            low = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((len(a), len(b), len(ends), len(own), sum(count[p] == best[p[1]] for p in own), sum(count[p] for p in own), digest))
    return rows, count


@settings(max_examples=300, deadline=None)
@given(st.text(ALPHABET, max_size=60) | st.text(max_size=30))
def test_tokens_equal_those_of_the_libraries(text):
    text = text.encode("utf-8", "replace").decode()
    assert OWN.tokens(text) == (A.encode(" " + text, add_special_tokens=False).ids, B.encode(text))


def some_texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(12).collect()
    return [r.text[:600] if r.text else r.text for r in rows]


@pytest.fixture(scope="module")
def texts(spark, odd_texts):
    short = [t if t is None or len(t) < 5_000 else t[:3_000] for t in odd_texts]
    return short + some_texts(spark) + ["copy me now"] * 5 + ["  two  spaces ", "</s><unk><s>", "a▁b", "ends with space "]


def test_measures_equal_plain_loops(table, texts):
    wanted, _ = plain_rows(texts)
    rows = op.token_alignment(id_text(table(texts)), *FILES).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == wanted[r.doc_id], texts[r.doc_id]


def test_counts_of_pairs_and_their_bound(table, texts):
    _, wanted = plain_rows(texts)
    aligned = op.aligned_texts(id_text(table(texts)), *FILES)
    counts = op.pair_counts(aligned, OWN.pair, len(OWN.bytes_b)).collect()
    assert {(r.a_id, r.b_id): r.n for r in counts} == dict(wanted)
    assert all(x.endswith(y) or y.endswith(x) for x, y in ((OWN.bytes_a[a], OWN.bytes_b[b]) for a, b in wanted))
    assert len(wanted) < op.most_pairs(OWN) < 1_000_000
    assert aligned.where("text_sha256 = sha2('copy me now', 256)").first().copies == 5


def test_groups_are_the_digested_ones(table, texts):
    wanted, _ = plain_rows(texts)
    for r in op.token_groups(id_text(table(texts)), *FILES).collect():
        line = ";".join(",".join(map(str, g.a)) + "|" + ",".join(map(str, g.b)) for g in r.groups)
        assert (hashlib.sha256(line.encode()).hexdigest() if line else "") == wanted[r.doc_id][-1]


def test_repeated_and_null_ids_and_the_empty_table(table):
    rows = op.token_alignment(id_text(table(["x y", "x y", "z"], [None, 4, 4])), *FILES).collect()
    wanted, _ = plain_rows(["x y", "x y", "z"])
    assert sorted(tuple(r)[1:] for r in rows) == sorted(wanted)
    assert op.token_alignment(id_text(table([])), *FILES).count() == 0
    assert op.token_alignment(id_text(table([None, ""])), *FILES).agg({"n_a": "sum"}).first()[0] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=60), max_size=12))
def test_parts_give_what_whole_texts_give(texts):
    for found, text in zip(OWN.measures(texts), texts, strict=True):
        whole = text and OWN.measured([text])
        assert (found or None) == (whole[0] if whole else None)


def test_a_word_is_tokenised_once(monkeypatch):
    own, seen = op.Aligner(*FILES), []
    tokens = own.tokens
    monkeypatch.setattr(own, "tokens", lambda text: seen.append(len(text)) or tokens(text))
    text = " ".join(f"word{i % 50}" for i in range(1000))
    assert len({*own.measures([text, text + " word7"])}) == 2
    assert sum(seen) < len(text) / 10  # once whole texts: twice the text
