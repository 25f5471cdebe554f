"""Small tables of odd texts that the tests share."""

import pytest

from gridspark.llm.common import tuned

SMALL, TABLES = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, label string, `key` string, score string, `lo` string"


@pytest.fixture(scope="session")
def table(spark):
    """Documents from texts, with extra columns whose names clash with those of operators."""
    def make(texts, ids=None):
        tuned(spark)
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, None, None, None, "x", "k", "s", "l") for i, t in zip(ids, texts)], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, white space, ties, repeats, letters beyond ASCII, special strings, very long."""
    words = " ".join(f"w{i * 7919 % 1000}x" for i in range(30_000))
    return [None, "", "  \t\n", "same text here", "same text here", "Same  text\nhere", "naïve Straße 中文字 🙂 ½ ²",
            "a<|endoftext|>b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", words, "x" * 50_000]
