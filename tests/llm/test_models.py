"""Language identification, toxicity and the pipeline: accuracy on what was held out, and odd rows."""

import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import langid, toxicity
from gridspark.llm.common import documents
from text_tables import SMALL, TABLES, odd_texts, table  # noqa: F401


def remainder(key, folds):
    return zlib.crc32(str(key).encode()) % folds


def test_language_of_held_out_documents(spark):
    rows = langid.op8_langid(spark, TABLES).toPandas()
    known = documents(spark, TABLES).select("doc_id", "lang").toPandas().merge(rows, on="doc_id")
    assert (known["held_out"] == known["doc_id"].map(lambda k: remainder(k, 4) == 2)).all()
    held = known[known["held_out"]]
    assert len(rows) == len(known) and (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert rows["score"].between(0, 1).all()


def test_code_lengths_equal_a_plain_recursion(spark):
    frame = spark.createDataFrame([("x", "abracadabra"), ("x", "abra"), ("y", "zzzabzz é")], "lang string, text string")
    model = langid.train(frame)
    counts = {}
    for lang, text in [("x", "abracadabra"), ("x", "abra"), ("y", "zzzabzz é")]:
        data = langid.PAD + text.encode()
        for at in range(3, len(data)):
            for order in range(4):
                key = (lang, data[at - order:at])
                counts.setdefault(key, {}).setdefault(data[at], 0)
                counts[key][data[at]] += 1

    def cost(lang, context, byte):
        below = lambda: 8.0 if not context else cost(lang, context[1:], byte)
        seen = counts.get((lang, context))
        if not seen:
            return below()
        total = sum(seen.values()) + len(seen)
        return -math.log2(seen[byte] / total) if byte in seen else -math.log2(len(seen) / total) + below()

    texts = ["abra", "zebra", "", "éa", "q" * 30]
    wanted = []
    for text in texts:
        data = langid.PAD + text.encode()
        wanted.append([sum(cost(lang, data[at - 3:at], data[at]) for at in range(3, len(data))) for lang in "xy"])
    assert np.allclose(model.lengths([t.encode() for t in texts]), wanted, rtol=1e-5)


def test_every_counted_context_is_held(spark):
    """One language has 30,000 frequent contexts, the other a few that occur once."""
    draw = np.random.default_rng(3)
    hot = " ".join("".join(map(chr, draw.integers(97, 129, 3))) for _ in range(200_000)).replace("\x7f", "a").replace("\x80", "b")
    model = langid.train(spark.createDataFrame([("x", hot), ("y", "QWXQ ZWXY ZWXY")], "lang string, text string"))
    data = np.frombuffer(langid.PAD + hot.encode(), np.uint8).astype(int)
    assert len(np.unique((data[:-3] * 256 + data[1:-2]) * 256 + data[2:-1])) > 20_000
    # After QWX only Q has come, once: 1 / (1 + 1), one bit; after WX it would be 1 / (3 + 2).
    longer, shorter = model.lengths([b"QWXQ", b"QWX"])
    assert math.isclose(longer[1] - shorter[1], 1, abs_tol=1e-4)


def test_language_of_odd_rows(spark, table, odd_texts):
    docs = table(odd_texts).withColumn("held_out", F.lit(False))
    learned = langid.train(documents(spark, SMALL))
    rows = {r.doc_id: r for r in langid.identify(docs, learned).collect()}
    assert [rows[i].lang_pred for i in range(3)] == ["und"] * 3 and rows[0].score == 0
    assert rows[3].lang_pred != "und" and rows[3][1:] == rows[4][1:]
    nothing = langid.train(table([]))
    assert nothing is None and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_disguised_words_are_restored(spark):
    model = toxicity.CharModel(toxicity.char_counts(documents(spark, TABLES)))
    for seen, meant in {"1d10t": "idiot", "l o s e r": "loser", "m0r0n": "moron", "$tupid": "stupid", "w.o.r.t.h.l.e.s.s": "worthless",
                        "clooown": "clown", "p@thet1c": "pathetic", "trash": "trash"}.items():
        assert toxicity.restore(seen, model) == meant
    assert toxicity.restore("", model) == ""
    assert len(toxicity.restore("1" * 5000, model)) == 5000


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    rows = toxicity.op6_toxicity(spark, TABLES).toPandas()
    known = labels.toPandas().merge(rows, on="doc_id")
    assert len(rows) == documents(spark, TABLES).count() and rows["score"].between(0, 1).all()
    assert (known["held_out"] == known["doc_id"].map(lambda k: remainder(k, 5) == 0)).all()
    assert (rows["predicted"] == (rows["score"] >= 0.5)).all()
    held = known[known["held_out"]]
    assert (held["toxic"] == held["predicted"]).mean() > 0.9
    assert ((known["predicted"] == 1) & (known["toxic"] == 0)).sum() <= 2


def test_toxicity_of_odd_rows(spark, table, odd_texts):
    train = documents(spark, TABLES).select("doc_id", "text")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    docs = table(odd_texts + ["The and 1d10t of m0r0n and w0rthless tr4sh.", "He is an i d i o t and a l o s e r and s c u m of it."])
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, labels, train).collect()}
    assert len(rows) == len(odd_texts) + 2
    assert rows[0].score == rows[1].score == rows[2].score < 0.5 and rows[3].score == rows[4].score
    assert rows[len(odd_texts)].predicted == rows[len(odd_texts) + 1].predicted == 1
    none = toxicity.toxicity(docs, labels.limit(0), train).collect()
    assert {r.predicted for r in none} == {0}
    assert toxicity.toxicity(table([]), labels.limit(0)).count() == 0


def test_stages_keep_columns_and_decide(spark, table, odd_texts):
    """Columns stay, odd rows pass, and what each stage decides is gone from the next."""
    docs = table(odd_texts + ["The idiot is a moron and a pathetic loser of worthless trash and scum."])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TABLES)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        if name == "toxicity":
            # Labels belong to other texts here, so only that nothing breaks.
            assert set(rows) <= set(range(len(odd_texts) + 1))
        elif name == "exact_dedup":
            assert 0 not in rows and 1 not in rows and 4 not in rows and {2, 5} <= set(rows)
        elif name == "near_dedup":
            assert {2, 9, 10} <= set(rows) and not {3, 4} <= set(rows)
        else:
            assert len(rows[10].text) < 200 and rows[10].n_chars == len(rows[10].text)
        assert stage(spark, docs.limit(0), TABLES).count() == 0


def test_one_id_with_two_texts_passes_all_stages(spark, table):
    """A near copy under an id of two texts goes; the other text of that id stays, whole."""
    long = " ".join(f"harmless{i}" for i in range(200))
    rows = [(0, long), (1, long + " end"), (1, "short one"), (1, "another text"), (2, "short  one")]
    docs = table([t for _, t in rows], [i for i, _ in rows])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), docs.schema)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(0, long), (1, "another text"), (2, "short  one")]
    pieces = corpus_pipeline.packing(spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in pieces) == [0, 1, 2]


def test_pipeline_against_its_stages(spark):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "passage_dedup", "packing"]
    rows = corpus_pipeline.run(spark, SMALL).toPandas()
    assert (rows.groupby("sequence_id")["length"].sum() <= 4096).all()
    assert (rows.groupby("doc_id")["length"].sum() == rows.groupby("doc_id")["doc_tokens"].first()).all()


def test_gaps_hide_no_spaced_word():
    """The quick test in front of the search for spaced words rules out only texts without one."""
    import random
    from gridspark.llm import toxicity as T
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab_ .*-\n\t (0@é,;!?|") for _ in range(rng.randint(0, 30))) for _ in range(50_000)]
    hits = [t for t in texts if T.SPACED.search(t)]
    assert hits and all(T.spaced(t) == [m.group() for m in T.SPACED.finditer(t)] for t in texts)
    tokens = [t.replace(" ", "") for t in texts]
    assert all(bool(T.SUSPECT.match(t)) == bool(T.SUSPECT.search(t)) for t in tokens)
