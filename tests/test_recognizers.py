"""Recogniser plug-in, centroids, training and search: F1, F2, T6, T7, P8."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.operators import recognizers as R


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(0)
    means = rng.normal(0, 3, (10, 6))
    rows = [(i, (means[i % 10] + rng.normal(0, 0.3, 6)).tolist(), i % 10) for i in range(300)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int").cache()


def test_empty_cells_never_reach_the_model(spark):
    def load():
        def predict(x):
            assert (x.mean(axis=1) >= 0.03 * 255).all()
            return np.full(len(x), 7), np.full(len(x), 0.25)
        return predict

    R.register_recognizer("seven", load)
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [200.0, 100.0])], "id int, vec array<double>")
    got = {r["id"]: (r["digit"], r["conf"]) for r in R.recognize(df, "vec", "seven").collect()}
    assert got == {1: (0, 1.0), 2: (7, 0.25)}
    assert df.columns == ["id", "vec"]


def test_centroids(spark, samples):
    means = R.centroids(samples, "vec", "label")
    pdf = samples.toPandas()
    for k in range(10):
        assert np.allclose(means[k], np.stack(pdf[pdf.label == k].vec).mean(axis=0))
    R.register_recognizer("c", lambda: R.centroid_predictor(means))
    got = R.recognize(samples, "vec", "c", empty_threshold=None).filter("label <> 0")
    assert got.filter(F.col("digit") == F.col("label")).count() / got.count() > 0.9


def test_gate():
    digits, confs = R.gate(np.array([[0.9, 0.05, 0.05] + [0.0] * 7, [0.1, 0.2, 0.7] + [0.0] * 7]))
    assert digits.tolist() == [0, 2] and confs.tolist() == [0.05, 0.7]


def test_training_and_search(spark, samples):
    model = R.train_classifier(samples, "vec", "label", max_iter=15)
    assert R.evaluate_classifier(model, samples, "vec", "label").first()["accuracy"] > 0.95
    configs = [{"name": "a", "max_iter": 3}, {"name": "bad", "max_iter": -1}, {"name": "b", "max_iter": 5}]
    done = R.grid_search(samples, samples, "vec", "label", configs[:1])
    both = R.grid_search(samples, samples, "vec", "label", configs, done)
    assert {r["name"]: r["state"] for r in both.collect()} == {"a": "done", "b": "done", "bad": "failed"}
    assert all((r["error"] is None) == (r["state"] == "done") for r in both.collect())


def _study(spark, samples, place, configs, **more):
    grid = spark.createDataFrame(configs, "name string, depth int, width int")
    return R.study(samples, samples, samples, samples, "vec", "label", grid, place, scale=10.0, **{"epochs": 40, "patience": 2, "block": 10} | more)


def test_an_interrupted_study_equals_a_whole_one(spark, samples):
    """Rows are appended one by one; what has a row is not trained again; failures keep theirs."""
    from gridspark.session import scratch

    configs = [("a", 1, 8), ("bad", 1, -1), ("c", 2, 8)]
    told = lambda df: {r["name"]: r for r in df.withColumn("error", F.regexp_replace("error", "_[0-9a-f]+ ", " ")).collect()}
    whole = told(_study(spark, samples, scratch(spark, "study"), configs))
    place = scratch(spark, "study")
    _study(spark, samples, place, configs[:2])
    parts = _study(spark, samples, place, configs)
    assert parts.count() == 3 and told(parts) == whole
    assert whole["bad"]["state"] == "failed" and whole["bad"]["error"] and whole["bad"]["test_acc"] is None
    assert whole["a"]["parameters"] == 7 * 8 + 9 * 10 and whole["a"]["test_acc"] == whole["a"]["best_val_acc"] > 0.5
    assert whole["a"]["epochs_run"] >= whole["a"]["best_epoch"] >= 10


def test_training_goes_on_from_its_weights_and_stops_with_patience(spark, samples):
    """The best block's model is the result; blocks without a better one end the training."""
    rows = R._network_rows(samples, "vec", "label", 10.0)
    assert rows.selectExpr("sum(size(copies)) AS n").first()["n"] == 330  # the empty class twice
    rows = rows.drop("copies").cache()
    best, history = R.train_epochs(rows, rows, [8], 6, 60, 2, 10)
    accs = [acc for _, acc, _ in history]
    assert abs(R._measure(best, rows)[0] - max(accs)) < 1e-12
    assert history[-1][2] < history[0][2] and [e for e, _, _ in history] == [10 * (i + 1) for i in range(len(history))]
    stop = next((i for i in range(2, len(accs)) if max(accs[i - 1:i + 1]) <= max(accs[:i - 1])), None)
    assert len(history) == (6 if stop is None else stop + 1)
