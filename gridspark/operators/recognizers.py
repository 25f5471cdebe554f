"""Batch recognisers, the built-in nearest-centroid model, training and grid search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gridspark.functions import cells
from gridspark.functions import vectors as V
from gridspark.functions.binding import computed
from gridspark.operators.scoring import safe_divide
from gridspark.session import materialise

# A recogniser maps an (n, d) float array to (digits, confidences).
Predictor = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]
PREDICTION = StructType([StructField("digit", IntegerType()), StructField("conf", DoubleType())])
_LOADERS: dict[str, Callable[[], Predictor]] = {}
_DEFAULT: list[str] = []


def register_recognizer(name: str, load: Callable[[], Predictor], default: bool = False) -> None:
    """``load`` builds the predictor; it runs once per task, not once per batch."""
    _LOADERS[name] = load
    if default or not _DEFAULT:
        _DEFAULT[:] = [name]


def recognize(
    df: DataFrame, vec: str, name: str | None = None,
    empty_threshold: float | None = cells.EMPTY_THRESHOLD, empty: Column | None = None,
) -> DataFrame:
    """Add digit and conf. Empty cells get (0, 1.0) and never reach the model.

    Empty means a mean intensity below the threshold, or a test of the caller's own.
    """
    load = _LOADERS[name or _DEFAULT[0]]

    @F.pandas_udf(PREDICTION)
    def predict_cells(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        predict = load()
        for cells_in in batches:
            out = pd.DataFrame({
                "digit": np.zeros(len(cells_in), dtype=np.int32), "conf": np.ones(len(cells_in))
            })
            seen = cells_in.notna().to_numpy()
            if seen.any():
                digits, confs = predict(np.stack(cells_in[seen].to_list()).astype(float))
                out.loc[seen, "digit"] = digits.astype(np.int32)
                out.loc[seen, "conf"] = confs
            yield out

    vector = F.col(vec)
    if empty is None and empty_threshold is not None:
        empty = cells.is_empty_vector(V.as_doubles(vector), empty_threshold)
    if empty is not None:
        # Vectors of empty cells stay in the JVM; one scan serves both kinds.
        vector = F.when(~empty, vector)
    prepared = computed(df, *df.columns, _x=vector)
    return prepared.withColumn("_p", predict_cells("_x")).select(*df.columns, "_p.digit", "_p.conf")


def gate(probs: np.ndarray, threshold: float = cells.CONFIDENCE_THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Digit of the best class 1-9 and its probability; below the threshold the digit is 0."""
    best = probs[:, 1:].argmax(axis=1) + 1
    conf = probs[np.arange(len(probs)), best]
    return np.where(conf < threshold, 0, best), conf


def centroids(train: DataFrame, vec: str, label: str) -> np.ndarray:
    """(10, d) class means. Summed in Spark; what is returned is ten vectors."""
    means = (
        train.select(label, F.posexplode(V.as_doubles(F.col(vec))).alias("pos", "v"))
        .groupBy(label, "pos").agg(F.avg("v").alias("m"))
        .groupBy(label).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("ms"))
        .select(label, F.transform("ms", lambda s: s["m"]).alias("mean"))
    )
    rows = means.collect()
    out = np.full((10, len(rows[0]["mean"])), np.inf)
    for row in rows:
        out[row[label]] = row["mean"]
    return out


def centroid_predictor(means: np.ndarray, threshold: float = cells.CONFIDENCE_THRESHOLD) -> Predictor:
    """Softmax of the negative distance to each class mean."""
    def predict(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.sqrt(((x[:, None, :] - means[None, :, :]) ** 2).sum(axis=2))
        e = np.exp(d.min(axis=1, keepdims=True) - d)
        return gate(e / e.sum(axis=1, keepdims=True), threshold)

    return predict


# --- MLlib ------------------------------------------------------------------

def _features(df: DataFrame, vec: str, label: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    weight = F.when(F.col(label) == 0, F.lit(2.0)).otherwise(F.lit(1.0))
    return df.withColumns({
        "features": array_to_vector(V.as_doubles(F.col(vec))),
        "label": F.col(label).cast("double"), "weight": weight,
    })


def train_classifier(train: DataFrame, vec: str, label: str, max_iter: int = 30, reg: float = 0.0):
    """Ten-class fit in which the empty class weighs twice."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(maxIter=max_iter, regParam=reg, weightCol="weight")
    return model.fit(_features(train, vec, label))


def evaluate_classifier(model, test: DataFrame, vec: str, label: str) -> DataFrame:
    """One row: rows, accuracy, weighted log loss."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_features(test, vec, label)).withColumn("p", vector_to_array("probability"))
    hit = F.col("prediction") == F.col("label")
    loss = -F.log(F.greatest(F.element_at("p", F.col("label").cast("int") + 1), F.lit(1e-15)))
    return scored.agg(
        F.count("*").alias("n"), safe_divide(F.count_if(hit), F.count("*")).alias("accuracy"),
        (F.sum(loss * F.col("weight")) / F.sum("weight")).alias("loss"),
    )


def grid_search(train: DataFrame, test: DataFrame, vec: str, label: str, configs: list[dict], done: DataFrame | None = None) -> DataFrame:
    """One result row per configuration not in ``done``; state and error tell which ones failed.

    Each fit is a Spark job over the whole training table; only metrics reach the driver.
    """
    names = set() if done is None else {r["name"] for r in done.select("name").collect()}
    rows = []
    for config in configs:
        if config["name"] in names:
            continue
        params = {k: v for k, v in config.items() if k != "name"}
        try:
            model = train_classifier(train, vec, label, **params)
            result = evaluate_classifier(model, test, vec, label).first()
        except Exception as error:  # one bad setting must not end the study
            rows.append((config["name"], None, None, None, "failed", str(error)))
            continue
        rows.append((config["name"], result["n"], result["accuracy"], result["loss"], "done", None))
    new = train.sparkSession.createDataFrame(
        rows, "name string, n bigint, accuracy double, loss double, state string, error string")
    return new if done is None else done.select(new.columns).unionByName(new)


# --- training by epochs -----------------------------------------------------

STUDY = (
    "name string, depth int, width int, parameters bigint, best_val_acc double, best_epoch int, epochs_run int, "
    "test_acc double, test_loss double, test_acc_aug double, test_loss_aug double, state string, error string"
)


def _network_rows(df: DataFrame, vec: str, label: str, scale: float) -> DataFrame:
    """Features and label; the empty class comes twice, because networks take no weights of rows."""
    from pyspark.ml.functions import array_to_vector

    scaled = F.transform(V.as_doubles(F.col(vec)), lambda v: v / scale)
    copies = F.when(F.col(label) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return df.select(array_to_vector(scaled).alias("features"), F.col(label).cast("double").alias("label"), copies.alias("copies"))


def _measure(model, rows: DataFrame) -> tuple[float, float]:
    """(accuracy, log loss) in one aggregate; an empty table gives (0, 0)."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows).withColumn("p", vector_to_array("probability"))
    loss = -F.log(F.greatest(F.element_at("p", F.col("label").cast("int") + 1), F.lit(1e-15)))
    got = scored.agg(safe_divide(F.count_if(F.col("prediction") == F.col("label")), F.count("*")).alias("acc"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("loss")).first()
    return float(got["acc"]), float(got["loss"])


def train_epochs(train: DataFrame, val: DataFrame, hidden: list[int], size: int, epochs: int, patience: int, block: int = 1, seed: int = 42):
    """(best model, history): a network trained block by block, each begun with the weights of the one before.

    After every block the validation accuracy is taken. ``patience`` blocks without a better one end the
    training; the model of the best block is the result. ``train`` and ``val`` are rows of ``_network_rows``. History rows:
    (epoch, val_acc, val_loss). Only weights and measures reach the driver.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    weights, best, best_acc, misses, history = None, None, -1.0, 0, []
    for epoch in range(block, epochs + 1, block):
        step = MultilayerPerceptronClassifier(layers=[size, *hidden, 10], maxIter=block, seed=seed, blockSize=128, tol=0.0)
        if weights is not None:
            step = step.setInitialWeights(weights)
        model = step.fit(train)
        weights = model.weights
        acc, loss = _measure(model, val)
        history.append((epoch, acc, loss))
        if acc > best_acc:
            best, best_acc, misses = model, acc, 0
        else:
            misses += 1
            if misses >= patience:
                break
    return best, history


def study(
    train: DataFrame, val: DataFrame, test: DataFrame, test_aug: DataFrame, vec: str, label: str, configs: DataFrame,
    place: str, epochs: int, patience: int, block: int = 1, scale: float = 255.0, seed: int = 42,
) -> DataFrame:
    """The same protocol for every configuration (name, depth, width); one result row each.

    Each row is appended to ``place`` as soon as its configuration is finished, failed ones with their error, and
    configurations that have a row there are left out by an anti-join. So an interrupted study goes on where it
    stopped, and ends with the rows of one that was not. Training rows are prepared and checkpointed once, not per fit.
    """
    from pyspark.errors import AnalysisException

    spark = train.sparkSession
    try:
        done = spark.read.schema(STUDY).parquet(place)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        done = spark.createDataFrame([], STUDY)
    todo = configs.join(done.select("name"), "name", "left_anti").orderBy("name").collect()  # the grid, not the data
    if todo:
        fit_rows = materialise(_network_rows(train, vec, label, scale).withColumn("copy", F.explode("copies")).drop("copies", "copy"))
        val_rows, clean, noisy = (materialise(_network_rows(t, vec, label, scale).drop("copies")) for t in (val, test, test_aug))
        size = fit_rows.first()["features"].size
    for config in todo:
        hidden = [config["width"]] * config["depth"]
        shape = [size, *hidden, 10]
        parameters = sum((a + 1) * b for a, b in zip(shape, shape[1:]))
        base = (config["name"], config["depth"], config["width"], parameters)
        try:
            model, history = train_epochs(fit_rows, val_rows, hidden, size, epochs, patience, block, seed)
            best = max(history, key=lambda h: (h[1], -h[0]))
            row = (*base, best[1], best[0], history[-1][0], *_measure(model, clean), *_measure(model, noisy), "done", None)
        except Exception as error:  # one bad setting must not end the study
            row = (*base, *[None] * 7, "failed", str(error)[:500])
        spark.createDataFrame([row], STUDY).coalesce(1).write.mode("append").parquet(place)
    return spark.read.schema(STUDY).parquet(place)
