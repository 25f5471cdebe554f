"""Stages with contracts: schema checks before any job, quarantine, accounts, and restart at the last finished stage."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.functions import cells, puzzles
from gridspark.operators import quads as Q
from gridspark.operators import recognizers as R
from gridspark.operators import solver
from gridspark.session import materialise, scratch

REFUSED = "refused"  # a stage sets it to the reason why a row goes no further
FEW_VECTORS = 100_000  # glyph vectors whose readings (a key, a digit, a confidence) are sent to every task
ACCOUNT = "number int, stage string, contract string, rows_in bigint, rows_out bigint, refused bigint"


class ContractError(ValueError):
    """A stage does not get, give or keep what it must."""


@dataclass(frozen=True)
class Stage:
    """One row in, one row out, with columns added; ``needs`` and ``gives`` are column lists as in DDL.

    ``work`` keeps every column it gets. It may add ``refused``: rows with a reason are put aside. ``version``
    is to change when ``work`` changes, so that results of the old one are not taken up again.
    """

    name: str
    work: Callable[[DataFrame], DataFrame]
    needs: str = ""
    gives: str = ""
    version: str = "1"


@dataclass
class Run:
    """``kept``: rows that passed all stages. ``refused``: key, stage, reason. ``accounts``: a row per stage."""

    kept: DataFrame
    refused: DataFrame
    accounts: DataFrame
    resumed: list[str] = field(default_factory=list)

    def outcomes(self, key: str) -> DataFrame:
        """Every image once: the stage that put it aside and why, or NULL and NULL."""
        passed = self.kept.select(key, F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("reason"))
        return self.refused.unionByName(passed)


def _types(columns: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in StructType.fromDDL(columns).fields} if columns else {}


def check_contracts(schema: StructType, stages: list[Stage]) -> None:
    """Every edge of the chain, from declarations alone: no job runs before all of them fit."""
    have = {f.name: f.dataType.simpleString() for f in schema.fields}
    if REFUSED in have:
        raise ContractError(f"the input has a column {REFUSED}")
    names = [s.name for s in stages]
    if len(set(names)) < len(names):
        raise ContractError(f"stage names repeat: {names}")
    for stage in stages:
        for column, kind in _types(stage.needs).items():
            if have.get(column) != kind:
                raise ContractError(f"{stage.name} needs {column} {kind}, there is {have.get(column, 'none')}")
        given = _types(stage.gives)
        if clash := [c for c in given if c in have or c == REFUSED]:
            raise ContractError(f"{stage.name} gives {clash}, which exist already")
        have |= given


def _checked(stage: Stage, before: DataFrame, after: DataFrame) -> DataFrame:
    found = {f.name: f.dataType.simpleString() for f in after.schema.fields}
    promised = {f.name: f.dataType.simpleString() for f in before.schema.fields} | _types(stage.gives)
    for column, kind in promised.items():
        if found.get(column) != kind:
            raise ContractError(f"{stage.name} owes {column} {kind}, it gave {found.get(column, 'none')}")
    reason = F.col(REFUSED) if REFUSED in found else F.lit(None)
    return after.select(*promised, reason.cast("string").alias(REFUSED))


def _finished(spark: SparkSession, place: str) -> dict[int, tuple]:
    """Accounts of stages that an earlier run wrote to the end."""
    try:
        return {r["number"]: r for r in spark.read.schema(ACCOUNT).parquet(f"{place}/accounts/*").collect()}
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}


def run_pipeline(images: DataFrame, stages: list[Stage], key: str, place: str | None = None) -> Run:
    """Run the stages one after the other, each written to ``place`` and read back by the next.

    Rows are accounted for: what goes into a stage comes out or is put aside, else ContractError. A stage's account
    is written after its table; a run that finds the accounts of an earlier one at ``place``, for the same input columns,
    stages and versions, begins behind the last of them. Without ``place`` the tables go beside the checkpoints.
    """
    check_contracts(images.schema, stages)
    spark = images.sparkSession
    place = place or scratch(spark, "pipeline")
    done, resumed, accounts = _finished(spark, place), [], []
    rows, n_in, contract = images, None, hashlib.sha256(images.schema.simpleString().encode())
    aside = []
    for number, stage in enumerate(stages):
        contract.update(repr((stage.name, stage.needs, stage.gives, stage.version)).encode())
        folder = f"{place}/{number:02d}-{stage.name}"
        account = done.get(number)
        if account is not None and account["contract"] == contract.hexdigest() and len(resumed) == number:
            table = spark.read.parquet(folder)
            resumed.append(stage.name)
        else:
            _checked(stage, rows, rows.transform(stage.work)).write.mode("overwrite").parquet(folder)
            table = spark.read.parquet(folder)
            total, out = table.agg(F.count(F.lit(1)), F.count_if(F.col(REFUSED).isNull())).first()
            n_in = images.count() if n_in is None else n_in
            if total != n_in:
                raise ContractError(f"{stage.name} got {n_in} rows and gave {total}")
            account = (number, stage.name, contract.hexdigest(), n_in, out, total - out)
            spark.createDataFrame([account], ACCOUNT).coalesce(1).write.mode("overwrite").parquet(f"{place}/accounts/{number:02d}")
        accounts.append(tuple(account))
        n_in = accounts[-1][4]
        aside.append(table.where(F.col(REFUSED).isNotNull()).select(key, F.lit(stage.name).alias("stage"), F.col(REFUSED).alias("reason")))
        rows = table.where(F.col(REFUSED).isNull()).drop(REFUSED)
    refused = aside[0]
    for more in aside[1:]:
        refused = refused.unionByName(more)
    listed = spark.createDataFrame(accounts, ACCOUNT).select("number", "stage", "rows_in", "rows_out", "refused")
    return Run(rows, refused, listed, resumed)


# --- the stages from image to solution ---------------------------------------

CORNERS = "array<struct<x:double,y:double>>"


def locate(quads: DataFrame, width: int, height: int, key: str = "image_id", kind: str = "bigint") -> Stage:
    """The best quad of an image by area, squareness and centre; images without a candidate are put aside."""
    best = lambda: Q.best_per_group(
        Q.with_score3(Q.keep_candidates(quads, F.lit(width * height)), F.lit(width), F.lit(height), key),
        key, F.col("score3"), "quad_id", ["corners"])

    def work(images: DataFrame) -> DataFrame:
        # Columns of the images keep their places; a quad id may be NULL nowhere else.
        found = images.join(best(), key, "left")
        return found.withColumn(REFUSED, F.when(F.col("quad_id").isNull(), "No grid was found"))

    return Stage("locate", work, f"{key} {kind}", f"quad_id string, corners {CORNERS}, score double")


def cells_of(drawn: DataFrame, glyphs: str = "glyphs", key: str = "image_id", kind: str = "bigint") -> Stage:
    """81 references to glyph vectors an image, NULL for an empty cell, from a table with one row per image."""
    def work(images: DataFrame) -> DataFrame:
        found = images.join(drawn.select(key, F.col(glyphs).alias("glyphs")), key, "left")
        whole = F.coalesce(F.size("glyphs") == 81, F.lit(False))
        return found.withColumn(REFUSED, F.when(~whole, "The grid has not 81 cells"))

    return Stage("cells", work, f"{key} {kind}, corners {CORNERS}", "glyphs array<bigint>")


def recognise(vectors: DataFrame, glyph: str, vec: str, model: str | None = None, key: str = "image_id", kind: str = "bigint") -> Stage:
    """Digit and confidence of every cell by the registered recogniser; empty cells never reach it.

    A vector is read once, however many cells show it. Up to FEW_VECTORS vectors are all read and their readings sent to every
    task, where images stay in their rows; of more, those shown are read, and cells unfold to meet their readings.
    """
    def work(images: DataFrame) -> DataFrame:
        known = vectors.select(F.col(glyph).alias("glyph"), F.col(vec).alias("vec")).where("glyph IS NOT NULL AND vec IS NOT NULL")
        if known.limit(FEW_VECTORS + 1).count() <= FEW_VECTORS:
            rows = R.recognize(known, "vec", model, empty_threshold=None).select("glyph", "digit", "conf").collect()
            found = images.withColumn("_r", looked_up(images.sparkSession, rows)("glyphs")).select(
                *images.columns, "_r.digits", "_r.confs", F.col("_r.lost").alias("_lost"))
        else:
            cells_ = images.select(key, F.posexplode("glyphs").alias("idx", "glyph"))
            shown = known.join(cells_.select("glyph").distinct(), "glyph", "left_semi")
            read = R.recognize(shown, "vec", model, empty_threshold=None).groupBy("glyph").agg(F.min(F.struct("digit", "conf")).alias("_r"))
            seen = cells_.join(read.select("glyph", "_r.*"), "glyph", "left")
            lost = F.col("glyph").isNotNull() & F.col("digit").isNull()
            cell = F.struct("idx", F.coalesce("digit", F.lit(0)).alias("digit"), F.coalesce("conf", F.lit(1.0)).alias("conf"))
            readings = seen.groupBy(key).agg(F.array_sort(F.collect_list(cell)).alias("_r"), F.count_if(lost).alias("_lost"))  # 81 an image
            found = images.join(readings.select(key, F.col("_r.digit").alias("digits"), F.col("_r.conf").alias("confs"), "_lost"), key)
        return found.withColumn(REFUSED, F.when(F.col("_lost") > 0, "A cell has no image"))

    return Stage("recognise", work, f"{key} {kind}, glyphs array<bigint>", "digits array<int>, confs array<double>")


def looked_up(spark: SparkSession, readings: list):
    """Function of an array of glyphs: digits and confs in their places, and how many glyphs have no reading. NULL is an empty cell."""
    readings = sorted(tuple(r) for r in readings)
    table = spark.sparkContext.broadcast((
        np.array([r[0] for r in readings], np.int64), np.array([r[1] for r in readings], np.int32), np.array([r[2] for r in readings], np.float64)))

    @F.arrow_udf("digits array<int>, confs array<double>, lost bigint")
    def look_up(glyphs: pa.Array) -> pa.Array:
        keys, digit, conf = table.value
        flat = glyphs.flatten()
        ends = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(glyphs), 0).to_numpy(zero_copy_only=False))]
        shown = pc.is_valid(flat).to_numpy(zero_copy_only=False)
        ids = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(keys, ids), max(0, len(keys) - 1))
        hit = shown & (keys[at] == ids) if len(keys) else np.zeros(len(ids), bool)
        digits, confs = np.zeros(len(ids), np.int32), np.ones(len(ids))
        digits[hit], confs[hit] = digit[at[hit]], conf[at[hit]]
        lost = np.r_[0, np.cumsum(shown & ~hit)]
        lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values)) for values in (digits, confs)]
        return pa.StructArray.from_arrays([*lists, pa.array(lost[ends[1:]] - lost[ends[:-1]])], ["digits", "confs", "lost"])

    return look_up


def validate() -> Stage:
    """Rules of the puzzle and the least number of clues, with the messages of the solve response."""
    def work(images: DataFrame) -> DataFrame:
        clues = F.col("digits")
        wrong = F.when(~puzzles.is_valid_grid(clues), cells.invalid_message(puzzles.violations(clues))).when(
            ~cells.has_min_clues(clues), F.lit(f"At least {cells.MIN_CLUES} clues are needed"))
        return images.withColumn("clues", clues).withColumn(REFUSED, wrong)

    return Stage("validate", work, "digits array<int>", "clues array<int>")


def solve(key: str = "image_id", kind: str = "bigint", **budget) -> Stage:
    """One search per distinct grid; its solution is verified against rules and clues there, and goes to its images."""
    def work(images: DataFrame) -> DataFrame:
        grids = materialise(solver.distinct_grids(images, "clues"))
        answer, clues = puzzles.grid_cells(F.col("solution")), puzzles.grid_cells(F.col("grid"))
        sound = puzzles.is_solution(answer) & puzzles.agrees_with_clues(clues, answer)
        reason = F.when(F.col("timed_out"), solver.TIMED_OUT).when(~F.coalesce(sound, F.lit(False)), "Could not find valid solution.")
        verdict = solver.solve_grids(grids, **budget).select(
            F.col("grid").alias("_grid"), F.coalesce("solution", F.lit("")).alias("solution"), reason.alias(REFUSED))
        return solver.with_verdict(images.withColumn("_grid", puzzles.grid_text(F.col("clues"))), verdict, grids, "_grid")

    return Stage("solve", work, f"{key} {kind}, clues array<int>", "solution string")
