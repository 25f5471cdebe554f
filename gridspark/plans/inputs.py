"""Inputs of the registered queries, derived from the driver tables by plain arithmetic.

Each input exists twice: as a DataFrame and as a common table expression for the checking
SQL. All of them cover their whole source table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.functions.binding import computed, int_matrix
from gridspark.functions.vectors import minmax
from gridspark.operators.scoring import score_cells
from gridspark.sources.readers import read_table

WIDTH, HEIGHT = 900, 700


def cte(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Use all cores when the scan has fewer splits than there are cores.

    The inputs multiply or heavily compute on few bytes per row; a large table has enough
    splits and is left alone. A unique key also serves the grouping that follows; without
    one the rows go round robin, so that no key can gather in a task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key) if key else df.repartition(cores)


# --- puzzles: every order is a puzzle with a known solution -----------------

_SOL = "(({r})*3 + ({band}) + ({c}) + {id} % 45) % 9 + 1"
_BLANK = "(({r})*31 + ({c})*17 + ({id} % 45)*7 + ({r})*({c})*5) % {m} < 2"

IDX81 = "idx81 AS (SELECT range AS idx FROM range(0, 81))"
CELLS = f"""fx_cells AS (
  SELECT o_orderkey AS image_id, idx, idx//9 AS r, idx%9 AS c, (idx//27)*3 + (idx%9)//3 AS box,
         {_SOL.format(r="idx//9", band="idx//27", c="idx%9", id="o_orderkey")} AS sol,
         CASE WHEN {_BLANK.format(r="idx//9", c="idx%9", id="o_orderkey", m=5)} THEN 0
              ELSE {_SOL.format(r="idx//9", band="idx//27", c="idx%9", id="o_orderkey")} END AS clue
  FROM orders CROSS JOIN idx81)"""
BAD_CELLS = """fx_bad AS (
  SELECT image_id, idx, r, c, box,
         CASE WHEN image_id % 7 = 0 AND idx < 2 THEN image_id % 45 % 9 + 1 ELSE clue END AS clue
  FROM fx_cells)"""

READING = """CASE WHEN clue = 0 AND h < 20 THEN 1 + h2 % 9 WHEN clue = 0 THEN 0 WHEN h < 150 THEN 0
     WHEN h < 250 THEN clue % 9 + 1 ELSE clue END"""
_BEST = """CASE WHEN clue = 0 THEN 1 + h2 % 9 WHEN h >= 150 AND h < 250 THEN clue % 9 + 1 ELSE clue END"""
CONF = "CASE WHEN clue <> 0 AND h < 50 THEN 1.0D ELSE h2 / 1000.0D END"
CELL = "CASE WHEN (image_id*31 + idx) % 50 = 0 THEN array(clue, clue % 9 + 1) ELSE array(clue) END"
SCORED = f"""fx_scored AS (
  SELECT *, len(list_filter(cell, lambda v: v <> 0)) > 0 AS filled,
         list_contains(cell, predicted) AS correct,
         coalesce(list_filter(cell, lambda v: v <> 0)[1], 0) AS gt_digit
  FROM (SELECT image_id, idx, r, c, image_id % 10 <> 3 AS detected, clue,
          {READING} AS predicted, {_BEST} AS best_digit, clue <> 0 AND h < 50 AS is_filtered,
          CASE WHEN clue <> 0 AND h < 50 THEN 1.0 ELSE h2 / 1000.0 END AS conf,
          CASE WHEN (image_id*31 + idx) % 50 = 0 THEN [clue, clue % 9 + 1] ELSE [clue] END AS cell
        FROM (SELECT *, (image_id*7919 + idx*104729) % 1000 AS h,
                     (image_id*611953 + idx*7907) % 1000 AS h2 FROM fx_cells)))"""
SCORED_CTE = cte(IDX81, CELLS, SCORED)


def unfold_cells(images: DataFrame) -> DataFrame:
    """81 cells per image row (needs image_id, keeps the rest). Works on streams too."""
    sol = _SOL.format(r="r", band="r div 3", c="c", id="image_id")
    blank = _BLANK.format(r="r", c="c", id="image_id", m=5)
    return (
        images.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(80).cast("bigint"))).alias("idx"))
        .selectExpr("*", "idx div 9 AS r", "idx % 9 AS c")
        .selectExpr("*", f"{sol} AS sol")
        .selectExpr("*", f"CASE WHEN {blank} THEN 0 ELSE sol END AS clue")
    )


def read_cells(cell_rows: DataFrame, *keep: str) -> DataFrame:
    """Simulated readings of long cells, with every class of error."""
    numbered = cell_rows.selectExpr(
        "*", "(image_id*7919 + idx*104729) % 1000 AS h", "(image_id*611953 + idx*7907) % 1000 AS h2"
    )
    return computed(
        numbered.withColumn("detected", F.expr("image_id % 10 <> 3")),
        *keep, "image_id", "idx", "r", "c", "detected",
        clue="clue", predicted=READING, best_digit=_BEST,
        is_filtered="clue <> 0 AND h < 50",
        conf=CONF, cell=CELL,
    )


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Long cells: image_id, idx, r, c, sol, clue. Generated where the order row is read."""
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    return unfold_cells(spread(orders, "image_id"))


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return read_cells(cells(spark, sf))


def cell_arrays(spark: SparkSession, sf: str, **arrays: str) -> DataFrame:
    """image_id and arrays over the 81 cells of each image, from expressions of clue, idx, h and h2.

    Only keys are dealt and ordered: tables of arrays of one image meet where they are, unmoved and unsorted.
    """
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    tasks = max(orders.sparkSession.sparkContext.defaultParallelism, orders.rdd.getNumPartitions())
    return with_cell_arrays(orders.repartition(tasks, "image_id").sortWithinPartitions("image_id"), **arrays)


def with_cell_arrays(images: DataFrame, **arrays: str) -> DataFrame:
    """The same arrays beside the columns of ``images``, worked out where the row is."""
    clues = images.select("*", grid_columns(key="image_id")["clues"].alias("clues"))
    hashes = {"h": "((image_id*7919 + idx*104729) % 1000)", "h2": "((image_id*611953 + idx*7907) % 1000)"}
    of_cell = lambda e: re.sub(r"\bh2?\b", lambda m: hashes[m[0]], e)
    return clues.select(*images.columns, *[
        F.expr(f"transform(clues, (clue, idx) -> {of_cell(e)})").alias(name) for name, e in arrays.items()
    ])


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return score_cells(readings(spark, sf))


def _patterns(modulus: int, bad: bool) -> tuple[list[list[int]], list[list[int]]]:
    """Clues and solution per residue of the key modulo 45, by the rule of CELLS."""
    sols, clues = [], []
    for k in range(45):
        sol = [(i // 9 * 3 + i // 27 + i % 9 + k) % 9 + 1 for i in range(81)]
        clue = [
            0 if (i // 9 * 31 + i % 9 * 17 + k * 7 + (i // 9) * (i % 9) * 5) % modulus < 2 else v
            for i, v in enumerate(sol)
        ]
        sols.append(sol)
        clues.append([k % 9 + 1] * 2 + clue[2:] if bad else clue)
    return clues, sols


def grid_columns(modulus: int = 5, bad: bool = False, key: str = "puzzle_id") -> dict:
    """Expressions for clues and solution as 81-element arrays: a lookup by residue."""
    slot = (F.col(key) % 45).cast("int")
    clues, sols = _patterns(modulus, False)
    grid = int_matrix(clues)[slot]
    if bad:
        spoiled = int_matrix(_patterns(modulus, True)[0])[slot]
        grid = F.when(F.col(key) % 7 == 0, spoiled).otherwise(grid)
    return {"clues": grid, "sol": int_matrix(sols)[slot]}


def grids(spark: SparkSession, sf: str, modulus: int = 5, bad: bool = False) -> DataFrame:
    """One row per puzzle: puzzle_id, clues and solution as 81-element arrays."""
    orders = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("puzzle_id"))
    return computed(spread(orders, "puzzle_id"), "puzzle_id", **grid_columns(modulus, bad))


# --- candidate quads: every line item is a quad in the image of its order ---

QUADS = f"""fx_quads AS (
  SELECT *, w * h AS area, x0 + w/2.0 AS cx, y0 + h/2.0 AS cy
  FROM (SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey,
          l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) AS quad_id,
          l_partkey % 400 AS x0, (l_suppkey*13) % 300 AS y0,
          20 + CAST(l_quantity AS BIGINT)*8 AS w, 20 + (l_partkey*7) % 360 AS h FROM lineitem))"""
SCORED_QUADS = f"""fx_scored_quads AS (
  SELECT *, CASE WHEN top > 0 THEN CAST(area AS DOUBLE)/top ELSE 0.0 END AS area_norm,
         least(w+1, h+1)::DOUBLE / greatest(w+1, h+1) AS square,
         1 - sqrt((cx-{WIDTH}/2.0)*(cx-{WIDTH}/2.0) + (cy-{HEIGHT}/2.0)*(cy-{HEIGHT}/2.0))
           / sqrt({WIDTH}/2.0*{WIDTH}/2.0 + {HEIGHT}/2.0*{HEIGHT}/2.0) AS centre
  FROM (SELECT *, max(area) OVER (PARTITION BY image_id) AS top FROM fx_quads))"""


QUAD_AREA = "(20 + quantity*8) * (20 + (l_partkey*7) % 360)"


def quad_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The five whole numbers that all of a quad follows from: what is worth moving of it."""
    return spread(read_table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS image_id", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT) AS quantity"
    ))


def as_quads(rows: DataFrame) -> DataFrame:
    """``quad_rows``, with or without further columns, as quads: quad_id, corners, area and the numbers they came from."""
    base = rows.selectExpr(
        *[c for c in rows.columns if c != "quantity"],
        "concat_ws('-', l_linenumber, l_partkey, l_suppkey, quantity) AS quad_id",
        "l_partkey % 400 AS x0", "(l_suppkey*13) % 300 AS y0", "20 + quantity*8 AS w", "20 + (l_partkey*7) % 360 AS h",
    )
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return computed(
        base, *base.columns,
        corners=G.quad((x0, y0), (x1, y0), (x1, y1), (x0, y1)), area=F.col("w") * F.col("h"),
    )


def quads(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, quad_id, corners, area and the numbers they came from."""
    return as_quads(quad_rows(spark, sf))


# --- detections: every order is an image with a true and a found quad -------

DETECTIONS = """fx_detections AS (
  SELECT o_orderkey AS image_id, o_orderkey % 10 <> 3 AS detected,
         o_orderkey % 200 AS x0, (o_orderkey*13) % 150 AS y0, 300 + o_custkey % 200 AS w,
         300 + (o_orderkey*7) % 150 AS h, o_orderkey % 5 AS dx, o_custkey % 7 AS dy
  FROM orders)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """image_id, detected, truth and found corners (NULL where undetected)."""
    base = read_table(spark, sf, "orders").selectExpr(
        "o_orderkey AS image_id", "o_orderkey % 10 <> 3 AS detected",
        "o_orderkey % 200 AS x0", "(o_orderkey*13) % 150 AS y0", "300 + o_custkey % 200 AS w",
        "300 + (o_orderkey*7) % 150 AS h", "o_orderkey % 5 AS dx", "o_custkey % 7 AS dy",
    )
    c = F.col
    box = lambda x, y, w, h: G.quad((x, y), (x + w, y), (x + w, y + h), (x, y + h))
    return computed(
        spread(base, "image_id"), "image_id", "detected",
        truth=box(c("x0"), c("y0"), c("w"), c("h")),
        found=F.when(
            c("detected"),
            box(c("x0") + c("dx"), c("y0") + c("dy"), c("w") + c("dx"), c("h") - c("dy")),
        ),
    )


# --- experiments: every part is a configuration -----------------------------

RUNS = """fx_runs AS (
  SELECT p_partkey AS name, 2 + p_partkey % 3 AS depth, p_brand AS family, CAST(p_size AS BIGINT) AS parameters,
         p_size % 3 AS dropout, 900 + (p_partkey*37) % 100 AS synth, (p_partkey*7919) % 1000 AS real_acc
  FROM part)"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "part").selectExpr(
        "p_partkey AS name", "2 + p_partkey % 3 AS depth", "p_brand AS family",
        "CAST(p_size AS BIGINT) AS parameters", "p_size % 3 AS dropout",
        "900 + (p_partkey*37) % 100 AS synth", "(p_partkey*7919) % 1000 AS real_acc",
    )


# --- events as epochs, latencies, history -----------------------------------

EPOCHS = """fx_epochs AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
         value AS val_acc FROM events)"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr("user_id AS key", "value AS ms", "event_type <> 'error' AS ok")


def history(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).selectExpr(
        "user_id", "event_id", "ts", "event_type AS source", "event_id % 10 = 0 AS is_favorite"
    )


# --- vectors ----------------------------------------------------------------

def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.col("label").cast("bigint").alias("label")
    )


VECTORS = "fx_vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS vec, CAST(label AS BIGINT) AS label FROM embeddings)"
# Pixel form: vectors stretched to 0..255 whole levels.
PIXELS = """fx_pixels AS (
  SELECT vec_id, label, list_transform(vec, lambda v: CAST(floor((v - list_min(vec)) / (list_max(vec) - list_min(vec)) * 255 + 0.5) AS BIGINT)) AS px
  FROM fx_vectors)"""


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    levels = F.transform(minmax(F.col("vec")), lambda v: F.floor(v + 0.5))
    return computed(vectors(spark, sf), "vec_id", "label", px=levels)
