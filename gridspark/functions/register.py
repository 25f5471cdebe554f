"""SQL names for the scalar functions: temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from gridspark.functions.geometry import quad_iou_flat

SQL_FUNCTIONS = {
    "grid_clue_count(g ARRAY<INT>) RETURNS INT": "size(filter(g, v -> v <> 0))",
    "grid_has_min_clues(g ARRAY<INT>) RETURNS BOOLEAN": "size(filter(g, v -> v <> 0)) >= 17",
    "grid_difficulty(clues INT) RETURNS STRING":
        "CASE WHEN clues >= 36 THEN 'Easy' WHEN clues >= 28 THEN 'Medium' "
        "WHEN clues >= 22 THEN 'Hard' ELSE 'Expert' END",
    "cell_first_nonzero(c ARRAY<INT>) RETURNS INT":
        "coalesce(try_element_at(filter(c, v -> v <> 0), 1), 0)",
    "cell_coerce(c ARRAY<INT>) RETURNS INT": "IF(size(c) > 1, 0, try_element_at(c, 1))",
    "cell_is_filled(c ARRAY<INT>) RETURNS BOOLEAN": "array_max(c) > 0",
    "cell_matches(p INT, c ARRAY<INT>) RETURNS BOOLEAN": "array_contains(c, p)",
    "confidence_band(digit INT, conf DOUBLE) RETURNS STRING":
        "CASE WHEN digit = 0 THEN 'none' WHEN conf >= 0.8 THEN 'high' "
        "WHEN conf >= 0.5 THEN 'medium' ELSE 'low' END",
    "detector_confidence(area DOUBLE, image_area DOUBLE) RETURNS DOUBLE":
        "CASE WHEN area / image_area > 0.05 THEN least(1.0D, area / image_area / 0.5D) ELSE 0.0D END",
    "vec_invert(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE>": "transform(v, x -> 255.0D - x)",
    "vec_mean(v ARRAY<DOUBLE>) RETURNS DOUBLE": "aggregate(v, 0.0D, (a, x) -> a + x) / size(v)",
    "vec_white_ratio(v ARRAY<DOUBLE>) RETURNS DOUBLE": "size(filter(v, x -> x = 255)) / size(v)",
    "path_basename(p STRING) RETURNS STRING": "regexp_extract(p, '([^/]+)/*$', 1)",
    "blended_accuracy(f DOUBLE, e DOUBLE) RETURNS DOUBLE": "0.5D * f + 0.5D * e",
    "poly_area(p ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>) RETURNS DOUBLE":
        "abs(aggregate(zip_with(p, concat(slice(p, 2, size(p) - 1), slice(p, 1, 1)), "
        "(a, b) -> a.x * b.y - b.x * a.y), 0.0D, (s, t) -> s + t)) / 2",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for signature, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("quad_iou", quad_iou_flat)
    return [s.split("(")[0] for s in SQL_FUNCTIONS] + ["quad_iou"]
