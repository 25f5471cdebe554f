"""Vector columns: normalisation, statistics, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.binding import int_array, let, total


def as_doubles(vec: Column) -> Column:
    return vec.cast("array<double>")


def softmax(logits: Column) -> Column:
    """Max-shifted softmax."""
    shifted = let(
        F.struct(logits.alias("v"), F.array_max(logits).alias("top")),
        lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])),
    )
    return let(
        let(shifted, lambda e: F.struct(e.alias("e"), total(e).alias("s"))),
        lambda s: F.transform(s["e"], lambda x: x / s["s"]),
    )


def invert(vec: Column) -> Column:
    return F.transform(vec, lambda x: F.lit(255.0) - x)


def minmax(vec: Column, low: float = 0.0, high: float = 255.0) -> Column:
    """Stretch to [low, high]; a constant vector maps to ``low``."""
    return let(
        F.struct(vec.alias("v"), F.array_min(vec).alias("a"), F.array_max(vec).alias("b")),
        lambda s: F.transform(
            s["v"],
            lambda x: F.when(
                s["b"] > s["a"], (x - s["a"]) / (s["b"] - s["a"]) * (high - low) + low
            ).otherwise(F.lit(low)),
        ),
    )


def vector_stats(vec: Column) -> Column:
    """struct(mean, std) with the population deviation."""
    with_mean = F.struct(vec.alias("v"), (total(vec) / F.size(vec)).alias("m"))
    return let(
        with_mean,
        lambda s: F.struct(
            s["m"].alias("mean"),
            F.sqrt(
                F.aggregate(
                    s["v"], F.lit(0.0), lambda acc, x: acc + (x - s["m"]) * (x - s["m"])
                )
                / F.size(s["v"])
            ).alias("std"),
        ),
    )


def unit_centred(vec: Column) -> Column:
    """Centred and scaled to length one, so that a dot product is a Pearson correlation.

    NULL for a constant vector, whose correlation is undefined.
    """
    def scale(s: Column) -> Column:
        return let(
            F.struct(
                s["c"].alias("c"),
                F.sqrt(F.aggregate(s["c"], F.lit(0.0), lambda acc, x: acc + x * x)).alias("n"),
            ),
            lambda t: F.when(t["n"] > 0, F.transform(t["c"], lambda x: x / t["n"])),
        )

    centred = let(
        F.struct(vec.alias("v"), (total(vec) / F.size(vec)).alias("m")),
        lambda s: F.struct(F.transform(s["v"], lambda x: x - s["m"]).alias("c")),
    )
    return let(centred, scale)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def pearson(a: Column, b: Column) -> Column:
    return dot(unit_centred(a), unit_centred(b))


def laplacian_var(vec: Column, width: int) -> Column:
    """Variance of the four-neighbour Laplacian over interior cells of a square image."""
    interior = int_array(
        r * width + c for r in range(1, width - 1) for c in range(1, width - 1)
    )

    def responses(v: Column) -> Column:
        return F.transform(
            interior,
            lambda i: v[i - 1] + v[i + 1] + v[i - width] + v[i + width] - v[i] * 4.0,
        )

    std = vector_stats(let(vec, responses))["std"]
    return std * std


def flatten_grid(rows: Column) -> Column:
    """9x9 rows to 81 row-major cells."""
    return F.flatten(rows)


def nest_grid(cells: Column) -> Column:
    """81 row-major cells to 9x9 rows."""
    return F.transform(int_array(range(9)), lambda r: F.slice(cells, r * 9 + 1, F.lit(9)))


def histogram_bin(value: Column, low: float, high: float, bins: int) -> Column:
    """Index 0..bins-1 of a fixed-width bin whose last edge is inclusive; NULL outside."""
    index = F.floor((value - low) / (high - low) * bins)
    return F.when(value.between(low, high), F.least(index, F.lit(bins - 1)))
