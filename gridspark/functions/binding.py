"""Small helpers for writing nested array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    A lambda re-evaluates every captured expression per element; binding the
    expression to a lambda variable keeps vector formulas linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def mean(array: Column) -> Column:
    return total(array) / F.nullif(F.size(array), F.lit(0))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0.0 where b is zero."""
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def int_array(values) -> Column:
    return F.expr("array(" + ",".join(str(int(v)) for v in values) + ")")


def int_matrix(rows) -> Column:
    return F.expr(
        "array(" + ",".join("array(" + ",".join(str(int(v)) for v in r) + ")" for r in rows) + ")"
    )


def literal_rows(spark: SparkSession, name: str, values: list) -> DataFrame:
    """A one-column table of constants, built in the JVM."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(name))


def computed(df: DataFrame, *keep: str, **values) -> DataFrame:
    """Kept columns plus computed ones that behave like columns of a table.

    As plain projections the expressions would be pasted into every later filter and
    reference, past the size the JVM still compiles; a generator of one row stops that.
    """
    row = F.struct(*[(F.expr(v) if isinstance(v, str) else v).alias(n) for n, v in values.items()])
    return df.select(*keep, F.inline(F.array(row)))
