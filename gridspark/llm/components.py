"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, stored

FEW_LINKS = 500_000  # links that one task may join


def forest(links: DataFrame) -> DataFrame:
    """Spanning forest of the links of each partition: fewer links, the same components."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while above.get(x, x) != x:
                above[x] = x = above.get(above[x], above[x])
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                x, y = top(a), top(b)
                above.setdefault(a, a)
                above.setdefault(b, b)
                if x != y:
                    above[max(x, y)] = min(x, y)
        rows = [(x, top(x)) for x in above]
        for at in range(0, len(rows), 100_000):
            yield pd.DataFrame([r for r in rows[at:at + 100_000] if r[0] != r[1]], columns=["a", "b"], dtype="int64")

    return links.mapInPandas(work, "a long, b long")


def components(links: DataFrame, few_links: int = FEW_LINKS) -> DataFrame:
    """node, component: the smallest node that links lead to. ``links`` has long columns a and b.

    Each task first reduces its own links to a forest. What is left goes to one task if it is at most ``FEW_LINKS``, which is
    counted first. Else large-star and small-star steps take turns until no link changes; hubs are aggregated
    before the shuffle, and their joins can be split.
    Nodes without links to others do not come out.
    """
    spark = links.sparkSession
    now = stored(forest(links.where("a <> b")).distinct(), "links")
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = mark(now)
    while seen[0] > few_links:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        now = stored(small, "links")
        free_shuffles(spark)
        last, seen = seen, mark(now)
        if last == seen:
            break
    else:
        now = stored(forest(now.coalesce(1)), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
