"""Key-based table operators: resume, redo, upsert, delete, patch, history, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.binding import int_matrix
from gridspark.functions.cells import basename
from gridspark.functions.puzzles import PEERS

# Font families whose digits are known to render.
FONT_PREFIXES = [
    "helvetica", "arial", "times", "georgia", "verdana", "courier", "menlo", "sfns", "sfcompact", "sfpro",
    "palatino", "optima", "futura", "avenir", "lucida", "geneva", "trebuchet", "tahoma", "baskerville",
    "didot", "cochin", "americantypewriter", "andalemono", "monaco", "consolas", "garamond", "gillsans",
    "impact", "rockwell", "bodoni 72", "calibri", "cambria", "dejavu", "liberation", "ubuntu",
]
FONT_SUFFIX = r"\.(ttc|ttf|otf)$"


def resume(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is not processed yet."""
    return todo.join(done.select(key), key, "left_anti")


def redo(items: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requested items, requested keys that do not exist)."""
    keys = wanted.select(key).distinct()
    return items.join(keys, key, "left_semi"), keys.join(items.select(key), key, "left_anti")


def upsert(base: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Replace rows by key or append them."""
    return base.join(updates.select(key), key, "left_anti").unionByName(updates)


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return base.join(keys.select(key), key, "left_anti")


def toggle_flag(base: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Negate a boolean for the named rows."""
    hits = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return base.join(hits, key, "left").withColumn(
        flag, F.when(F.col("_hit"), ~F.col(flag)).otherwise(F.col(flag))
    ).drop("_hit")


def retention(history: DataFrame, owner: str, ts: str, tie: str, n: int = 50) -> DataFrame:
    """The newest n entries per owner; tasks cut each owner to n before the shuffle."""
    w = Window.partitionBy(owner).orderBy(F.desc(ts), F.desc(tie))
    return history.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def history_filter(history: DataFrame, kind: str, source: str = "source", favourite: str = "is_favorite") -> DataFrame:
    if kind == "all":
        return history
    if kind == "favorites":
        return history.filter(favourite)
    return history.filter(F.col(source) == kind)


def concat_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Union of labelled tables with their provenance."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("source", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def prefix_allowlist(df: DataFrame, path: Column, prefixes: list[str] = FONT_PREFIXES) -> DataFrame:
    """Keep rows whose lower-cased file name, without a font suffix, starts with a prefix.

    The list is a constant of the query, so the semi-join is a scan predicate.
    """
    name = F.regexp_replace(F.lower(basename(path)), FONT_SUFFIX, "")
    test = F.lit(False)
    for prefix in prefixes:
        test = test | name.startswith(prefix.lower())
    return df.filter(test)


def distinct_first(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """First row per key in order, then the n first of those."""
    row = F.struct(*[F.col(c) for c in df.columns if c != key])
    return (
        df.groupBy(key).agg(F.min_by(row, F.col(order)).alias("_r")).select(key, "_r.*")
        .orderBy(order).limit(n)
    )


def common_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both tables hold, each once. Null is a key like others."""
    return left.select(key).intersect(right.select(key))


def surplus_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of ``left`` less those of ``right``, counting copies: three against one leave two."""
    return left.select(key).exceptAll(right.select(key))


def attach_outlines(images: DataFrame, outlines: DataFrame, key: str, required: bool = False) -> DataFrame:
    """Add outlines with a ``has_outline`` flag, or keep only images that have one."""
    flagged = outlines.withColumn("has_outline", F.lit(True))
    if required:
        return images.join(flagged, key)
    return images.join(flagged, key, "left").withColumn(
        "has_outline", F.coalesce("has_outline", F.lit(False))
    )


def manifest_join(manifest: DataFrame, images: DataFrame, labels: DataFrame, stem: str = "stem") -> DataFrame:
    """Listed files that have both an image and a label file."""
    return manifest.join(images, stem).join(labels, stem)


def peer_join(cells: DataFrame, key: str, idx: str = "idx", digit: str = "digit") -> DataFrame:
    """(key, peer idx, digit): every cell sends its digit to its 20 peers.

    The layout is a fixed array looked up by position; nothing is joined.
    """
    return cells.select(key, F.explode(int_matrix(PEERS)[F.col(idx)]).alias(idx), digit)
