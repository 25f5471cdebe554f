"""Joins by nearness: twins among vectors, nearest points, values in intervals, names by prefix.

Each turns a condition on distances into equal keys, so that Spark shuffles by them and
only tests the few rows that meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridspark.functions import vectors as V
from gridspark.functions.binding import let
from gridspark.session import materialise

SLACK = 1e-6  # a distance near zero is the root of a rounding error
LARGEST = 1.7e308


# --- twins ------------------------------------------------------------------

def twin_links(samples: DataFrame, group: str, key: str, vec: str, least: float = 0.995,
               leaf: int = 512, pivots: int = 16, depth: int = 12) -> DataFrame:
    """(group, key, copies, links): how many other rows of its group correlate above ``least``.

    Equal vectors of a group are one row under their smallest key, with their number as
    ``copies``; each of them counts the others as links. Vectors of other lengths never
    link. ``links`` is NULL where the correlation is undefined: constant vectors, and
    vectors that are NULL or hold NULL. NULL is a group like others.

    Centred unit vectors correlate above c exactly if their distance is below
    sqrt(2 - 2c). A cell with more than ``leaf`` vectors is dealt to the nearest of its
    pivots; a vector also visits every pivot that is at most two distances farther than
    its nearest, which by the triangle inequality brings every twin to the home of the
    other. A cell is dealt only if that halves the pairs to test. Vectors within half a
    distance of their pivot are twins of one another and are counted, not paired.
    """
    reach = (2 - 2 * least) ** 0.5
    whole = samples.select(
        F.col(group).alias("g"), F.col(key).alias("id"), V.as_doubles(F.col(vec)).alias("v")
    ).groupBy("g", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    whole = materialise(whole.select("g", "id", "n", F.when(F.size("v") > 0, V.unit_centred(F.col("v"))).alias("u")))
    cells = whole.filter("u IS NOT NULL").select(
        "g", F.size("u").cast("string").alias("cell"), "id", "n", "u",
        F.lit(True).alias("home"), F.lit(None).cast("double").alias("d"),
    )
    done = None
    for level in range(depth):
        sized = materialise(_with_size(cells, leaf))
        small = sized.filter(~F.col("_big")).drop("_big")
        big = sized.filter("_big").drop("_big")
        if big.isEmpty():
            done = _union(done, small)
            break
        dealt, kept = _deal(big, pivots, reach, level)
        done = _union(_union(done, small), kept)
        cells = dealt
    else:
        done = _union(done, cells)
    linked = _linked(done, least, reach).groupBy("g", "id").agg(F.sum("m").alias("m"))
    linked = linked.withColumnRenamed("g", "_g").withColumnRenamed("id", "_id")
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_id"))
    return whole.join(linked, same, "left").select(
        F.col("g").alias(group), F.col("id").alias(key), F.col("n").alias("copies"),
        F.when(F.col("u").isNotNull(), F.coalesce("m", F.lit(0)) + F.col("n") - 1).alias("links"),
    )


def _union(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)


def _by_cell(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("g", "_g").withColumnRenamed("cell", "_cell")
    same = F.col("g").eqNullSafe(F.col("_g")) & (F.col("cell") == F.col("_cell"))
    return left.join(right, same, how).drop("_g", "_cell")


def _with_size(cells: DataFrame, leaf: int) -> DataFrame:
    """Cells that are nobody's home go; ``_big`` marks those above the leaf size."""
    sizes = cells.groupBy("g", "cell").agg(F.count("*").alias("_rows"), F.count_if("home").alias("_homes"))
    sizes = sizes.filter("_homes > 0")
    return _by_cell(cells, sizes).select(*cells.columns, (F.col("_rows") > leaf).alias("_big"))


def _deal(big: DataFrame, pivots: int, reach: float, level: int) -> tuple[DataFrame, DataFrame]:
    """Big cells dealt to their pivots, and those that a deal would not thin out."""
    order = Window.partitionBy("g", "cell").orderBy(F.xxhash64("id", F.lit(level)), "id")
    chosen = big.filter("home").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= pivots)
    heads = chosen.groupBy("g", "cell").agg(F.array_sort(F.collect_list(F.struct("_k", "u"))).alias("_p"))
    met = _by_cell(big, heads)
    far = let(F.col("u"), lambda u: F.transform("_p", lambda p: F.sqrt(F.greatest(2 - 2 * V.dot(u, p["u"]), F.lit(0.0)))))
    visits = met.withColumn("_d", far).drop("_p").select(
        "*", F.array_position("_d", F.array_min("_d")).alias("_nearest"), F.posexplode("_d").alias("_j", "_to")
    ).filter(F.col("_to") <= F.array_min("_d") + 2 * reach + SLACK)
    moved = materialise(visits.select(
        "g", "cell", F.concat_ws("/", "cell", F.col("_j").cast("string")).alias("_child"), "id", "n", "u",
        (F.col("home") & (F.col("_nearest") == F.col("_j") + 1)).alias("home"), F.col("_to").alias("d"),
    ))
    parts = moved.groupBy("g", "cell", "_child").agg(F.count("*").alias("r"), F.count_if("home").alias("h"))
    before = big.groupBy("g", "cell").agg((F.count("*") * F.count_if("home")).cast("double").alias("pairs"))
    after = parts.groupBy("g", "cell").agg(F.sum(F.col("r") * F.col("h").cast("double")).alias("left"))
    fate = materialise(_by_cell(before, after).select(
        "g", "cell", (F.col("left") <= F.col("pairs") / 2).alias("pays")
    ))
    pays, not_pays = fate.filter("pays"), fate.filter("NOT pays")
    dealt = _by_cell(moved, pays.select("g", "cell"), "left_semi").drop("cell").withColumnRenamed("_child", "cell")
    # A cell that stays takes its first pivot for the half ball and the rings.
    first = _by_cell(heads, not_pays.select("g", "cell"), "left_semi").select("g", "cell", F.col("_p")[0]["u"].alias("_u"))
    kept = _by_cell(big, first).select(
        "g", "cell", "id", "n", "u", "home",
        F.sqrt(F.greatest(2 - 2 * V.dot(F.col("u"), F.col("_u")), F.lit(0.0))).alias("d"),
    )
    return dealt, kept


def _linked(cells: DataFrame, least: float, reach: float) -> DataFrame:
    """(g, id, m): weights of linked vectors, each counted once, in the home of ``id``."""
    cells = cells.withColumn("core", F.coalesce(F.col("d") <= reach / 2 - SLACK, F.lit(False)))
    cells = cells.withColumn("ring", F.coalesce(F.floor(F.col("d") / (reach + SLACK)), F.lit(0)))
    cells = materialise(cells)
    core = cells.filter("core")
    weight = core.groupBy("g", "cell").agg(F.sum("n").alias("w"))
    inside = _by_cell(core.filter("home"), weight).select("g", "id", (F.col("w") - F.col("n")).alias("m"))
    # A core vector asks the others only; the rest ask all. Twins differ by one ring at most.
    asked = F.when(F.col("core"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    a = cells.filter("home").select(
        F.col("g").alias("ag"), F.col("cell").alias("ac"), F.col("id").alias("aid"), F.col("u").alias("au"), F.col("d").alias("ad"),
        F.explode(F.sequence(F.col("ring") - 1, F.col("ring") + 1)).alias("aring"), asked.alias("_asked"),
    ).withColumn("acore", F.explode("_asked")).drop("_asked")
    near = F.coalesce(F.abs(F.col("ad") - F.col("d")) <= reach + SLACK, F.lit(True))
    meet = (
        F.col("ag").eqNullSafe(F.col("g")) & (F.col("ac") == F.col("cell")) & (F.col("acore") == F.col("core"))
        & (F.col("aring") == F.col("ring")) & (F.col("aid") != F.col("id")) & near
    )
    pairs = a.join(cells, meet).filter(V.dot(F.col("au"), F.col("u")) > least)
    return inside.unionByName(pairs.select(F.col("ag").alias("g"), F.col("aid").alias("id"), F.col("n").alias("m")))


# --- nearest points ---------------------------------------------------------

def nearest_points(probes: DataFrame, anchors: DataFrame, probe: str, anchor: str, radius: float,
                   levels: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """(probe, anchor, distance): the closest anchor less than ``radius`` away, smallest key first.

    Probes without one, or without a place, have NULL. Equal places of anchors collapse.
    Anchors are filed in square cells and probes look into nine. Cells start at a fraction
    of the radius: where anchors lie dense, a probe finds one within a cell's side, which
    no anchor of a wider cell can beat, and leaves. Only the rest looks into wider cells.
    """
    spots = anchors.filter(f"{x} IS NOT NULL AND {y} IS NOT NULL").groupBy(
        F.col(x).cast("double").alias("bx"), F.col(y).cast("double").alias("by")
    ).agg(F.min(anchor).alias("b"))
    open_ = materialise(probes.select(
        F.col(probe).alias("p"), F.col(x).cast("double").alias("ax"), F.col(y).cast("double").alias("ay")
    ).distinct())
    found = None
    for level in reversed(range(levels)):
        side = radius / 2 ** level
        at = lambda c: F.floor(F.col(c) / side)
        beside = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1))
        filed = spots.select("*", at("bx").alias("cx"), at("by").alias("cy"))
        asking = open_.select("*", beside("ax").alias("cx")).select("*", beside("ay").alias("cy"))
        far = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
        best = (
            asking.join(filed, ["cx", "cy"]).withColumn("d", far).filter(F.col("d") < radius)
            .groupBy("p", "ax", "ay").agg(F.min(F.struct("d", "b")).alias("m")).select("p", "ax", "ay", "m.d", "m.b")
        )
        if level:
            best = best.filter(F.col("d") <= side)
        best = materialise(best)
        found = _union(found, best.select("p", "b", "d"))
        if level:
            open_ = materialise(open_.join(best, ["p", "ax", "ay"], "left_anti"))
    keys = probes.select(F.col(probe).alias("p")).distinct()
    nearest = found.groupBy("p").agg(F.min(F.struct("d", "b")).alias("m"))
    nearest = nearest.withColumnRenamed("p", "_p")
    return keys.join(nearest, F.col("p").eqNullSafe(F.col("_p")), "left").select(
        F.col("p").alias(probe), F.col("m.b").alias(anchor), F.col("m.d").alias("distance")
    )


# --- intervals --------------------------------------------------------------

def interval_table_join(df: DataFrame, value: str, bins: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """Rows of ``df`` with the columns of every half-open interval [low, high) that holds the value.

    Intervals may overlap, be unbounded and lie at any scale; empty ones hold nothing, nor
    does any hold NULL or NaN. An interval is filed under the power of two above its length, in
    the two or three buckets of that width it crosses; a value asks one bucket of each
    width in use (at most some two thousand, as many as a double has exponents).
    """
    inside = lambda c: F.least(F.greatest(c.cast("double"), F.lit(-LARGEST)), F.lit(LARGEST))
    lo, hi = inside(F.col(low)), inside(F.col(high))
    bins = bins.filter(F.col(low) < F.col(high))
    width = F.least(F.ceil(F.log2(F.least(hi - lo, F.lit(LARGEST)))), F.lit(1022))
    filed = bins.withColumn("_width", width.cast("int")).withColumn(
        "_bucket", F.explode(F.sequence(_bucket(lo), _bucket(hi)))
    )
    widths = sorted(r[0] for r in filed.select("_width").distinct().collect())
    if not widths:
        widths = [0]
    asking = df.withColumn("_width", F.explode(F.array(*[F.lit(w) for w in widths]))).withColumn(
        "_bucket", _bucket(inside(F.col(value)))
    )
    return asking.join(filed, ["_width", "_bucket"]).filter(
        (F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))
    ).drop("_width", "_bucket")


def interval_totals(df: DataFrame, value: str, of: str, bins: DataFrame, low: str = "lo", high: str = "hi") -> DataFrame:
    """``bins`` with ``n`` and ``total``: the rows of ``df`` with [low, high) around their value, and the sum of ``of``.

    As the join with ``interval_table_join`` and a count would give, without its pairs: an interval
    holds what lies below its end less what lies below its start. Values and ends are sorted by range, running
    sums stay inside a range and one row per range carries them on. Sums of whole numbers are exact.
    """
    zero = F.lit(0).cast("bigint")
    good = F.col(low) < F.col(high)
    values = df.select(F.col(value).alias("_v"), F.lit(1).cast("bigint").alias("n"), F.col(of).alias("s"), F.lit(False).alias("_edge"))
    edges = bins.filter(good).select(F.explode(F.array(low, high)).alias("_v"), zero.alias("n"), zero.alias("s"), F.lit(True).alias("_edge"))
    places = (
        values.filter("_v IS NOT NULL").unionByName(edges).groupBy("_v")
        .agg(F.sum("n").alias("n"), F.coalesce(F.sum("s"), zero).alias("s"), F.max("_edge").alias("_edge"))
    )
    ordered = materialise(places.orderBy("_v").withColumn("_pos", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_pos", 33))
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), zero)
    by_part, inside = Window.orderBy("_part"), Window.partitionBy("_part").orderBy("_pos")
    parts = ordered.groupBy("_part").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).select(
        "_part", earlier("n", by_part).alias("_n"), earlier("s", by_part).alias("_s")
    )
    below = (
        ordered.withColumns({"n": earlier("n", inside), "s": earlier("s", inside)}).filter("_edge")
        .join(F.broadcast(parts), "_part")  # one row per range of the sort
        .select("_v", (F.col("n") + F.col("_n")).alias("n"), (F.col("s") + F.col("_s")).alias("s"))
    )
    at = lambda side: below.select(F.col("_v").alias(f"_{side}"), F.col("n").alias(f"_n{side}"), F.col("s").alias(f"_s{side}"))
    met = bins.join(at("lo"), F.when(good, F.col(low)) == F.col("_lo"), "left").join(
        at("hi"), F.when(good, F.col(high)) == F.col("_hi"), "left"
    )
    return met.select(
        *[bins[c] for c in bins.columns], F.coalesce(F.col("_nhi") - F.col("_nlo"), zero).alias("n"),
        F.coalesce(F.col("_shi") - F.col("_slo"), zero).alias("total"),
    )


def _bucket(v: Column) -> Column:
    return F.floor(v / F.pow(F.lit(2.0), F.col("_width"))).cast("bigint")


# --- prefixes ---------------------------------------------------------------

def minimal_prefixes(prefixes: DataFrame, prefix: str) -> DataFrame:
    """The prefixes that no shorter one of the table covers, lower-cased, each once."""
    each = prefixes.select(F.lower(prefix).alias("p")).filter("p IS NOT NULL").distinct()
    shorter = each.select("p", F.explode(F.transform(F.sequence(F.lit(0), F.length("p") - 1), lambda n: F.left("p", n))).alias("q")) \
        .filter(F.length("q") < F.length("p"))
    covered = shorter.join(each.withColumnRenamed("p", "q"), "q", "left_semi").select("p").distinct()
    return each.join(covered, "p", "left_anti")


def prefix_table_allowlist(df: DataFrame, name: Column, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Rows whose lower-cased ``name`` starts with a prefix of the table; NULL names go.

    Of the minimal prefixes at most one fits a name, so each distinct name asks once for
    every length in use and the rows follow by a semi-join; no row is compared with a list.
    """
    least = materialise(minimal_prefixes(prefixes, prefix))
    lengths = sorted(r[0] for r in least.select(F.length("p")).distinct().collect())
    if not lengths:
        return df.limit(0)
    named = df.withColumn("_name", F.lower(name))
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("_name"))
    asked = named.select("_name").distinct().select("_name", F.explode(wanted).alias("_n"))
    hits = asked.select("_name", F.left("_name", F.col("_n")).alias("p")).join(least, "p", "left_semi")
    return named.join(hits.select("_name"), "_name", "left_semi").select(*df.columns)
