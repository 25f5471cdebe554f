"""Queries over keys, histories, ordered events and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.functions.binding import let
from gridspark.operators import ordered as O
from gridspark.operators import tables as T
from gridspark.operators.scoring import per_image_breakdown
from gridspark.plans import inputs as I
from gridspark.plans.registry import longs, query, rounded
from gridspark.session import scratch
from gridspark.sources import readers as S
from gridspark.sources.readers import read_table
from gridspark.sources.writers import write_results as write_tables

# --- keys -------------------------------------------------------------------


@query("resume", "J4", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume(spark, sf):
    done = read_table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T.resume(read_table(spark, sf, "orders").select("o_orderkey"), done, "o_orderkey")


@query("redo", "J5", """
SELECT 'found' AS kind, c_custkey FROM customer WHERE c_custkey IN (SELECT DISTINCT 3*user_id FROM events)
UNION ALL SELECT 'missing', k FROM (SELECT DISTINCT 3*user_id + 1000000*(user_id % 2) AS k FROM events) WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def redo(spark, sf):
    customers = read_table(spark, sf, "customer").select("c_custkey")
    events = read_table(spark, sf, "events")
    found, _ = T.redo(customers, events.selectExpr("3*user_id AS c_custkey"), "c_custkey")
    _, missing = T.redo(customers, events.selectExpr("3*user_id + 1000000*(user_id % 2) AS c_custkey"), "c_custkey")
    return found.select(F.lit("found").alias("kind"), "c_custkey").unionByName(
        missing.select(F.lit("missing").alias("kind"), "c_custkey")
    )


_UPDATES = "(SELECT o_custkey + 700 AS k, round(max(o_totalprice), 2) AS v FROM orders GROUP BY 1)"


@query("upsert", "J6", f"""
SELECT k, v FROM {_UPDATES} UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM {_UPDATES})""")
def upsert(spark, sf):
    base = read_table(spark, sf, "customer").selectExpr("c_custkey AS k", "c_acctbal AS v")
    updates = read_table(spark, sf, "orders").groupBy(F.expr("o_custkey + 700").alias("k")).agg(
        F.round(F.max("o_totalprice"), 2).alias("v")
    )
    return T.upsert(base, updates, "k")


@query("delete_keys", "J7", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def delete_keys(spark, sf):
    gone = read_table(spark, sf, "events").filter("event_type = 'error'").select(F.col("user_id").alias("c_custkey"))
    return T.delete_keys(read_table(spark, sf, "customer").select("c_custkey"), gone, "c_custkey")


@query("common_keys", "U10", "SELECT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events")
def common_keys(spark, sf):
    return T.common_keys(*_customer_keys(spark, sf), "k")


@query("surplus_keys", "U10", "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT user_id FROM events")
def surplus_keys(spark, sf):
    return T.surplus_keys(*_customer_keys(spark, sf), "k")


def _customer_keys(spark, sf):
    orders = read_table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return orders, read_table(spark, sf, "events").select(F.col("user_id").alias("k"))


@query("toggle_flag", "J8", """
SELECT event_id, CASE WHEN event_id IN (SELECT 2*o_custkey FROM orders) THEN event_id % 10 <> 0 ELSE event_id % 10 = 0 END AS is_favorite FROM events""")
def toggle_flag(spark, sf):
    ids = read_table(spark, sf, "orders").selectExpr("2*o_custkey AS event_id")
    return T.toggle_flag(I.history(spark, sf), ids, "event_id", "is_favorite").select("event_id", "is_favorite")


@query("limit_manifest", "K11", "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 40")
def limit_manifest(spark, sf):
    return read_table(spark, sf, "pages").select("page_id", "url").orderBy("page_id").limit(40)


# --- history ----------------------------------------------------------------

HISTORY = "WITH fx_history AS (SELECT user_id, event_id, ts, event_type AS source, event_id % 10 = 0 AS is_favorite FROM events)\n"


@query("retention", "W8", HISTORY + """
SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM fx_history) WHERE rank <= 50""")
def retention(spark, sf):
    kept = T.retention(I.history(spark, sf), "user_id", "ts", "event_id", 50)
    return longs(kept.select("user_id", "event_id", "rank"), "rank")


@query("history_filter", "W9", HISTORY + """
SELECT 'all' AS kind, event_id FROM fx_history UNION ALL SELECT 'favorites', event_id FROM fx_history WHERE is_favorite
UNION ALL SELECT 'click', event_id FROM fx_history WHERE source = 'click'""")
def history_filter(spark, sf):
    history = I.history(spark, sf)
    views = {k: T.history_filter(history, k).select("event_id") for k in ("all", "favorites", "click")}
    return T.concat_sources(views).withColumnRenamed("source", "kind")


# --- ordered events ---------------------------------------------------------


@query("trailing_debounce", "W5", """
SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
WHERE nxt IS NULL OR nxt > ts + INTERVAL 1 HOUR""")
def trailing_debounce(spark, sf):
    events = I.events(spark, sf).select("user_id", "event_id", "ts")
    return O.trailing_debounce(events, "user_id", "ts", "event_id", 3600).select("user_id", "event_id")


# Next event at least the gap later, then the chain from each user's first event.
DEBOUNCED = """WITH RECURSIVE fx_next AS (SELECT user_id, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
fx_jump AS (SELECT *, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 12 HOUR FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM fx_next),
fx_kept AS (SELECT * FROM fx_jump WHERE (user_id, ts) IN (SELECT user_id, min(ts) FROM events GROUP BY 1)
  UNION ALL SELECT j.* FROM fx_kept k JOIN fx_jump j ON j.user_id = k.user_id AND j.ts = k.nxt)
"""


@query("greedy_min_gap", "W3", DEBOUNCED + "SELECT user_id, event_id FROM fx_kept")
def greedy_min_gap(spark, sf):
    events = I.events(spark, sf).select("user_id", "event_id", "ts")
    return O.greedy_min_gap(events, "user_id", "ts", "event_id", 12 * 3600).select("user_id", "event_id")


STOPS = I.cte(I.EPOCHS, """fx_best AS (SELECT *, coalesce(max(val_acc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS prev FROM fx_epochs)""",
    """fx_last AS (SELECT *, coalesce(max(CASE WHEN val_acc > prev THEN epoch END) OVER (PARTITION BY run ORDER BY epoch), 0) AS improved FROM fx_best)""",
    """fx_stop AS (SELECT run, max(epoch) AS epochs, min(epoch) FILTER (epoch - improved >= {p}) AS stop FROM fx_last GROUP BY 1)""",
    """fx_stops AS (SELECT s.run, s.epochs, coalesce(stop, epochs) AS stop_epoch, stop IS NOT NULL AS stopped_early,
    max(improved) AS best_epoch, max(val_acc) AS best_value FROM fx_stop s JOIN fx_last l ON l.run = s.run AND l.epoch <= coalesce(stop, epochs) GROUP BY ALL)""")


def _epochs(spark, sf):
    numbered = O.number_rows(
        I.events(spark, sf).withColumn("_slot", O.time_bucket(F.col("ts"), 3600)),
        ["user_id"], "_slot", ["ts", "event_id"], "epoch",
    )
    return numbered.select(F.col("user_id").alias("run"), "epoch", F.col("value").alias("val_acc"))


@query("epoch_numbers", "D16", I.cte(I.EPOCHS) + "SELECT run, epoch, val_acc FROM fx_epochs")
def epoch_numbers(spark, sf):
    return _epochs(spark, sf)


@query("early_stopping", "W6", STOPS.replace("{p}", "10") + "SELECT run, epochs, stop_epoch, stopped_early, best_epoch, best_value FROM fx_stops")
def early_stopping(spark, sf):
    return O.early_stopping(_epochs(spark, sf), "run", "epoch", "val_acc", 10)


@query("best_checkpoint", "W7", STOPS.replace("{p}", "25") + "SELECT run, best_epoch, best_value FROM fx_stops")
def best_checkpoint(spark, sf):
    return O.early_stopping(_epochs(spark, sf), "run", "epoch", "val_acc", 25).select("run", "best_epoch", "best_value")


# --- files: written from the tables, read back ------------------------------


@query("read_outlines", "S4 J3", I.cte(I.DETECTIONS) + """
SELECT image_id, image_id % 4 <> 1 AND image_id % 5 <> 0 AS has_outline, CASE WHEN image_id % 4 <> 1 AND image_id % 5 <> 0 THEN x0 + 1 ELSE -1 END AS x,
  CASE WHEN image_id % 4 <> 1 AND image_id % 5 <> 0 THEN w * h ELSE 0 END AS area FROM fx_detections""")
def read_outlines(spark, sf):
    """Outlines as CSV: two rows per image (the last one counts), some missing, some broken."""
    path = scratch(spark, "outlines")
    c = F.col
    quads = I.detections(spark, sf).filter("image_id % 5 <> 0")
    rows = quads.select("image_id", "truth", F.explode(F.array(F.lit(0), F.lit(1))).alias("shift"))
    broken = c("image_id") % 4 == 1
    columns = [F.concat(F.lit("images/image"), c("image_id"), F.lit(".jpg")).alias("filepath")] + [
        (F.when(broken, F.lit("n/a")).otherwise((c("truth")[i][a] + c("shift")).cast("string"))).alias(f"p{i + 1}_{a}")
        for i in range(4) for a in "xy"
    ]
    rows.select(*columns).write.option("header", True).csv(path)
    images = read_table(spark, sf, "orders").select(
        c("o_orderkey").alias("image_id"), F.concat(F.lit("image"), "o_orderkey", F.lit(".jpg")).alias("name")
    )
    found = T.attach_outlines(images, S.read_outlines(spark, path), "name")
    side = lambda a, i, j: c("outline")[i][a] - c("outline")[j][a]
    return longs(found.select(
        "image_id", "has_outline", F.coalesce(c("outline")[0]["x"], F.lit(-1)).alias("x"),
        F.coalesce(side("x", 1, 0) * side("y", 3, 0), F.lit(0)).alias("area"),
    ), "x", "area")


@query("read_manifest", "S3 J2", "SELECT page_id, lower(split_part(url, '/', 3)) AS host FROM pages WHERE page_id % 3 <> 0 AND page_id % 4 <> 0")
def read_manifest(spark, sf):
    """A manifest of files, of which some have no image and some no labels."""
    path = scratch(spark, "manifest")
    pages = read_table(spark, sf, "pages")
    line = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("images/page"), "page_id", F.lit(".jpg\n "))).otherwise(
        F.concat(F.lit("images/page"), "page_id", F.lit(".jpg"))
    )
    pages.select(line.alias("value")).write.text(path)
    stem = F.concat(F.lit("page"), F.col("page_id")).alias("stem")
    images = pages.filter("page_id % 3 <> 0").select(stem, "page_id")
    labels = pages.filter("page_id % 4 <> 0").select(stem, F.lower(F.split("url", "/")[2]).alias("host"))
    return T.manifest_join(S.read_manifest(spark, path), images, labels).select("page_id", "host")


@query("read_annotations", "S1 D5", I.SCORED_CTE + """
SELECT image_id, sum((idx + 1) * list_sum(cell))::BIGINT AS checksum, count(*) FILTER (len(cell) > 1) AS ambiguous, image_id % 200 + 900 AS right_edge
FROM fx_scored GROUP BY image_id""")
def read_annotations(spark, sf):
    """Annotations with plain and multi-valued cells, as JSON lines."""
    path = scratch(spark, "annotations")
    # A plain cell is written as a number, an ambiguous one as a list.
    as_json = F.when(F.size("cell") > 1, F.to_json("cell")).otherwise(F.element_at("cell", 1).cast("string"))
    grids = I.readings(spark, sf).select("image_id", "idx", as_json.alias("j")).groupBy("image_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "j"))).alias("a")  # 81 cells per image
    )
    rows = F.transform(
        F.expr("sequence(0, 8)"),
        lambda r: F.concat(F.lit("["), F.array_join(F.slice("a.j", r * 9 + 1, F.lit(9)), ","), F.lit("]")),
    )
    points = F.transform(F.expr("sequence(0, 15)"), lambda i: F.concat(
        F.lit("["), (F.col("image_id") % 200 + (i % 4) * 300).cast("string"), F.lit(","), (F.floor(i / 4) * 300).cast("string"), F.lit("]")
    ))
    text = F.concat(
        F.lit('{"images":[{"path":"'), F.col("image_id").cast("string"), F.lit('","corners_16":['), F.array_join(points, ","),
        F.lit('],"grid":['), F.array_join(rows, ","), F.lit("]}]}"),
    )
    grids.select(text.alias("value")).write.text(path)
    weighted = F.transform("cells", lambda c, i: (i + 1) * F.aggregate(c, F.lit(0), lambda s, v: s + v))
    total = let(weighted, lambda w: F.aggregate(w, F.lit(0).cast("bigint"), lambda s, v: s + v))
    read = S.read_annotations(spark, path, multi_line=False)
    return longs(read.select(
        F.col("path").cast("bigint").alias("image_id"), total.alias("checksum"),
        F.size(F.filter("cells", lambda c: F.size(c) > 1)).alias("ambiguous"),
        F.col("outer")[1]["x"].alias("right_edge"),
    ), "ambiguous", "right_edge")


@query("read_experiments", "S9", """
SELECT 'run' || p_partkey AS name, 2 + p_partkey % 3 AS depth, CAST(p_size AS BIGINT) * 1000 AS parameters, p_partkey % 1000 / 1000.0::DOUBLE AS real_filled_acc FROM part""")
def read_experiments(spark, sf):
    """Result documents, one per line, each with a results array."""
    path = scratch(spark, "experiments")
    result = F.struct(
        F.concat(F.lit("run"), "p_partkey").alias("name"), (2 + F.col("p_partkey") % 3).alias("depth"),
        F.array(F.lit(32), F.lit(64)).alias("channels"), (F.col("p_size") * 1000).alias("parameters"),
        (F.col("p_partkey") % 1000 / 1000.0).alias("real_filled_acc"),
    )
    protocol = F.create_map(F.lit("epochs"), F.lit("20"))
    read_table(spark, sf, "part").select(protocol.alias("protocol"), F.array(result).alias("results")).write.json(path)
    runs = S.read_experiments(spark, path, multi_line=False)
    return longs(runs.select("name", "depth", "parameters", "real_filled_acc"), "depth")


@query("write_results", "S8", I.SCORED_CTE + """
SELECT 'summary' AS part, count(*) AS rows, 'accuracy' AS command, count(*) FILTER (correct) AS correct FROM fx_scored GROUP BY ()
UNION ALL SELECT 'detail', count(*), 'accuracy', sum(k)::BIGINT FROM (SELECT count(*) FILTER (filled AND correct) AS k FROM fx_scored GROUP BY image_id)""")
def write_results(spark, sf):
    """Summary and per-image rows with their provenance, written and read back."""
    path = scratch(spark, "results")
    scored = I.scored(spark, sf)
    summary = scored.agg(F.count("*").alias("rows"), F.count_if("correct").alias("correct"))
    write_tables(summary, per_image_breakdown(scored), path, "accuracy")
    stamped = F.col("timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$")
    read = lambda name: spark.read.parquet(f"{path}/{name}").filter(stamped)
    head = read("summary").select(F.lit("summary").alias("part"), "rows", "command", "correct")
    body = read("detail").groupBy("command").agg(F.count("*").alias("rows"), F.sum("correct").alias("correct"))
    return head.unionByName(body.select(F.lit("detail").alias("part"), "rows", "command", "correct"))
