"""Streaming queries: the driver tables arrive as a file stream, results land in a log table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridspark.operators.scoring import score_cells
from gridspark.plans import inputs as I
from gridspark.plans.registry import query, rounded
from gridspark.plans.table_queries import DEBOUNCED, STOPS
from gridspark.session import scratch
from gridspark.sources.readers import read_table
from gridspark.streaming import operators as R
from gridspark.streaming import ordered as S
from gridspark.streaming import tables as T


def arriving(spark, sf, name):
    """A driver table as a stream of files."""
    schema = read_table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def events(spark, sf):
    return arriving(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def landed(spark, stream, name, keys=None, mode="append", sink=None, order=None):
    """Run the stream over what is available and return the table it leaves behind."""
    path = scratch(spark, name)
    R.run_available(stream, sink(path) if sink else R.append_log(path), scratch(spark, f"{name}-offsets"), mode)
    schema = StructType(list(stream.schema.fields))
    if keys:
        return R.latest_by_key(spark, path, schema, keys, order)
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


@query("stream_score", "R1", I.SCORED_CTE + """
SELECT o_orderpriority AS source, count(*) AS cells, count(*) FILTER (filled) AS filled, count(*) FILTER (correct AND filled) AS filled_correct,
  count(*) FILTER (correct AND NOT filled) AS empty_correct, count(*) FILTER (filled AND predicted = 0) AS missed,
  count(*) FILTER (filled AND predicted <> 0 AND NOT correct) AS wrong_digit, count(*) FILTER (NOT filled AND predicted <> 0) AS hallucinated
FROM fx_scored JOIN orders ON o_orderkey = image_id GROUP BY 1""")
def stream_score(spark, sf):
    """Images arrive, meet their static source by key, unfold to cells and are counted."""
    arrived = arriving(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    known = read_table(spark, sf, "orders").selectExpr("o_orderkey AS image_id", "o_orderpriority AS source")
    cells = I.read_cells(I.unfold_cells(arrived.join(known, "image_id")), "source")
    return landed(spark, R.stream_score(score_cells(cells), "source"), "score", ["source"], "update")


_WINDOW = """SELECT strftime({start}, '%Y-%m-%d %H:%M') AS start, count(*) AS n, count(*) FILTER (event_type <> 'error') AS succeeded,
  round(sum(value), 4) AS total_ms, max(value) AS max_ms FROM {source} GROUP BY 1"""


def _windowed(spark, sf, name, window, slide=None):
    ok = F.col("event_type") != "error"
    out = landed(spark, R.windowed_metrics(events(spark, sf), "ts", "value", ok, window, slide), name, ["start"], "update")
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")), "total_ms", digits=4)


@query("windowed_metrics", "R2", _WINDOW.format(start="date_trunc('hour', ts)", source="events"))
def windowed_metrics(spark, sf):
    return _windowed(spark, sf, "tumbling", "1 hour")


@query("sliding_metrics", "R2", _WINDOW.format(
    start="w", source="(SELECT *, time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes' * unnest(range(0, 4)) AS w FROM events)"))
def sliding_metrics(spark, sf):
    return _windowed(spark, sf, "sliding", "1 hour", "15 minutes")


@query("latency_sketches", "R2 A19", """
WITH w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS start, value FROM events, range(0, 4) t(k))
SELECT strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n, min(value) AS low, max(value) AS high, true AS median_fits, true AS p95_fits FROM w GROUP BY 1""")
def latency_sketches(spark, sf):
    """Percentiles of four-hour windows that slide by an hour, merged from hourly sketches.

    The events arrive as several files in micro-batches of one. The flags say whether the
    stated share of values lies at or below each percentile, up to the sketch's error.
    """
    place = scratch(spark, "event-files")
    I.events(spark, sf).select("ts", "value").repartition(4, "value").write.parquet(place)
    arriving_ = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(place)
    panes = landed(spark, R.windowed_sketches(arriving_, "ts", "value", "1 hour", "3650 days"), "sketches", ["start"], "update")
    points = {"median_ms": 0.5, "p95_ms": 0.95}
    told = R.sketch_percentiles(R.merged_sketches(panes, "4 hours", "1 hour"), points)
    values = I.events(spark, sf).select(F.window("ts", "4 hours", "1 hour")["start"].alias("start"), "value")
    share = lambda test, name: F.count_if(test).alias(name)
    ranks = values.join(told, "start").groupBy("start", "n", "low", "high").agg(*[
        share(op, f"{side}_{c}") for c in points for side, op in (("upto", F.col("value") <= F.col(c)), ("below", F.col("value") < F.col(c)))
    ])
    fits = lambda c, q: (F.col(f"upto_{c}") >= (q - R.SKETCH_ERROR) * F.col("n")) & (F.col(f"below_{c}") <= (q + R.SKETCH_ERROR) * F.col("n"))
    return ranks.select(
        F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "low", "high",
        fits("median_ms", 0.5).alias("median_fits"), fits("p95_ms", 0.95).alias("p95_fits"),
    )


@query("session_activity", "R3", """
WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 4 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM a),
g AS (SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 4 HOUR AS fin, count(*) AS events FROM s GROUP BY user_id, k)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(fin, '%Y-%m-%d %H:%M:%S') AS "end", events FROM g
WHERE date_trunc('milliseconds', fin) <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def session_activity(spark, sf):
    sessions = R.session_activity(events(spark, sf), "user_id", "ts", "4 hours", "1 hour")
    R.use_rocksdb(spark)
    out = landed(spark, sessions, "sessions")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select("user_id", stamp("start"), stamp("end"), "events")


@query("stream_debounce", "R4", DEBOUNCED + "SELECT user_id, event_id FROM fx_kept")
def stream_debounce(spark, sf):
    R.use_rocksdb(spark)
    out = R.stream_debounce(events(spark, sf), "user_id", "ts", "event_id", 12 * 3600)
    return landed(spark, out, "debounce").select("user_id", "event_id")


@query("stream_early_stop", "R5", STOPS.replace("{p}", "10") + "SELECT run, stop_epoch, best_epoch, best_value FROM fx_stops WHERE stopped_early")
def stream_early_stop(spark, sf):
    R.use_rocksdb(spark)
    curve = events(spark, sf).select(F.col("user_id").alias("run"), "ts", "event_id", "value")
    return landed(spark, R.stream_early_stop(curve, "run", ["ts", "event_id"], "value", 10), "stops")


@query("stream_upsert", "R6", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def stream_upsert(spark, sf):
    stream = events(spark, sf).select("user_id", "ts", "event_id", "event_type", "value")
    order = F.struct("ts", "event_id")
    out = landed(spark, stream, "upsert", ["user_id"], sink=lambda p: R.upsert_log(p, "user_id", order), order=order)
    return out.select("user_id", "event_type", "value")


@query("stream_validate", "R7", """
SELECT CASE WHEN o_orderkey % 11 = 5 THEN 'malformed' WHEN o_orderkey % 7 = 0 THEN 'conflict' ELSE 'ok' END AS status, count(*) AS puzzles FROM orders GROUP BY 1""")
def stream_validate(spark, sf):
    arrived = arriving(spark, sf, "orders").select(F.col("o_orderkey").alias("puzzle_id"))
    grids = I.computed(arrived, "puzzle_id", clues=I.grid_columns(bad=True)["clues"])
    rows = F.expr("CASE WHEN puzzle_id % 11 = 5 THEN 8 ELSE 9 END")
    nested = F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.slice("clues", r * 9 + 1, F.lit(9)))
    tagged = R.stream_validate(grids.select("puzzle_id", nested.alias("grid")), "grid")
    return landed(spark, tagged.select("puzzle_id", "status"), "validate").groupBy("status").agg(F.count("*").alias("puzzles"))


@query("stream_dedup", "R8", I.cte(I.IDX81, I.CELLS) + """
SELECT grid, count(*) AS kept FROM (SELECT DISTINCT string_agg(clue::VARCHAR, '' ORDER BY idx) AS grid FROM fx_cells GROUP BY image_id) GROUP BY 1""")
def stream_dedup(spark, sf):
    arrived = arriving(spark, sf, "orders").select(
        F.col("o_orderkey").alias("puzzle_id"), F.col("o_orderdate").cast("timestamp").alias("ts")
    )
    grids = I.computed(arrived, "puzzle_id", "ts", clues=I.grid_columns()["clues"])
    text = F.array_join(F.col("clues").cast("array<string>"), "").alias("grid")
    first = R.stream_dedup(grids.select("puzzle_id", "ts", text), "grid", "ts", "1 day")
    return landed(spark, first.select("grid"), "dedup").groupBy("grid").agg(F.count("*").alias("kept"))


WAVES, FILES, LATE_HOURS = 4, 2, 2


def waves(spark, sf):
    """All events in four waves of files; rows arrive up to an hour late, so waves overlap in time."""
    place = scratch(spark, "waves")
    late = F.pmod(F.xxhash64("event_id"), F.lit(3600)) * 1_000_000
    rows = I.events(spark, sf).select("user_id", "ts", "event_id", "event_type", "value", (F.unix_micros("ts") + late).alias("arrival"))
    low, high = rows.agg(F.coalesce(F.min("arrival"), F.lit(0)), F.coalesce(F.max("arrival"), F.lit(0))).first()
    wave = F.floor((F.col("arrival") - low) * WAVES / (high - low + 1))
    for k in range(WAVES):
        rows.filter(wave == k).drop("arrival").repartition(FILES).write.parquet(f"{place}/wave-{k}")
    schema = rows.drop("arrival").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES).parquet(f"{place}/wave-*")


_MARK = f"(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL {LATE_HOURS} HOUR FROM events)"


@query("debounce_in_order", "R4", DEBOUNCED + f"SELECT user_id, event_id FROM fx_kept WHERE ts <= {_MARK}")
def debounce_in_order(spark, sf):
    """Rows out of order over several micro-batches; accepted is what the whole table accepts up to the watermark."""
    R.use_rocksdb(spark)
    out = S.debounce_in_order(waves(spark, sf), "user_id", "ts", "event_id", 12 * 3600, f"{LATE_HOURS} hours")
    return landed(spark, out, "debounce-in-order").select("user_id", "event_id")


@query("curves_in_order", "R5", f"""
WITH e AS (SELECT user_id AS run, ts, event_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 24 HOUR THEN 1 ELSE 0 END AS cut FROM events),
s AS (SELECT *, sum(cut) OVER (PARTITION BY run ORDER BY ts, event_id) AS k FROM e),
n AS (SELECT *, row_number() OVER w AS epoch, greatest(coalesce(max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS prev FROM s WINDOW w AS (PARTITION BY run, k ORDER BY ts, event_id)),
i AS (SELECT *, coalesce(max(CASE WHEN value > prev THEN epoch END) OVER (PARTITION BY run, k ORDER BY epoch), 0) AS improved FROM n),
x AS (SELECT run, k, min(ts) AS start, max(ts) AS fin, max(epoch) AS epochs, min(epoch) FILTER (epoch - improved >= 5) AS stop FROM i GROUP BY ALL)
SELECT x.run, strftime(x.start, '%Y-%m-%d %H:%M:%S') AS start, coalesce(stop, epochs) AS stop_epoch, stop IS NOT NULL AS stopped_early,
  max(improved) AS best_epoch, greatest(max(value), 0.0) AS best_value
FROM x JOIN i ON i.run = x.run AND i.k = x.k AND i.epoch <= coalesce(stop, epochs)
GROUP BY x.run, x.k, x.start, x.fin, stop, epochs HAVING CASE WHEN stop IS NULL THEN x.fin + INTERVAL 24 HOUR ELSE max(i.ts) END <= {_MARK}""")
def curves_in_order(spark, sf):
    """A curve ends by its patience or after a day of quiet; the run may begin another one later."""
    R.use_rocksdb(spark)
    curve = waves(spark, sf).withColumnRenamed("user_id", "run")
    out = S.curves_in_order(curve, "run", "ts", "event_id", "value", 5, 24 * 3600, f"{LATE_HOURS} hours")
    done = landed(spark, out, "curves-in-order")
    return done.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("upsert_compacted", "R6", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def upsert_compacted(spark, sf):
    """Four micro-batches; after each third one base replaces the deltas, so the result is read from base and delta."""
    stream, order, path = waves(spark, sf), F.struct("ts", "event_id"), scratch(spark, "upsert-table")
    R.run_available(stream, T.upsert_table(path, "user_id", order, every=3), scratch(spark, "upsert-table-offsets"))
    return T.current(spark, path, stream.schema, "user_id", order).select("user_id", "event_type", "value")
