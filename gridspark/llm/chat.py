"""Chat formatting: tool calls linked to results, ordered, validated and serialised. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.ordered import number_rows

from .common import free_shuffles, stored, tuned

SCHEMA_COLUMNS = "tool string, field string, kind string, required boolean, low double, high double, choices array<string>"


def topological_depth(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, depth: 0 without links, otherwise one more than the deepest node it comes after; null on or behind a cycle.

    ``links`` (node, after) counts only where both are in ``nodes``. Each round takes off the links to nodes
    that are settled, so there are as many rounds as the longest chain has links.
    """
    spark = nodes.sparkSession
    known = nodes.select("node").distinct()
    left = stored(
        links.join(known, "node", "left_semi").join(known.withColumnRenamed("node", "after"), "after", "left_semi").select("node", "after").distinct(),
        "open-links")
    settled = stored(known.join(left, "node", "left_anti").withColumn("depth", F.lit(0)), "settled")
    out, depth = [settled], 0
    while True:
        depth += 1
        rest = stored(left.join(settled.select(F.col("node").alias("after")), "after", "left_anti"), "open-links")
        settled = stored(
            left.select("node").distinct().join(rest, "node", "left_anti").withColumn("depth", F.lit(depth)), "settled")
        free_shuffles(spark)
        if not settled.limit(1).count():
            break
        out.append(settled)
        left = rest
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.unionByName(left.select("node").distinct().withColumn("depth", F.lit(None).cast("int")))


def field_error(value: Column, rule: Column) -> Column:
    """What is wrong with the variant ``value`` under one rule of a schema, or null."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    name = rule["field"]
    fits = (
        F.when(rule["kind"] == "string", kind == "STRING").when(rule["kind"] == "boolean", kind == "BOOLEAN")
        .when(rule["kind"] == "integer", kind == "BIGINT").when(rule["kind"] == "number", (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"))
        .when(rule["kind"] == "array", kind.startswith("ARRAY")).when(rule["kind"] == "object", kind.startswith("OBJECT")).otherwise(F.lit(False))
    )
    return (
        F.when(value.isNull(), F.when(rule["required"], F.concat(name, F.lit(": missing"))))
        .when(~fits, F.concat(name, F.lit(": not "), rule["kind"]))
        .when(number < rule["low"], F.concat(name, F.lit(": too small")))
        .when(number > rule["high"], F.concat(name, F.lit(": too large")))
        .when(~F.array_contains(rule["choices"], F.try_variant_get(value, "$", "string")), F.concat(name, F.lit(": not a choice")))
    )


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: conv_id, call_id, tool, depth, position, linked, valid, errors, message.

    ``calls``: conv_id, call_id, place (order of appearance), tool, arguments (JSON text), after (ids of calls
    whose results it uses). ``results``: call_id, content. ``schemas``: see SCHEMA_COLUMNS.

    * Results meet calls in a hash join on the identifier. Of several results of a call the first in text order
      counts; results without a call fall away; a call without a result, or with a null id, is not linked.
    * Calls that share an identifier are one node of the order; each row carries the error ``id: repeated``.
    * position counts 1.. in a conversation by depth, then place; calls on or behind a cycle come last and have a
      null depth. Calls without a conversation have no position.
    * errors lists, joined by ``; ``, what is wrong with the arguments by field name; fields that no
      schema knows, unknown tools and text that is no JSON object are errors too.
    * message is JSON without spaces, keys sorted at every level, absent values left out.

    Empty tables give empty results. No step gathers a conversation in one task.
    """
    tuned(calls.sparkSession)
    calls = calls.select(
        "conv_id", "call_id", F.col("place").cast("long"), "tool", "arguments", F.coalesce("after", F.array().cast("array<string>")).alias("after"))
    depth = topological_depth(
        calls.select(F.col("call_id").alias("node")).where("node is not null"),
        calls.select(F.col("call_id").alias("node"), F.explode("after").alias("after")))
    answers = results.groupBy("call_id").agg(F.min("content").alias("content"), F.lit(True).alias("linked"))
    seen = calls.groupBy("call_id").agg((F.count(F.lit(1)) > 1).alias("again")).where("again")
    rules = schemas.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct(
        "field", "kind", "required", "low", "high", "choices"))).alias("rules"))
    joined = (
        calls.join(depth.withColumnRenamed("node", "call_id"), "call_id", "left")
        .join(answers.hint("shuffle_hash"), "call_id", "left").join(seen, "call_id", "left").join(rules, "tool", "left")
    )
    parsed = joined.withColumn("given", F.expr("try_parse_json(arguments)")).withColumn(
        "fields", F.when(F.expr("schema_of_variant(given)").startswith("OBJECT"), F.from_json("arguments", "map<string,variant>")))
    wrong = F.transform("rules", lambda rule: field_error(F.element_at("fields", rule["field"]), rule))
    extra = F.transform(
        F.array_sort(F.array_except(F.map_keys("fields"), F.transform("rules", lambda rule: rule["field"]))),
        lambda name: F.concat(name, F.lit(": unknown")))
    errors = F.concat(
        F.when(F.col("again"), F.array(F.lit("id: repeated"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("rules").isNull(), F.array(F.lit("tool: unknown")))
        .when(F.col("fields").isNull(), F.array(F.lit("arguments: no object")))
        .otherwise(F.filter(F.concat(wrong, extra), lambda e: e.isNotNull())))
    message = F.struct(
        "after", F.coalesce("given", F.expr("to_variant_object(named_struct('text', arguments))")).alias("arguments"),
        F.col("call_id").alias("id"), F.col("content").alias("result"), "tool")
    # The part follows the order of a conversation, so that numbering needs no whole conversation in one task.
    part = F.coalesce(F.col("depth").cast("long"), F.lit(1 << 30)) * F.lit(1 << 32) + F.floor(F.col("place") / 4096)
    rows = parsed.withColumn("found", errors).withColumn("plain", F.to_json(message)).select(
        "conv_id", "call_id", "tool", "place", "depth", F.coalesce("linked", F.lit(False)).alias("linked"),
        F.array_join("found", "; ").alias("errors"), F.expr("to_json(parse_json(plain))").alias("message"), part.alias("part"))
    rows = stored(rows, "calls")
    numbered = number_rows(rows.where("conv_id is not null"), ["conv_id"], "part", ["place", "call_id"], "position").unionByName(
        rows.where("conv_id is null").withColumn("position", F.lit(None).cast("long")))
    return numbered.select(
        "conv_id", "call_id", "tool", "depth", F.col("position").cast("long"), "linked", (F.col("errors") == "").alias("valid"), "errors", "message")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read out of plain conversations: each assistant turn calls a tool on its whole text, the
    turn after it, by anyone else, is the result, and a call uses the result of the call at half its turn."""
    size = F.char_length("text")
    name = lambda turn: F.concat(F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    count = size % 3 == 0
    calls = turns.where("role = 'assistant'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), F.col("turn").alias("place"),
        F.when(count, "count").otherwise("lookup").alias("tool"),
        F.when(count, F.to_json(F.struct(
            F.element_at(F.array(*map(F.lit, ("words", "letters", "lines", "words"))), (size % 4 + 1).cast("int")).alias("unit"), F.col("text"))))
        .otherwise(F.to_json(F.struct(F.col("text").alias("term"), (size % 60).alias("limit")))).alias("arguments"),
        F.when(F.col("turn") > 0, F.array(name(F.floor(F.col("turn") / 2)))).alias("after"))
    results = turns.where("role <> 'assistant'").select(name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def tool_schemas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([
        ("count", "text", "string", True, None, None, None),
        ("count", "unit", "string", True, None, None, ["words", "letters"]),
        ("lookup", "limit", "integer", True, 1.0, 50.0, None),
        ("lookup", "term", "string", True, None, None, None),
    ], SCHEMA_COLUMNS)


def op1_chat_tools(spark, sf_dir: str) -> DataFrame:
    """Tool calls of every conversation."""
    turns = tuned(spark).read.parquet(f"{sf_dir}/conversations.parquet")
    return link_tool_calls(*conversation_calls(turns), tool_schemas(spark))


OP1_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, turn, text, length(text) AS size, conv_id || '-' || turn AS call_id FROM conversations WHERE role = 'assistant'),
link AS (
  SELECT c.conv_id, c.turn, p.turn AS before FROM c LEFT JOIN c p ON p.conv_id = c.conv_id AND c.turn > 0 AND p.turn = c.turn // 2),
deep AS (
  SELECT conv_id, turn, 0 AS depth FROM link WHERE before IS NULL
  UNION ALL
  SELECT l.conv_id, l.turn, d.depth + 1 FROM link l JOIN deep d ON l.conv_id = d.conv_id AND l.before = d.turn),
answer AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS content FROM conversations WHERE role <> 'assistant' GROUP BY ALL),
made AS (
  SELECT c.*, depth, content, size % 3 = 0 AS counts, ['words', 'letters', 'lines', 'words'][CAST(size % 4 + 1 AS INT)] AS unit
  FROM c JOIN deep USING (conv_id, turn) LEFT JOIN answer USING (conv_id, turn)),
told AS (
  SELECT *, CASE WHEN counts AND unit = 'lines' THEN 'unit: not a choice' WHEN NOT counts AND size % 60 < 1 THEN 'limit: too small'
                 WHEN NOT counts AND size % 60 > 50 THEN 'limit: too large' ELSE '' END AS errors FROM made)
SELECT conv_id, call_id, CASE WHEN counts THEN 'count' ELSE 'lookup' END AS tool, depth,
  row_number() OVER (PARTITION BY conv_id ORDER BY depth, turn // 4096, turn, call_id) AS position,
  content IS NOT NULL AS linked, errors = '' AS valid, errors,
  '{"after":' || CASE WHEN turn > 0 THEN '["' || conv_id || '-' || (turn // 2) || '"]' ELSE '[]' END || ',"arguments":' ||
  CASE WHEN counts THEN '{"text":' || to_json(text) || ',"unit":"' || unit || '"}' ELSE '{"limit":' || (size % 60) || ',"term":' || to_json(text) || '}' END ||
  ',"id":"' || call_id || '"' || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content) END ||
  ',"tool":"' || CASE WHEN counts THEN 'count' ELSE 'lookup' END || '"}' AS message
FROM told
"""
