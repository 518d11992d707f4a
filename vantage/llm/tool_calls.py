"""Tool-call linking, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


#: Types of a schema, and how the types of parsed values that fit them begin.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY"}


def canonical(json: str):
    """Compact JSON with sorted keys; null for text that is not JSON."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame) -> DataFrame:
    """(call_id, depends_on array) -> (call_id, level): 0 without known dependencies, else one more than the
    highest of them; null on and behind cycles. Dependencies on unknown calls are ignored.

    Each round settles the calls whose dependencies are all settled and ends when none is, so rounds follow the
    longest chain, however long. Settled levels are written together every 16 rounds.
    """
    edges = calls.select("call_id", F.explode(F.array_distinct("depends_on")).alias("dep")).join(calls.select(F.col("call_id").alias("dep")), "dep")
    edges = materialize(edges, "edges")
    done = materialize(calls.select("call_id").join(edges, "call_id", "left_anti").withColumn("level", F.lit(0)), "levels")
    fresh, parts = done, done
    level = 0
    while not fresh.isEmpty():
        level += 1
        asked = edges.join(fresh.select(F.col("call_id").alias("dep")), "dep", "left_semi").select("call_id").distinct()
        open_ = edges.join(asked, "call_id", "left_semi").join(parts.select(F.col("call_id").alias("dep"), "level"), "dep", "left").groupBy("call_id").agg(F.count("*").alias("n"), F.count("level").alias("k"))
        fresh = materialize(open_.where("n = k").select("call_id", F.lit(level).alias("level")), "levels")
        parts = parts.unionByName(fresh)
        if level % 16 == 0:
            parts = materialize(parts, "levels")
    return calls.select("call_id").join(parts, "call_id", "left")


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per distinct call_id.

    calls: call_id, conv_id, turn, name, arguments (JSON), depends_on array<string>. results: call_id, content.
    schemas: name, param, type (of TYPES), required. Returns call_id, conv_id,
    position (topological: by level, turn and call_id within the conversation), level, n_results, result
    (the least), errors (sorted, comma-joined), valid, canonical (JSON of the linked call).

    A repeated call_id keeps its least row; calls without an id are dropped; results of unknown calls are too.
    Unknown tools, text that is not a JSON object, missing, unknown and mistyped arguments are errors; so is a cycle.
    Arguments are checked as parsed values, at the top level only; a type that is not of TYPES fits nothing.
    Empty tables give no rows; columns beyond those named are not read.
    """
    calls = calls.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.min(F.struct("conv_id", "turn", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on"))).alias("c")).select("call_id", "c.*")
    calls = materialize(calls, "calls")
    answers = results.where(F.col("call_id").isNotNull()).groupBy("call_id").agg(F.count("*").alias("n_results"), F.min("content").alias("result"))
    tools = schemas.groupBy("name").agg(F.collect_list(F.struct("param", "type", "required")).alias("params"))
    rows = calls.join(levels(calls), "call_id").join(answers, "call_id", "left").join(tools, "name", "left")
    rows = rows.withColumn("_v", canonical("arguments")).withColumn("_keys", F.json_object_keys("_v")).withColumn("_map", F.from_json("_v", "map<string,variant>"))
    # schema_of_variant names the type of a parsed value
    shape = "case " + " ".join(f"when x.type = '{k}' then kind rlike '^({v})' " for k, v in TYPES.items()) + "else false end"
    kind = "schema_of_variant(element_at(_map, x.param))"
    wrong = F.expr(f"""filter(transform(params, x -> case
        when not array_contains(coalesce(_keys, array()), x.param) then if(x.required, concat('missing:', x.param), null)
        when not ({shape.replace("kind", kind)}) then concat('type:', x.param) end), e -> e is not null)""")
    extra = F.expr("transform(array_except(coalesce(_keys, array()), transform(params, x -> x.param)), k -> concat('unknown:', k))")
    errors = F.when(F.col("params").isNull(), F.array(F.lit("tool"))).when(F.col("_keys").isNull(), F.array(F.lit("json"))).otherwise(F.concat(wrong, extra))
    errors = F.concat(errors, F.when(F.col("level").isNull(), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("errors", F.array_join(F.sort_array(errors), ",")).withColumn("valid", F.col("errors") == "")
    ranked = Window.partitionBy("conv_id").orderBy(F.col("level").isNull(), "level", "turn", "call_id")
    rows = rows.withColumn("position", F.row_number().over(ranked).cast("long"))
    told = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), F.coalesce("name", F.lit("")).alias("name")), {"ignoreNullFields": "false"})
    return rows.select("call_id", "conv_id", "position", F.col("level").cast("long").alias("level"), F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), "result", "errors", "valid", told.alias("canonical"))
