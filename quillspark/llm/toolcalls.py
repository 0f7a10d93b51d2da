"""Chat formatting: tool calls linked to results, ordered, validated and serialised (DataFrame functions only).

Calls and results are hash-joined by conversation and identifier. Calls are ordered topologically by
the calls that they come after: a call's level is one more than the highest level before it, found by
pointer jumping along chains and level by level where several meet. Arguments are
parsed as variants, checked against the schema of their tool, and serialised as canonical JSON: keys
sorted, no white space, numbers in their shortest form.

Defined results: of calls that share conversation and identifier the one of the smallest turn (then
name, then arguments) stays, and so with results; equal rows count once. A call without a result, with
an unknown tool, with arguments that aren't a JSON object, or after an identifier that doesn't exist
is kept and says so in ``errors``. Calls on or behind a cycle have a null level. Rows with a null
conversation or identifier can't be linked and are left out; null arguments are those of no object.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import read, sql_text, written

#: Tool: its fields as (key, type, required); types are those of JSON Schema.
Schemas = dict[str, list[tuple[str, str, bool]]]

#: Types of variants, by prefix, for each type of JSON Schema.
KINDS = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"),
    "boolean": ("BOOLEAN",),
    "object": ("OBJECT",),
    "array": ("ARRAY",),
    "null": ("VOID",),
}


def embedded_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) from turns whose text is JSON: ``{"tool_calls": [{id, name, arguments, after}]}`` of the
    assistant, ``{"tool_call_id", "content"}`` of a tool. Other texts have none."""
    form = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,after:array<string>>>>"
    jsonish = F.ltrim(F.col("text")).startswith("{")
    calls = (
        turns.filter((F.col("role") == "assistant") & jsonish & F.contains("text", F.lit('"tool_calls"')))
        .select("conv_id", "turn", F.explode(F.from_json("text", form).getField("tool_calls")).alias("c"))
        .select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    )
    results = (
        turns.filter((F.col("role") == "tool") & jsonish)
        .select("conv_id", "turn", F.from_json("text", "struct<tool_call_id:string,content:string>").alias("r"))
        .select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content"))
    )
    return calls, results


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls (conv_id, call_id, after), each once; null on or behind a cycle.

    Calls after just one other hang in chains on those after none or several. Pointer jumping gives each
    its chain's top and its distance from there, in rounds that grow with the logarithm of a chain's
    length; only the tops after several are then taken level by level.
    """
    keys = ["conv_id", "call_id"]
    edges = calls.select(*keys, F.explode("after").alias("parent")).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("parent"))
    edges = written(edges.join(known, ["conv_id", "parent"], "left_semi"))
    degree = edges.groupBy(*keys).agg(F.count("*").alias("n"), F.min("parent").alias("up"))
    nodes = written(calls.select(*keys).join(degree, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "up"))
    total = nodes.count()

    tops = nodes.filter("n != 1").select("conv_id", "call_id", F.col("call_id").alias("up"), F.lit(0).cast("long").alias("far"), F.lit(True).alias("done"))
    state = tops.unionByName(nodes.filter("n = 1").select("conv_id", "call_id", "up", F.lit(1).cast("long").alias("far"), F.lit(False).alias("done")))
    reach = 1
    while True:
        state = written(state)
        open_ = state.filter("not done")
        if reach > 2 * total or open_.isEmpty():
            break  # what is still open then goes round in a cycle
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("top"), F.col("far").alias("more"), F.col("done").alias("ends"))
        jumped = open_.join(above, ["conv_id", "up"]).select("conv_id", "call_id", F.col("top").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("ends").alias("done"))
        state = state.filter("done").unionByName(jumped)
        reach *= 2

    level = nodes.filter("n = 0").select(*keys, F.lit(0).cast("long").alias("level"))
    merging = nodes.filter("n > 1").select(*keys, "n")
    if not merging.isEmpty():
        level = written(level)
        # From the top of each parent's chain to the call that comes after several.
        parents = state.filter("done").select("conv_id", F.col("call_id").alias("parent"), F.col("up").alias("top"), (F.col("far") + 1).alias("weight"))
        links = written(edges.join(merging.select(*keys), keys, "left_semi").join(parents, ["conv_id", "parent"]).select(*keys, "top", "weight"))
        front, pending = level, written(merging.select(*keys, F.col("n").alias("left"), F.lit(0).cast("long").alias("level")))
        parts = [level]
        while True:
            freed = links.join(front.select("conv_id", F.col("call_id").alias("top"), F.col("level").alias("at")), ["conv_id", "top"])
            freed = freed.groupBy(*keys).agg(F.count("*").alias("freed"), F.max(F.col("at") + F.col("weight")).alias("reached"))
            left = F.col("left") - F.coalesce("freed", F.lit(0))
            step = written(pending.join(freed, keys, "left").select(*keys, left.alias("left"), F.greatest("level", "reached").alias("level")))
            front, pending = step.filter("left = 0").select(*keys, "level"), step.filter("left > 0")
            if front.isEmpty():
                break
            parts.append(front)
        level = parts[0]
        for more in parts[1:]:
            level = level.unionByName(more)
    tops = level.select("conv_id", F.col("call_id").alias("up"), F.col("level").alias("base"))
    return state.filter("done").join(tops, ["conv_id", "up"]).select("conv_id", "call_id", (F.col("base") + F.col("far")).alias("level"))


def _errors(schemas: Schemas) -> str:
    """SQL: what is wrong with ``types`` (key to variant type) of the tool ``name``."""
    tools = []
    for tool, fields in schemas.items():
        checks = []
        for key, kind, required in fields:
            fits = " or ".join(f"startswith(types[{sql_text(key)}], {sql_text(k)})" for k in KINDS[kind])
            missing = f"'missing:{key}'" if required else "null"
            checks.append(f"case when not map_contains_key(types, {sql_text(key)}) then {missing} when not ({fits}) then {sql_text(f'type:{key}')} end")
        known = ", ".join(sql_text(k) for k, _, _ in fields)
        unknown = f"transform(array_except(map_keys(types), array({known})), k -> concat('unknown:', k))"
        tools.append(f"when name = {sql_text(tool)} then concat(array({', '.join(checks)}), {unknown})")
    return f"case when types is null then array('arguments') {' '.join(tools)} else array('tool') end"


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: conv_id, call_id, name, turn, level, result_turn, errors, record (canonical JSON).

    calls: conv_id, turn, call_id, name, arguments (JSON), after (array of identifiers or null);
    results: conv_id, turn, call_id, content.
    """
    keys = ["conv_id", "call_id"]
    linked = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls = calls.filter(linked).groupBy(*keys).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"))
    calls = written(calls.select(*keys, "c.*").withColumn("after", F.array_compact(F.coalesce("after", F.array().cast("array<string>")))))
    results = results.filter(linked).groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r")).select(*keys, F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"))

    asked = calls.select(*keys, F.explode(F.array_distinct("after")).alias("parent"))
    there = calls.select("conv_id", F.col("call_id").alias("parent"))
    lost = asked.join(there, ["conv_id", "parent"], "left_anti").groupBy(*keys).agg(F.count("*").alias("lost"))

    df = calls.join(results, keys, "left").join(levels(calls.select(*keys, "after")), keys, "left").join(lost, keys, "left")
    df = df.withColumn("v", F.try_parse_json("arguments")).withColumn("is_object", F.expr("startswith(schema_of_variant(v), 'OBJECT')"))
    df = df.withColumn("types", F.expr("case when is_object then transform_values(from_json(to_json(v), 'map<string,variant>'), (k, x) -> coalesce(schema_of_variant(x), 'VOID')) end"))
    more = "case when result_turn is null then 'result' end, case when result_turn < turn then 'order' end, case when lost > 0 then 'after' end, case when level is null then 'cycle' end"
    df = df.withColumn("errors", F.expr(f"array_sort(array_compact(concat({_errors(schemas)}, array({more}))))"))
    record = "to_json(named_struct('arguments', v, 'call_id', call_id, 'errors', errors, 'level', level, 'name', name, 'result', result), map('ignoreNullFields', 'false'))"
    return df.select(*keys, "name", "turn", "level", "result_turn", "errors", F.expr(record).alias("record"))


ASK: Schemas = {"ask": [("after", "string", False), ("chars", "integer", True), ("text", "string", True)]}


def dialogue_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain dialogues as calls: each user turn asks, after the user turn two places before, and the turn that
    follows, if it is the assistant's, is its result."""
    turns = turns.filter(F.col("turn").isNotNull())
    name = lambda at: F.concat(F.lit("turn-"), F.col("turn") + at)
    arguments = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.length(F.coalesce("text", F.lit(""))).alias("chars"), name(-2).alias("after")))
    calls = turns.filter("role = 'user'").select("conv_id", "turn", name(0).alias("call_id"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.when(F.col("turn") > 1, F.array(name(-2))).alias("after"))
    results = turns.filter("role = 'assistant'").select("conv_id", "turn", name(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call of every conversation, embedded ones and those that the dialogue itself makes."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    calls, results = (a.unionByName(b) for a, b in zip(embedded_calls(turns), dialogue_calls(turns), strict=True))
    df = link_tool_calls(calls, results, ASK)
    return df.select("conv_id", "call_id", "name", "turn", "level", "result_turn", F.array_join("errors", ",").alias("errors"), "record")


#: The dialogues' calls; tables here embed none.
OP5_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
calls AS (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM t WHERE role = 'user' GROUP BY conv_id, turn),
results AS (SELECT conv_id, turn, min(text) AS content FROM t WHERE role = 'assistant' GROUP BY conv_id, turn),
linked AS (
  SELECT c.conv_id, c.turn, c.text, r.turn AS result_turn, r.content,
         c.turn > 1 AND p.turn IS NULL AS lost,
         c.turn // 2 - row_number() OVER (PARTITION BY c.conv_id, c.turn % 2 ORDER BY c.turn) AS island
  FROM calls c
  LEFT JOIN results r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1
  LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
),
levelled AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM linked)
SELECT conv_id, 'turn-' || turn AS call_id, 'ask' AS name, turn, level, result_turn,
       concat_ws(',', CASE WHEN lost THEN 'after' END, CASE WHEN result_turn IS NULL THEN 'result' END) AS errors,
       '{"arguments":{"after":"turn-' || (turn - 2) || '","chars":' || length(text) || ',"text":' || CAST(to_json(text) AS VARCHAR)
       || '},"call_id":"turn-' || turn || '","errors":['
       || concat_ws(',', CASE WHEN lost THEN '"after"' END, CASE WHEN result_turn IS NULL THEN '"result"' END)
       || '],"level":' || level || ',"name":"ask","result":' || CASE WHEN content IS NULL THEN 'null' ELSE CAST(to_json(content) AS VARCHAR) END || '}' AS record
FROM levelled
"""
