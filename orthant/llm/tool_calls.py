"""Chat formatting: tool calls linked with their results, in dependency order, as canonical JSON.

Method. Calls and results are hash-joined by (conversation, space, call id); a space keeps the ids of calls written into
texts apart from those of turns taken as calls. A call that refers to others (an argument that is wholly the string
"$id"; a turn taken as a call refers to its conversation's first such turn, whatever its text says) comes after them: levels follow by rounds of joins, each of which settles the calls whose
references are settled (as many rounds as the longest chain of references; calls without references need none); what
no round settles refers to itself, in a circle or to no call, and has no level. Rows order by level, turn, place
in the turn and result turn. Arguments are parsed and validated against the named tool's schema: each field
present if required, of its type, and not below its minimum. JSON is canonical: keys in order, no white space.

DataFrame code only. A row for each linked result, so no conversation or call is gathered into one task; schemas
join by name. Rounds are checkpointed.

Edge cases: null ids link with nothing; a call without results keeps one row, a null result; a result without a call
is left out; repeated results give a row each; a repeated call id in a conversation counts as several calls;
arguments that are no JSON object, or whose tool has no schema, are not valid; null text counts as empty; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._util import checkpoint, table

#: The tools of the conversations' own exchanges: (name, field, type, required, minimum).
EXCHANGE_FIELDS = (("system", "after", "string", False, None), ("user", "after", "string", False, None), ("system", "text", "string", True, None), ("system", "words", "number", True, 1.0), ("user", "text", "string", True, None), ("user", "words", "number", True, 1.0))
_FIELDS_SQL = "name string, field string, kind string, required boolean, minimum double"


def embedded_calls(messages: DataFrame) -> DataFrame:
    """conv_id, space, turn, place, call_id, name, arguments (JSON text), refs of <tool_call>{"id":, "name":, "arguments":}</tool_call> in assistants' texts."""
    found = messages.where("role = 'assistant'").select("conv_id", "turn", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1)).alias("place", "body"))
    parsed = found.withColumn("v", F.try_parse_json("body"))
    calls = parsed.select("conv_id", F.lit("id").alias("space"), "turn", "place", F.try_variant_get("v", "$.id", "string").alias("call_id"), F.try_variant_get("v", "$.name", "string").alias("name"), F.to_json(F.try_variant_get("v", "$.arguments", "variant")).alias("arguments"))
    return calls.withColumn("refs", references(F.col("arguments")))


def references(arguments: Column) -> Column:
    """The ids that arguments (a JSON object's text) refer to: values that are wholly a $ and an id without white space."""
    strings = F.transform(F.map_values(F.from_json(arguments, "map<string,variant>")), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))
    found = F.transform(F.filter(strings, lambda x: x.rlike(r"^\$\S+$")), lambda x: F.substring(x, 2, 1 << 30))
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def embedded_results(messages: DataFrame) -> DataFrame:
    """conv_id, space, turn, call_id, content of <tool_result>{"id":, "content":}</tool_result> in any text."""
    found = messages.select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)<tool_result>(.*?)</tool_result>"), 1)).alias("body"))
    parsed = found.withColumn("v", F.try_parse_json("body"))
    return parsed.select("conv_id", F.lit("id").alias("space"), "turn", F.try_variant_get("v", "$.id", "string").alias("call_id"), F.try_variant_get("v", "$.content", "string").alias("content"))


def exchanges(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations' turns as calls (turns that are not the assistant's, with their text and words, after the first of them) and results (assistant's turns, of the last call before them)."""
    asked = messages.where(F.col("role").isNotNull() & (F.col("role") != "assistant"))
    body = F.coalesce("text", F.lit(""))
    words = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    opening = asked.groupBy("conv_id").agg(F.min("turn").alias("opening"))
    led = asked.join(opening, "conv_id", "left").withColumn("first", F.when(F.col("turn") > F.col("opening"), F.col("opening").cast("string")))
    arguments = F.to_json(F.struct(F.concat(F.lit("$"), "first").alias("after"), body.alias("text"), words.alias("words")))
    calls = led.select("conv_id", F.lit("turn").alias("space"), "turn", F.lit(0).alias("place"), F.col("turn").cast("string").alias("call_id"), F.col("role").alias("name"), arguments.alias("arguments"), F.array_compact(F.array("first")).alias("refs"))
    # the last call before a turn: of its block of turns, or of the blocks before
    span = 256
    block = F.expr(f"turn div {span}")
    told = messages.where("role = 'assistant'").select("conv_id", "turn", body.alias("content")).withColumn("block", block)
    starts = asked.select("conv_id", "turn").withColumn("block", block).groupBy("conv_id", "block").agg(F.sort_array(F.collect_set("turn")).alias("turns"))  # span turns at most
    lasts = starts.select("conv_id", "block", F.array_max("turns").alias("last")).unionByName(told.select("conv_id", "block", F.lit(None).cast("bigint").alias("last")))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    reach = lasts.groupBy("conv_id", "block").agg(F.max("last").alias("last")).select("conv_id", "block", F.max("last").over(before).alias("carried"))
    placed = told.join(starts, ["conv_id", "block"], "left").join(reach, ["conv_id", "block"], "left")
    own = F.array_max(F.filter("turns", lambda t: t < F.col("turn")))
    return calls, placed.select("conv_id", F.lit("turn").alias("space"), "turn", F.coalesce(own, F.col("carried")).cast("string").alias("call_id"), "content").where("call_id is not null")


def levels(calls: DataFrame) -> DataFrame:
    """calls with level: 0 without references, else one more than the highest reference's; null where there is none."""
    one = ["conv_id", "space", "call_id"]
    free = calls.where(F.size("refs") == 0).withColumn("level", F.lit(0))
    bound = checkpoint(calls.where(F.size("refs") > 0))
    if bound.isEmpty():
        return free
    edges = bound.where("call_id is not null").select(*one, F.explode("refs").alias("ref"), F.size("refs").alias("n")).distinct()
    settled = checkpoint(free.where("call_id is not null").groupBy(*one).agg(F.max("level").alias("level")).join(edges.select(*one), one, "left_anti"))
    left = checkpoint(edges)
    while True:
        known = settled.select("conv_id", "space", F.col("call_id").alias("ref"), "level")
        now = left.join(known, ["conv_id", "space", "ref"]).groupBy(*one).agg(F.max("level").alias("top"), F.count(F.lit(1)).alias("have"), F.max("n").alias("n"))
        new = checkpoint(now.where("have = n").select(*one, (F.col("top") + 1).alias("level")))
        if new.isEmpty():
            break
        settled = checkpoint(settled.unionByName(new))
        left = checkpoint(left.join(new, one, "left_anti"))
    return free.unionByName(bound.join(settled, one, "left").select(*free.columns))


def _fits(kind: Column, shape: Column) -> Column:
    number = shape.rlike(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return (
        F.when(kind == "string", shape == "STRING").when(kind == "number", number).when(kind == "integer", shape == "BIGINT").when(kind == "boolean", shape == "BOOLEAN")
        .when(kind == "object", shape.startswith("OBJECT")).when(kind == "array", shape.startswith("ARRAY")).otherwise(F.lit(False))
    )


def validate(calls: DataFrame, fields: DataFrame) -> DataFrame:
    """calls with valid; fields: name, field, kind, required, minimum."""
    tools = fields.groupBy("name").agg(F.collect_list(F.struct("field", "kind", "required", "minimum")).alias("_fields"))
    parsed = calls.withColumn("_v", F.try_parse_json("arguments")).withColumn("_m", F.from_json("arguments", "map<string,variant>"))
    joined = parsed.join(tools, "name", "left")

    def good(f: Column) -> Column:
        value = F.try_element_at(F.col("_m"), f["field"])
        low = F.coalesce(F.try_variant_get(value, "$", "double") < f["minimum"], F.lit(False))
        return F.when(value.isNull(), ~f["required"]).otherwise(_fits(f["kind"], F.schema_of_variant(value)) & ~low)

    objects = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    return joined.withColumn("valid", objects & F.coalesce(F.forall("_fields", good), F.lit(False))).drop("_fields", "_v", "_m")


def link(calls: DataFrame, results: DataFrame, fields: DataFrame) -> DataFrame:
    """conv_id, call_id, level, turn, place, result_turn, valid and json (canonical: call and result) for each linked result."""
    ready = validate(levels(calls), fields)
    answers = results.select("conv_id", "space", "call_id", F.col("turn").alias("result_turn"), "content")
    joined = ready.join(answers.hint("shuffle_hash"), ["conv_id", "space", "call_id"], "left")
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.lit("null"))
    quoted = lambda c: F.when(F.col(c).isNull(), F.lit("null")).otherwise(F.expr(f"substring(to_json(named_struct('x', {c})), 6, length(to_json(named_struct('x', {c}))) - 6)"))
    json = F.concat(F.lit('{"call":{"arguments":'), canonical, F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit('},"result":'), quoted("content"), F.lit("}"))
    return joined.select("conv_id", "call_id", "level", "turn", "place", "result_turn", "valid", json.alias("json"))


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    calls, results = exchanges(messages)
    calls = calls.unionByName(embedded_calls(messages))
    results = results.unionByName(embedded_results(messages))
    linked = link(calls, results, spark.createDataFrame(list(EXCHANGE_FIELDS), _FIELDS_SQL))
    return linked.withColumn("result_turn", F.coalesce("result_turn", F.lit(-1).cast("long")))  # -1: no result


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
calls AS (
  SELECT conv_id, turn, CAST(turn AS VARCHAR) AS call_id, role, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, text, min(turn) OVER (PARTITION BY conv_id) AS opening
  FROM c WHERE role <> 'assistant'
),
results AS (
  SELECT a.conv_id, a.turn AS result_turn, any_value(a.text) AS content, max(b.turn) AS turn
  FROM c a JOIN c b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.role <> 'assistant'
  WHERE a.role = 'assistant' GROUP BY a.conv_id, a.turn
)
SELECT conv_id, call_id, CAST(CASE WHEN calls.turn > opening THEN 1 ELSE 0 END AS INTEGER) AS level, calls.turn, CAST(0 AS INTEGER) AS place, coalesce(result_turn, -1) AS result_turn, words >= 1 AS valid,
  '{"call":{"arguments":{' || CASE WHEN calls.turn > opening THEN '"after":"$' || opening || '",' ELSE '' END || '"text":' || CAST(to_json(text) AS VARCHAR) || ',"words":' || words || '},"id":"' || call_id || '","name":"' || role || '"},"result":' ||
  coalesce(CAST(to_json(content) AS VARCHAR), 'null') || '}' AS json
FROM calls LEFT JOIN results USING (conv_id, turn)
"""

QUERIES = {"op10_tool_calls": op10_tool_calls}
ORACLES = {"op10_tool_calls": ORACLE}
