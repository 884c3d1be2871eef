"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import stage

BODY = (
    "content string, tool_call_id string, "
    "tool_calls array<struct<id: string, name: string, arguments: string>>"
)
REFERENCE = r'"\$ref"\s*:\s*"([^"\\]+)"'

# Production schemas: (tool, parameter, JSON type, required). A parameter of the query, not of the operator.
TOOLS = (
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("fetch", "url", "string", True),
    ("calculate", "expression", "string", True),
)


def schema_table(spark: SparkSession, tools: tuple = TOOLS) -> DataFrame:
    return spark.createDataFrame(list(tools), "name string, parameter string, type string, required boolean")


def canonical(json: Column) -> Column:
    """JSON text with the keys of all objects sorted and no white space; null where it isn't JSON or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _type_of(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean").when(kind == "BIGINT", "integer").when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), "number")
        .otherwise("null")
    )


def messages_of(table: DataFrame) -> DataFrame:
    """(row, conv_id, turn, role, content, tool_call_id, tool_calls) of every row: a text that is a JSON object is read as a body."""
    text = F.col("text").cast("string")
    read = table.select(
        F.monotonically_increasing_id().alias("row"), F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"),
        F.coalesce(text, F.lit("")).alias("text"), F.when(F.ltrim(text).startswith("{"), F.from_json(text, BODY)).alias("body"),
    )
    is_body = F.coalesce("body.content", "body.tool_call_id", F.to_json("body.tool_calls")).isNotNull()
    return read.select(
        "row", "conv_id", "turn", "role",
        F.when(is_body, F.coalesce("body.content", F.lit(""))).otherwise(F.col("text")).alias("content"),
        "body.tool_call_id", "body.tool_calls",
    )


def checked_calls(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """`calls` (row, at, id, name, arguments) with errors: distinct, sorted, comma-joined, '' for none."""
    parsed = calls.withColumn("object", F.try_parse_json("arguments")).withColumn(
        "is_object", F.coalesce(_type_of(F.col("object")) == "object", F.lit(False))
    )
    entries = parsed.where("is_object").select("row", "at", "name", F.explode(F.from_json("arguments", "map<string, variant>")).alias("parameter", "value"))
    entries = entries.select("row", "at", "name", "parameter", _type_of(F.col("value")).alias("given"))
    tools = schemas.select("name").distinct()
    typed = entries.join(tools, "name", "left_semi").join(schemas.select("name", "parameter", "type"), ["name", "parameter"], "left")
    fits = (F.col("given") == F.col("type")) | ((F.col("given") == "integer") & (F.col("type") == "number"))
    wrong = typed.select("row", "at", F.when(F.col("type").isNull(), F.concat(F.lit("unknown:"), "parameter")).when(~fits, F.concat(F.lit("type:"), "parameter")).alias("error"))
    needed = parsed.where("is_object").select("row", "at", "name").join(schemas.where("required").select("name", "parameter"), "name")
    missing = needed.join(entries.select("row", "at", "parameter"), ["row", "at", "parameter"], "left_anti").select("row", "at", F.concat(F.lit("missing:"), "parameter").alias("error"))
    untold = calls.join(tools, "name", "left_anti").select("row", "at", F.lit("tool").alias("error"))
    broken = parsed.where("not is_object").select("row", "at", F.lit("arguments").alias("error"))
    errors = wrong.unionByName(missing).unionByName(untold).unionByName(broken).where("error is not null")
    errors = errors.groupBy("row", "at").agg(F.array_join(F.array_sort(F.collect_set("error")), ",").alias("errors"))
    return calls.join(errors, ["row", "at"], "left").withColumn("errors", F.coalesce("errors", F.lit("")))


def topological(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(row, place, step, cyclic) of the messages that an edge touches: an order that respects the edges, nearest to the turns.

    nodes: row, conv_id, turn. edges: before, after (rows). A message stands at its turn, or right after what
    it depends on where that is later. Places are raised along the edges until nothing changes; a message that
    is raised more often than its conversation has touched messages is on a cycle, and stays at its turn.
    """
    touched = edges.select(F.explode(F.array("before", "after")).alias("row")).distinct()
    nodes = nodes.join(touched, "row")
    most = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("most"))
    state = stage(
        nodes.join(most, nodes["conv_id"].eqNullSafe(most["conv_id"])).select("row", F.col("turn").alias("place"), F.lit(0).cast("bigint").alias("step"), "most"),
        "order",
    )
    edges = stage(edges.distinct(), "edges")
    while not edges.isEmpty():
        after = (
            edges.join(state.select(F.col("row").alias("before"), "place", "step"), "before")
            .groupBy("after").agg(F.max(F.struct("place", (F.col("step") + 1).alias("step"))).alias("least"))
        )
        raised = state.join(after, F.col("row") == F.col("after"), "left")
        up = (F.col("step") <= F.col("most")) & F.col("least").isNotNull() & (F.col("least") > F.struct("place", "step"))
        raised = stage(
            raised.select(
                "row", F.when(up, F.col("least.place")).otherwise(F.col("place")).alias("place"),
                F.when(up, F.col("least.step")).otherwise(F.col("step")).alias("step"), "most", F.coalesce(up, F.lit(False)).alias("up"),
            ),
            "order",
        )
        state = raised.drop("up")
        if raised.where("up").isEmpty():
            break
    return state.select("row", "place", "step", (F.col("step") > F.col("most")).alias("cyclic"))


def format_chats(table: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each row of table (conv_id, turn, role, text), in the order of conv_id, place, step, turn.

    Columns: conv_id, turn, role, place, step, n_calls, n_linked, n_invalid, cyclic, message.

    An assistant's text may be a JSON object with `tool_calls` (id, name, arguments as an object or as text),
    a tool's one with `tool_call_id`; both with `content`. Any other text is content as it is. A result is
    linked to the first call of its conversation with its identifier; calls that repeat an identifier are
    kept with the error `repeated`, calls without a result have `result` false, results without a call have
    `linked` false. Arguments are checked against `schemas` (name, parameter, type, required; JSON types):
    errors are `tool` (unknown), `arguments` (no object, or a repeated key), `missing:`, `type:` and
    `unknown:` with a parameter. A result comes after its call, a call after the results that its arguments
    name as {"$ref": id}; where turns say otherwise, place and step move it. `message` is canonical JSON.

    No conversation is ever brought together: places are order columns, so one may hold any number of
    messages. Null conv_ids are one conversation, but have no links, as null identifiers have none. Null
    turns sort first. Null and empty texts are empty content. Repeated rows are messages each. Other columns of table are
    not read. No rows in, no rows out.
    """
    messages = stage(messages_of(table), "messages")
    calls = messages.where("role = 'assistant' and size(tool_calls) > 0").select(
        "row", "conv_id", "turn", F.posexplode("tool_calls").alias("at", "call")
    ).select("row", "conv_id", "turn", "at", "call.id", "call.name", "call.arguments")
    results = messages.where("role = 'tool' and tool_call_id is not null").select("row", "conv_id", "turn", F.col("tool_call_id").alias("id"))
    first = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "at")).alias("call"))
    answered = results.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row")).alias("result"))
    links = stage(results.join(first, ["conv_id", "id"]).select("row", F.col("call.row").alias("call_row")), "links")
    references = calls.select("row", "conv_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(REFERENCE), 1))).alias("id"))
    edges = links.select(F.col("call_row").alias("before"), F.col("row").alias("after")).unionByName(
        references.join(answered, ["conv_id", "id"]).select(F.col("result.row").alias("before"), F.col("row").alias("after"))
    )
    order = topological(messages.select("row", "conv_id", "turn"), edges)
    checked = checked_calls(calls, schemas).join(first, ["conv_id", "id"], "left").join(answered, ["conv_id", "id"], "left")
    repeated = F.col("call").isNotNull() & ~((F.col("call.row") == F.col("row")) & (F.col("call.at") == F.col("at")))
    errors = F.concat_ws(",", F.when(repeated, F.lit("repeated")), F.when(F.col("errors") != "", F.col("errors")))
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct("arguments")))
    told = checked.select(
        "row", "at", errors.alias("errors"), (F.col("result").isNotNull() & ~F.coalesce(repeated, F.lit(False))).alias("linked"),
        arguments.alias("arguments"), "id", "name",
    )
    # Keys in order: arguments, errors, id, name, result.
    call_json = F.concat(
        F.lit('{"arguments":'), "arguments", F.lit(","),
        F.substring(F.to_json(F.struct("errors", F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.col("linked").alias("result"))), 2, 1 << 30),
    )
    by_message = told.groupBy("row").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", call_json.alias("json")))), lambda x: x["json"]), ",").alias("calls"),
        F.count(F.lit(1)).alias("n_calls"), F.count(F.when(F.col("linked"), 1)).alias("n_linked"), F.count(F.when(F.col("errors") != "", 1)).alias("n_invalid"),
    )
    out = (
        messages.join(by_message, "row", "left").join(links.withColumnRenamed("call_row", "linked_to"), "row", "left").join(order, "row", "left")
    )
    is_result = (F.col("role") == "tool") & F.col("tool_call_id").isNotNull()
    head = F.to_json(F.struct("content", F.when(is_result, F.col("linked_to").isNotNull()).alias("linked"), F.coalesce("role", F.lit("")).alias("role"),
                              F.when(is_result, F.col("tool_call_id")).alias("tool_call_id")))
    message = F.when(F.col("calls").isNull(), head).otherwise(
        F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"tool_calls":['), "calls", F.lit("]}"))
    )
    stays = F.coalesce("cyclic", F.lit(False)) | F.col("place").isNull()
    return out.withColumn("head", head).select(
        "conv_id", "turn", "role", F.when(stays, F.col("turn")).otherwise(F.col("place")).alias("place"),
        F.when(stays, 0).otherwise(F.col("step")).cast("bigint").alias("step"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_calls", "n_linked", "n_invalid")],
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), message.alias("message"),
    )
