"""Chat formatting: tool calls linked to their results (DataFrame operations only).

Calls and results are hash-joined by identifier, ordered so that a call follows the calls it builds on,
checked against schemas and written as canonical JSON: sorted keys, no spaces. One row per event, never one
per conversation, so that no conversation has to fit in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import discard, with_group, written

#: What schema_of_variant() says of the JSON types that a schema can name.
JSON_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}

CALL = "conv_id long, turn long, call_id string, name string, arguments string, after array<string>"
RESULT = "conv_id long, turn long, call_id string, content string"


def canonical(json: Column) -> Column:
    """JSON text with sorted keys and no spaces; null if it is no JSON."""
    return F.to_json(F.try_parse_json(json))


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether JSON arguments fit the schema of the named tool: {parameter: (JSON type, required)}, no others.

    Unknown tools, and arguments that are no JSON object, do not fit.
    """
    parsed = F.try_parse_json(arguments)
    fits = F.lit(False)
    for tool, parameters in schemas.items():
        ok = F.schema_of_variant(parsed).startswith("OBJECT<")
        keys = F.map_keys(F.from_json(arguments, "map<string,string>"))
        ok = ok & (F.size(F.array_except(keys, F.array(*[F.lit(p) for p in parameters]) if parameters else F.array().cast("array<string>"))) == 0)
        for parameter, (kind, required) in parameters.items():
            found = F.schema_of_variant(F.try_variant_get(parsed, f"$['{parameter}']", "variant"))
            right = found.rlike(JSON_TYPES[kind])
            ok = ok & (F.coalesce(right, F.lit(False)) if required else F.coalesce(right, F.lit(True)))
        fits = F.when(name == tool, ok).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def _firsts(rows: DataFrame, content: Column) -> DataFrame:
    """rows with `first`: whether it is the earliest of its (conversation, identifier); ties by a digest of the content."""
    at = F.struct("turn", F.sha2(content, 256).alias("digest"), F.col("_row"))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "numbered").withColumn("_at", at)
    rows = rows.withColumn("_key", F.concat_ws(" ", F.col("conv_id").cast("string"), "call_id"))
    rows = with_group(rows, "_key", "_row", {"_min": ("min", "_at")})
    return rows.withColumn("first", F.col("_at").eqNullSafe(F.col("_min"))).drop("_at", "_min", "_row")


def _ends(single: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains of calls that build on one call each: (_key, to, dist) of those that lead out of `single` (_key, to, dist).

    Pointers double: each round, a call's pointer moves on to where the call that it points at points. The second
    table has the calls that lead out nowhere, as they are in a circle or lead to one.
    """
    now = written(single, "pointers")
    rounds = max(1, now.count()).bit_length() + 1
    for _ in range(rounds):  # after these, a chain of all calls has been followed to its end
        on = now.select(F.col("_key").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_more"))
        joined = now.join(on.hint("shuffle_hash"), "to", "left")
        after = written(joined.select("_key", F.coalesce("_to", "to").alias("to"), (F.col("dist") + F.coalesce("_more", F.lit(0))).alias("dist"), F.col("_to").isNotNull().alias("moved")), "pointers")
        discard(now)
        now = after.drop("moved")
        now._graphloom_path = after._graphloom_path
        moved = after.filter("moved")
        if moved.isEmpty():
            return now, now.limit(0).select("_key")
    return after.filter("not moved").drop("moved"), moved.select("_key")


def levels(calls: DataFrame) -> DataFrame:
    """(_key, level): 0 for calls that build on none, else one above the highest they build on; -1 in a cycle.

    Calls that lead to a cycle have -1 too. Identifiers in `after` that no call of the conversation has are ignored.
    Chains of calls that build on one call each take rounds with the logarithm of their length; calls that build on
    several are then settled in the order of their own levels.
    """
    nodes = written(calls.select("_key").distinct(), "nodes")
    edges = calls.select("_key", "conv_id", F.explode("after").alias("dep")).select("_key", F.concat_ws(" ", F.col("conv_id").cast("string"), "dep").alias("to")).distinct()
    edges = edges.join(nodes.withColumnRenamed("_key", "to"), "to", "left_semi")
    needs = edges.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to"))
    needs = written(needs, "needs")
    ends, lost = _ends(needs.filter("n = 1").select("_key", "to", F.lit(1).cast("long").alias("dist")))
    # calls with several predecessors, each predecessor replaced by where its chain ends
    several = edges.join(needs.filter("n > 1").select("_key"), "_key", "left_semi")
    jump = ends.select(F.col("_key").alias("to"), F.col("to").alias("_to"), "dist").unionByName(lost.select(F.col("_key").alias("to"), F.lit(None).cast("string").alias("_to"), F.lit(-1).alias("dist")))
    several = several.join(jump, "to", "left").select("_key", F.when(F.col("dist") == -1, F.lit(None)).otherwise(F.coalesce("_to", "to")).alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist"))
    several = written(several, "several")
    settled = written(nodes.join(needs, "_key", "left_anti").withColumn("level", F.lit(0)), "settled")
    while True:  # a round for each level among calls with several predecessors
        open_ = several.join(settled, "_key", "left_anti")
        known = open_.join(settled.select(F.col("_key").alias("to"), "level"), "to", "left")
        ready = known.groupBy("_key").agg(F.count("level").alias("known"), F.count(F.lit(1)).alias("all"), F.max(F.col("level") + F.col("dist")).alias("level"))
        ready = written(ready.filter("known = all").select("_key", "level"), "ready")
        if ready.isEmpty():
            break
        settled = written(settled.unionByName(ready), "settled")
    stuck = several.select("_key").distinct().join(settled, "_key", "left_anti").unionByName(lost.select("_key")).withColumn("level", F.lit(-1))
    settled = settled.unionByName(stuck)
    chained = ends.join(settled.select(F.col("_key").alias("to"), "level"), "to")
    chained = chained.select("_key", F.when(F.col("level") < 0, -1).otherwise(F.col("level") + F.col("dist")).cast("int").alias("level"))
    return settled.select("_key", F.col("level").cast("int").alias("level")).unionByName(chained)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row per call and per result without one: conv_id, turn, call_id, level, valid, status, json.

    calls: CALL columns; results: RESULT columns; others are ignored. The first call of an identifier in a
    conversation gets the first result with it (by turn, ties by SHA-256 of name and arguments, or of the content).
    status: linked, unanswered, cycle, or, for what is left over, repeated call, repeated result, orphan result. Of
    identical rows one is the first, the others are repeated; a null identifier links to nothing. Events of a
    conversation sort by (level, turn). Long texts stay whole; empty tables give no rows.
    """
    made = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("arguments", F.lit("")))
    calls = written(_firsts(calls.select("conv_id", "turn", "call_id", "name", "arguments", "after"), made), "calls")
    results = written(_firsts(results.select("conv_id", "turn", "call_id", "content"), F.coalesce("content", F.lit(""))), "results")
    known = F.col("call_id").isNotNull()
    named = calls.filter(F.col("first") & known)
    firsts = results.filter(F.col("first") & known)
    given = firsts.select("_key", F.col("turn").alias("result_turn"), "content")  # a key once on either side
    joined = named.join(given.hint("shuffle_hash"), "_key", "left").join(written(levels(named), "levels").hint("shuffle_hash"), "_key", "left")
    answered = firsts.join(named.select("_key").hint("shuffle_hash"), "_key", "left_anti")
    status = F.when(F.col("level") < 0, "cycle").when(F.col("content").isNull() & F.col("result_turn").isNull(), "unanswered").otherwise("linked")
    main = joined.select("conv_id", "turn", "call_id", "level", "name", "arguments", "result_turn", "content", status.alias("status"))
    nothing = {"level": F.lit(None).cast("int"), "result_turn": F.lit(None).cast("long")}
    again = calls.filter(~(F.col("first") & known)).select("conv_id", "turn", "call_id", nothing["level"].alias("level"), "name", "arguments", nothing["result_turn"].alias("result_turn"), F.lit(None).cast("string").alias("content"), F.when(known, "repeated call").otherwise("unanswered").alias("status"))
    lone = answered.withColumn("status", F.lit("orphan result")).unionByName(results.filter(~(F.col("first") & known)).withColumn("status", F.when(known, "repeated result").otherwise("orphan result")))
    lone = lone.select("conv_id", "turn", "call_id", nothing["level"].alias("level"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), F.col("turn").alias("result_turn"), "content", "status")
    rows = main.unionByName(again).unionByName(lone)
    valid = F.when(F.col("status").isin("orphan result", "repeated result"), F.lit(None).cast("boolean")).otherwise(valid_arguments(F.col("name"), F.col("arguments"), schemas))
    rows = rows.withColumn("valid", valid)
    return rows.select("conv_id", "turn", "call_id", "level", "valid", "status", event_json().alias("json"))


def event_json() -> Column:
    """Canonical JSON of an event; the keys of the struct stand in sorted order, nulls are left out."""
    arguments = F.coalesce(canonical(F.col("arguments")), F.to_json(F.struct(F.col("arguments").alias("raw"))))
    head = F.to_json(F.struct(F.col("call_id").alias("id"), "name", F.col("content").alias("result"), "status", "valid"))
    return F.when(F.col("arguments").isNull(), head).otherwise(F.concat(F.lit('{"arguments":'), arguments, F.lit(","), F.substring(head, 2, 1 << 30)))


def message_json(role: Column, content: Column) -> Column:
    return F.to_json(F.struct(content.alias("content"), role.alias("role")))


#: The tool that conversation_events() makes of a user's turn. A title is the first line of a text that has several.
ANSWER = {"answer": {"length": ("integer", True), "query": ("string", True), "title": ("string", True)}}


def conversation_events(messages: DataFrame) -> DataFrame:
    """Events of plain conversations (conv_id, turn, role, text), which hold no tool messages of their own.

    Each user's turn is read as a call of the tool `answer`, identified by its place, that builds on the user's turn
    two before, if there is one; its title is what stands before the first line break, and a text of one line has
    none, which the schema does not allow. An assistant's turn is read as the result of the call one turn before.
    All other turns are messages, as are rows whose role is null. A null text counts as empty. Columns: those of
    link_calls(), with status `message` for messages. Other columns, whatever their names, are ignored.
    """
    messages = messages.select("conv_id", "turn", "role", "text")
    text = F.coalesce("text", F.lit(""))
    place = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    title = F.when(F.instr(text, "\n") > 0, F.substring_index(text, "\n", 1))
    arguments = F.to_json(F.struct(F.char_length(text).alias("length"), text.alias("query"), title.alias("title")))
    calls = messages.filter("role = 'user'").select("conv_id", "turn", place(F.col("turn")).alias("call_id"), F.lit("answer").alias("name"), arguments.alias("arguments"), F.array(place(F.col("turn") - 2)).alias("after"))
    results = messages.filter("role = 'assistant'").select("conv_id", "turn", place(F.col("turn") - 1).alias("call_id"), text.alias("content"))
    other = messages.filter("coalesce(role, '') not in ('user', 'assistant')")
    other = other.select("conv_id", "turn", F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("boolean").alias("valid"), F.lit("message").alias("status"), message_json(F.col("role"), text).alias("json"))
    return link_calls(calls, results, ANSWER).unionByName(other)
