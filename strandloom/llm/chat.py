"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

A message whose text is a JSON object with an array `tool_calls` of {"id", "name", "arguments", "after"} makes calls; a
message of role `tool` whose text is {"tool_call_id", "content"} answers one. Calls and results meet in a hash join on
conversation and identifier. The order is topological: a result comes after its call, and a call after the results of
those it names in `after`; a message's depth is the longest chain before it. Arguments are validated against schemas.
Canonical JSON has sorted keys, no white space and one form for each number. Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm import common

#: What schema_of_variant says of the types that schemas name.
TYPES = {"string": r"^STRING$", "integer": r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\(\d+,0\))$", "number": r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\(.*\))$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT<", "array": r"^ARRAY<"}


def valid(name: F.Column, arguments: F.Column, schemas: dict[str, dict[str, str]]) -> F.Column:
    """Whether arguments (a variant) are an object with every argument of the named schema, each of its type; a name ending in ? may be left out. Unknown names and text that is no JSON are not valid."""
    known = F.lit(False)
    for tool, fields in schemas.items():
        good = F.coalesce(F.schema_of_variant(arguments).startswith("OBJECT<"), F.lit(False))
        for field, kind in fields.items():
            found = F.schema_of_variant(F.try_variant_get(arguments, f"$.{field.rstrip('?')}", "variant"))
            good = good & F.coalesce(found.rlike(TYPES[kind]), F.lit(field.endswith("?")))
        known = F.when(name == tool, good).otherwise(known)
    return known


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, id, depth): the longest chain of calls before each call; null on a cycle or behind one.

    Each round takes the calls all of whose needs were met in the rounds before; what is done is not written again.
    """
    needs = calls.select("conv_id", "id", F.explode("after").alias("need")).distinct()
    nodes = calls.select("conv_id", "id").distinct()
    needs = common.stored(needs.join(nodes.withColumnRenamed("id", "need"), ["conv_id", "need"], "left_semi"), "needs")
    if needs.isEmpty():
        return nodes.withColumn("depth", F.lit(0))
    open_ = common.stored(needs.groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("left"), F.lit(0).alias("depth")), "open")
    ready = common.stored(nodes.join(open_, ["conv_id", "id"], "left_anti").withColumn("depth", F.lit(0)), "ready")
    done = ready
    while not ready.isEmpty():
        met = needs.join(ready.withColumnRenamed("id", "need"), ["conv_id", "need"]).groupBy("conv_id", "id").agg(F.count(F.lit(1)).alias("n"), (F.max("depth") + 1).alias("d"))
        now = open_.join(met, ["conv_id", "id"], "left")
        now = common.stored(now.select("conv_id", "id", (F.col("left") - F.coalesce("n", F.lit(0))).alias("left"), F.greatest("depth", "d").alias("depth")), "open")
        ready, before, open_ = common.stored(now.filter("left = 0").select("conv_id", "id", "depth"), "ready"), open_, common.stored(now.filter("left > 0"), "open")
        common.forget(before, now)
        done = done.unionByName(ready)
    return done.unionByName(open_.select("conv_id", "id", F.lit(None).cast("int").alias("depth")))


def json(value: F.Column) -> F.Column:
    """A variant as canonical JSON: sorted keys, no white space. A number has digits without an exponent, and none after the point that are zeros at the end, if it lies between 1e-18 and 1e38."""
    text = F.to_json(value)
    token = r"""("(?:[^"\\]++|\\.)*+"|-?[0-9][0-9.eE+-]*+|[^"0-9-]++)"""
    size = lambda t: F.abs(t.cast("double"))
    plain = lambda t: F.regexp_replace(F.regexp_replace(t.cast("double").cast("decimal(38,18)").cast("string"), "0+$", ""), r"\.$", "")
    number = lambda t: F.when(size(t) == 0, F.lit("0")).when((size(t) >= 1e-18) & (size(t) < 1e19), plain(t)).when(size(t) < 1e38, t.cast("double").cast("decimal(38,0)").cast("string")).otherwise(t)
    tokens = F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(1)), lambda t: F.when(t.rlike(r"^-?[0-9]+(\.0$|\.?[0-9]*E)"), number(t)).otherwise(t))
    return F.when(text.rlike(r"[0-9]\.0[,}\]]|[0-9]\.0$|[0-9]E"), F.array_join(tokens, "")).otherwise(text)


def format_chats(messages: DataFrame, schemas: dict[str, dict[str, str]]) -> DataFrame:
    """One row per row of messages (conv_id, turn, role, text): conv_id, turn, role, call_ids, depth, follows, linked, valid, line.

    (follows, depth, turn) orders a conversation topologically: follows is the turn of the call that a result answers, else the
    message's own; depth is null on a cycle of calls. linked says of a result that its call exists, of calls that all are
    answered, and is null for other messages. valid says that all arguments (of a result: its call's) fit their schema.
    line is canonical JSON of all fields of a message with its role; calls are sorted by identifier. Arguments that are a string of
    JSON become that JSON; other strings stay as they are and are not valid. Null texts give a null content; a text that is no
    such JSON, or repeats a key, is plain content. A null role calls like any but `tool`. Of calls that repeat an identifier the
    first turn counts; repeated rows give repeated results; an empty table gives an empty result. Other columns of messages are not read.
    """
    asks = ~F.coalesce(F.col("role") == "tool", F.lit(False))
    value = F.when(F.ltrim("text").startswith("{"), F.try_parse_json("text"))
    rows = messages.select("conv_id", "turn", "role", "text", value.alias("value")).select(
        "conv_id", "turn", "role", "text",
        F.when(asks, F.try_variant_get("value", "$.tool_calls", "array<variant>")).alias("made"),
        F.when(~asks, F.try_variant_get("value", "$.tool_call_id", "string")).alias("answers"),
        F.try_variant_get("value", "$", "map<string,variant>").alias("fields"),
        F.monotonically_increasing_id().alias("row"),
    )
    given = lambda c: F.try_variant_get(c, "$.arguments", "variant")
    arguments = lambda c: F.coalesce(F.try_parse_json(F.when(F.schema_of_variant(given(c)) == "STRING", F.try_variant_get(c, "$.arguments", "string"))), given(c))
    one = lambda c: F.struct(
        F.try_variant_get(c, "$.id", "string").alias("id"),
        F.try_variant_get(c, "$.name", "string").alias("name"),
        arguments(c).alias("value"),
        F.try_variant_get(c, "$.after", "array<string>").alias("after"),
        F.try_variant_get(c, "$", "map<string,variant>").alias("fields"),
    )
    rows = rows.withColumn("made", F.transform("made", one))
    calls = rows.filter("made IS NOT NULL").select("row", "conv_id", "turn", F.explode("made").alias("call")).select("row", "conv_id", "turn", "call.id", "call.after", valid(F.col("call.name"), F.col("call.value"), schemas).alias("fits"))
    others = lambda m, *names: F.map_filter(m, lambda k, _: ~k.isin(*names))
    whole = lambda c: F.to_json(F.when(c["value"].isNull(), F.to_variant_object(c["fields"])).otherwise(F.to_variant_object(F.map_concat(others(c["fields"], "arguments"), F.create_map(F.lit("arguments"), c["value"])))))
    ordered = F.sort_array(F.transform("made", lambda c: F.struct(c["id"].isNotNull().alias("named"), c["id"].alias("id"), F.coalesce(whole(c), F.lit("null")).alias("json"))))
    null = F.parse_json(F.lit("null"))
    own = F.create_map(F.lit("role"), F.parse_json(json_string(F.col("role"))), F.lit("content"), F.coalesce(F.col("fields")["content"], null))
    own = F.map_concat(others(F.col("fields"), "role", "content", "tool_calls"), own)
    made = F.create_map(F.lit("tool_calls"), F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda c: c["json"]), ","), F.lit("]"))))
    plain = F.concat(F.lit('{"content":'), json_string(F.col("text")), F.lit(',"role":'), json_string(F.col("role")), F.lit("}"))
    lines = rows.select(
        "row", "conv_id", "turn", "role", "answers", F.col("made").isNotNull().alias("asks"),
        F.when(F.col("made").isNotNull(), F.transform(ordered, lambda c: c["id"])).when(F.col("answers").isNotNull(), F.array("answers")).alias("call_ids"),
        F.when(F.col("made").isNotNull(), json(F.to_variant_object(F.map_concat(own, made)))).when(F.col("answers").isNotNull(), json(F.to_variant_object(own))).otherwise(plain).alias("line"),
    )
    rows, calls = common.stored(lines, "messages"), common.stored(calls, "calls")
    first = calls.filter("id IS NOT NULL").groupBy("conv_id", "id").agg(F.min(F.struct("turn", "row", "fits")).alias("first")).select("conv_id", "id", F.col("first.turn").alias("call_turn"), "first.fits")
    first = common.stored(first.join(depths(calls.filter("id IS NOT NULL")), ["conv_id", "id"]), "first")  # one row for each identifier: the side that is hashed
    answers = rows.filter("answers IS NOT NULL").select("row", "conv_id", F.col("answers").alias("id"))
    linked = answers.join(first.hint("shuffle_hash"), ["conv_id", "id"]).select("row", F.col("call_turn").alias("follows"), (F.col("depth") * 2 + 1).alias("d2"), "fits")
    answered = answers.select("conv_id", "id").distinct().withColumn("answered", F.lit(True))
    asked = calls.join(first.select("conv_id", "id", "depth").hint("shuffle_hash"), ["conv_id", "id"], "left").join(answered.hint("shuffle_hash"), ["conv_id", "id"], "left")
    asked = asked.groupBy("row").agg(F.max("depth").alias("d1"), F.bool_or(F.col("depth").isNull() & F.col("id").isNotNull()).alias("cyclic"), F.bool_and(F.coalesce("answered", F.lit(False))).alias("l1"), F.bool_and("fits").alias("v1"))
    joined = rows.join(asked, "row", "left").join(linked, "row", "left")
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "call_ids",
        F.when(F.col("asks"), F.when(F.coalesce("cyclic", F.lit(False)), None).otherwise(F.coalesce("d1", F.lit(0)) * 2)).when(F.col("follows").isNotNull(), F.col("d2")).otherwise(F.lit(0)).alias("depth"),
        F.coalesce("follows", "turn").alias("follows"),
        F.when(F.col("answers").isNotNull(), F.col("follows").isNotNull()).otherwise(F.col("l1")).alias("linked"),
        F.coalesce("v1", "fits").alias("valid"),
        "line",
    )


def json_string(c: F.Column) -> F.Column:
    """A string as JSON; null as null."""
    whole = F.to_json(F.struct(c.alias("x")))
    return F.when(c.isNull(), F.lit("null")).otherwise(whole.substr(F.lit(6), F.length(whole) - 6))


#: The tool that the driver's conversations call: a prompt asks for a reply of the turn after it.
SCHEMAS = {"reply": {"turn": "integer", "n_chars": "integer", "topic?": "string"}}


def as_calls(conversations: DataFrame) -> DataFrame:
    """The driver's conversations, which hold no tool calls, as messages that do.

    A user's or system's turn calls `reply`, an assistant's turn is the result of the call one turn before it. Tasks are
    eight turns long: within one, a call names the call two turns before it in `after`. A call whose text has a multiple of 7
    characters has arguments that aren't JSON, one of a multiple of 5 a turn that is a string; a result whose text has a multiple of
    9 characters names a call that never was, so that its call stays without an answer.
    """
    turn, n = F.col("turn").cast("string"), F.length(F.coalesce("text", F.lit("")))
    id_ = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    fields = lambda t: F.concat(F.lit('{"turn": '), t, F.lit(', "n_chars": '), n.cast("string"), F.lit("}"))
    arguments = F.when(n % 7 == 0, json_string(F.concat(F.lit("turn="), turn))).when(n % 5 == 0, fields(F.concat(F.lit('"'), turn, F.lit('"')))).otherwise(fields(turn))
    after = F.when(F.col("turn") % 8 >= 2, F.concat(F.lit(',"after":['), json_string(id_(F.col("turn") - 2)), F.lit("]"))).otherwise(F.lit(""))
    asks = F.concat(
        F.lit('{"content":'), json_string(F.col("text")), F.lit(',"tool_calls":[{"name":"reply","id":'), json_string(id_(F.col("turn"))), F.lit(',"arguments":'), F.coalesce(arguments, F.lit("null")), F.coalesce(after, F.lit("")), F.lit("}]}")
    )
    gives = F.concat(F.lit('{"tool_call_id":'), json_string(F.concat(F.when(n % 9 == 0, F.lit("lost:")).otherwise(F.lit("")), id_(F.col("turn") - 1))), F.lit(',"content":'), json_string(F.col("text")), F.lit("}"))
    answers = F.col("role").eqNullSafe("assistant")
    return conversations.select("conv_id", "turn", F.when(answers, F.lit("tool")).otherwise(F.col("role")).alias("role"), F.when(answers, gives).otherwise(asks).alias("text"))
