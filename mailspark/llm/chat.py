"""Chat formatting with linked tool calls.

An assistant message may be a JSON object with ``tool_calls`` (each with id, name and
arguments) and ``content``; a message of role ``tool`` is a JSON object with
``tool_call_id`` and ``content``. Calls and results of a conversation are joined by
identifier. Messages are then put in an order in which every result follows its
call: by turn, with a result that came too early moved behind the call, results of
one message in the order of its calls. Arguments are checked against the schema of
their tool, and every message is written as canonical JSON: sorted keys, no spaces.

The result is a row per message with its place, not a document per conversation, so
a conversation of any length is spread over tasks. Only built-in functions are used.

Cases: a message that is not such JSON is plain content, whatever its role. The first
call with an identifier counts, and its first result; later ones are ``repeated``.
A result without a call is an ``orphan`` and stays at its turn. A call whose arguments
are no JSON object, or whose tool is unknown, is not valid. Null roles and texts stay
null in the JSON; rows without conv_id make up one conversation; a null turn comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailspark.operators.skew import running_sums
from mailspark.session import stored

# Per tool its arguments: name to (kind, required).
Schemas = dict[str, dict[str, tuple[str, bool]]]

_CALLS = "content string, tool_calls array<struct<id: string, name: string, arguments: string>>"
_RESULT = "tool_call_id string, content string"
# Kinds as the types that a parsed value may have.
_KINDS = {
    "string": "^STRING$", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN$",
    "object": "^OBJECT.*", "array": "^ARRAY.*",
}
HEAVY_ROWS = 1_000_000
SMALL_KEYS = 20_000


def json_string(text: Column) -> Column:
    """A string, or null, as JSON."""
    listed = F.to_json(F.array(text.cast("string")))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and without spaces; null if it is not JSON."""
    return F.to_json(F.try_parse_json(arguments))


def argument_errors(name: Column, arguments: Column, tools: Schemas) -> Column:
    """What is wrong with a call, as an array of short messages."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    found = F.array(F.lit("unknown tool"))
    for tool, schema in tools.items():
        problems = []
        for key, (kind, required) in schema.items():
            value = F.try_variant_get(parsed, f"$['{key}']", "variant")
            missing = ~F.array_contains(keys, key)
            wrong = ~F.coalesce(F.schema_of_variant(value).rlike(_KINDS[kind]), F.lit(False))
            problem = F.when(missing, F.lit(f"missing {key}") if required else F.lit(None)).when(wrong, F.lit(f"{key} is no {kind}"))
            problems.append(problem)
        unknown = F.transform(F.array_except(keys, F.array(*[F.lit(k) for k in schema]).cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        listed = F.concat(F.array_compact(F.array(*problems).cast("array<string>")), unknown)
        found = F.when(name == tool, listed).otherwise(found)
    return F.when(~is_object, F.array(F.lit("arguments are no object"))).otherwise(found)


def format_chat(messages: DataFrame, tools: Schemas) -> DataFrame:
    """``conv_id, seq, turn, role, status, valid, errors, json`` of every message.

    ``status`` of a message with calls is ``answered`` or ``open``, of a result
    ``linked``, ``repeated`` or ``orphan``, of any other message ``plain``.
    """
    a, r = F.from_json(F.when(F.col("role") == "assistant", F.col("text")), _CALLS), F.from_json(F.when(F.col("role") == "tool", F.col("text")), _RESULT)
    parsed = messages.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"),
    ).withColumns({"a": a, "r": r})
    parsed = parsed.select(
        "conv_id", "turn", "role", "text", F.when(F.size("a.tool_calls") > 0, F.col("a")).alias("a"),
        F.col("r.tool_call_id").alias("answers"), F.col("r.content").alias("result"))
    parsed = stored(parsed, "messages")

    made = parsed.where("a IS NOT NULL").select("conv_id", "turn", F.posexplode("a.tool_calls").alias("at", "call"))
    calls = made.select("conv_id", F.col("call.id").alias("call_id"), "turn", "at").where("call_id IS NOT NULL")
    calls = calls.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "at")).alias("call"))
    results = parsed.where("answers IS NOT NULL").groupBy("conv_id", F.col("answers").alias("call_id")).agg(F.min("turn").alias("first_result"))
    linked = calls.hint("shuffle_hash").join(results, _same("conv_id", "call_id", calls, results), "left").select(
        calls["conv_id"].alias("_conv"), calls["call_id"].alias("_call"), "call", "first_result")

    # Messages with calls: whether each of them has its result.
    open_ = linked.select("_conv", F.col("call.turn").alias("_turn"), F.col("first_result").isNull().alias("open"))
    open_ = open_.groupBy("_conv", "_turn").agg(F.max("open").alias("open"))
    callers = parsed.where("a IS NOT NULL").join(
        open_, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")), "left")
    errors = F.flatten(F.transform("a.tool_calls", lambda c: argument_errors(c["name"], c["arguments"], tools)))
    one_call = F.transform("a.tool_calls", lambda c: F.concat(
        F.lit('{"arguments":'), F.coalesce(canonical(c["arguments"]), json_string(c["arguments"])), F.lit(',"id":'), json_string(c["id"]),
        F.lit(',"name":'), json_string(c["name"]), F.lit("}")))
    callers = callers.select(
        "conv_id", "turn", "role", F.col("turn").alias("place"), F.lit(0).alias("kind"), F.lit(0).alias("at"),
        F.when(F.coalesce("open", F.lit(True)), "open").otherwise("answered").alias("status"), errors.alias("errors"),
        F.concat(F.lit('{"content":'), json_string(F.col("a.content")), F.lit(',"role":"assistant","tool_calls":['),
                 F.array_join(one_call, ","), F.lit("]}")).alias("json"))

    none = F.array().cast("array<string>")
    answers = parsed.where("answers IS NOT NULL").join(
        linked, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("answers") == F.col("_call")), "left")
    status = F.when(F.col("call").isNull(), "orphan").when(F.col("turn") > F.col("first_result"), "repeated").otherwise("linked")
    answers = answers.select(
        "conv_id", "turn", "role", F.greatest("turn", F.col("call.turn")).alias("place"), F.lit(1).alias("kind"),
        F.coalesce("call.at", F.lit(0)).alias("at"), status.alias("status"), none.alias("errors"),
        F.concat(F.lit('{"content":'), json_string(F.col("result")), F.lit(',"role":"tool","tool_call_id":'), json_string(F.col("answers")), F.lit("}")).alias("json"))

    plain = parsed.where("a IS NULL AND answers IS NULL").select(
        "conv_id", "turn", "role", F.col("turn").alias("place"), F.lit(0).alias("kind"), F.lit(0).alias("at"), F.lit("plain").alias("status"),
        none.alias("errors"),
        F.concat(F.lit('{"content":'), json_string(F.col("text")), F.lit(',"role":'), json_string(F.col("role")), F.lit("}")).alias("json"))

    rows = stored(plain.unionByName(callers).unionByName(answers), "chat")
    # The key orders messages without their texts; the JSON breaks ties of repeated turns.
    keyed = rows.withColumn("tie", F.xxhash64("json"))
    counted = running_sums(keyed, "conv_id", ["place", "kind", "at", "turn", "tie"], {"seq": F.lit(1).cast("bigint")}, HEAVY_ROWS, SMALL_KEYS)
    return counted.select("conv_id", "seq", "turn", "role", "status", (F.size("errors") == 0).alias("valid"), "errors", "json")


def _same(first: str, second: str, left: DataFrame, right: DataFrame) -> Column:
    return left[first].eqNullSafe(right[first]) & (left[second] == right[second])


# The tools of the derived exchanges below.
TOOLS: Schemas = {
    "reply": {"words": ("integer", True), "draft": ("boolean", False), "to": ("string", True)},
}


def tool_exchanges(conversations: DataFrame) -> DataFrame:
    """Conversations with every assistant turn as a tool call and its result.

    The turn asks the tool ``reply`` for the text, and the tool returns it. So that
    all cases occur: in every third conversation the result stands before the call,
    in every seventh the odd turns have no result, in every eleventh the call leaves
    out who asked, and in every thirteenth the number of words is a string.
    """
    words = F.size(F.split("text", " ", -1)).cast("string")
    shown = F.when(F.col("conv_id") % 13 == 0, F.concat(F.lit('"'), words, F.lit('"'))).otherwise(words)
    who = F.when(F.col("conv_id") % 11 == 0, F.lit("")).otherwise(F.lit(', "to": "user"'))
    arguments = F.concat(F.lit('{"words": '), shown, who, F.lit(', "draft": false}'))
    name = F.concat(F.lit("call_"), F.col("turn").cast("string"))
    turn = F.col("turn") * 4
    call = F.concat(F.lit('{"content": null, "tool_calls": [{"id": "'), name, F.lit('", "name": "reply", "arguments": '), arguments, F.lit("}]}"))
    result = F.concat(F.lit('{"tool_call_id": "'), name, F.lit('", "content": '), json_string(F.col("text")), F.lit("}"))
    asked = F.col("role") == "assistant"
    early = F.when(F.col("conv_id") % 3 == 0, turn - 1).otherwise(turn + 1)
    others = conversations.where(~asked | F.col("role").isNull()).select("conv_id", turn.alias("turn"), "role", "text")
    calls = conversations.where(asked).select("conv_id", turn.alias("turn"), "role", call.alias("text"))
    answered = (F.col("conv_id") % 7 != 0) | (F.col("turn") % 2 == 0)
    results = conversations.where(asked & answered).select("conv_id", early.alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    return others.unionByName(calls).unionByName(results)
