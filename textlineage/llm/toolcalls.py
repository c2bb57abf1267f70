"""Chat formatting: calls linked to results, ordered, validated and written as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlineage.llm.common import cut, drop

#: Fields of each known function: name -> {field: (JSON type, required)}. A chat's own turns are calls of "reply".
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {"reply": {"prompt": ("STRING", True)}}

CALLS = "array<struct<id: string, function: struct<name: string, arguments: string>>>"


def canonical(c: Column) -> Column:
    """JSON text with sorted keys and no spaces; NULL if it isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def valid_arguments(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Whether the arguments are an object with every required field, no unknown one, and the right types."""
    keys, v = F.json_object_keys(arguments), F.try_parse_json(arguments)
    out = F.lit(False)
    for f, fields in schemas.items():
        ok = F.size(F.array_except(keys, F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>"))) == 0
        for k, (kind, required) in fields.items():
            found = F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant"))
            right = found.startswith(kind)
            ok = ok & (F.coalesce(right, F.lit(False)) if required else F.coalesce(right, F.lit(True)))
        out = F.when(name == f, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def same(left: DataFrame, right: DataFrame, *pairs: tuple[str, str]) -> Column:
    """Equality of columns, nulls equal to nulls."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & left[a].eqNullSafe(right[b])
    return out


def chains(edges: DataFrame) -> DataFrame:
    """(conv_id, turn, place, level, depth, cyclic) of every message that answers a call, for edges (conv_id, turn, place, up_turn, up_place)
    from it to the message that makes the call.

    Each message has one edge at most, so doubling the edges finds every ancestor in as many rounds as the longest chain has binary digits.
    level is the largest turn of the message and its ancestors, depth their number. Messages whose ancestors form a cycle are
    cyclic: their level is the largest turn of the cycle and the way to it, their depth 1.
    """
    start = cut(edges.select("conv_id", "turn", "place", "up_turn", "up_place", F.greatest("turn", "up_turn").alias("level"), F.lit(1).cast("long").alias("depth")), "call-edges")
    e = start
    for _ in range(2 + int(start.count()).bit_length()):
        up = e.select(*[F.col(c).alias(f"_{c}") for c in e.columns])
        j = e.join(up, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("up_turn").eqNullSafe(F.col("_turn")) & (F.col("up_place") == F.col("_place")), "left")
        found = F.col("_place").isNotNull()
        before, e = e, cut(j.select("conv_id", "turn", "place", F.col("_up_turn").alias("up_turn"), F.col("_up_place").alias("up_place"), F.greatest("level", "_level").alias("level"), F.when(found, F.col("depth") + F.col("_depth")).otherwise(F.col("depth")).alias("depth")), "call-edges")
        drop(before)
        if e.filter("up_place is not null").isEmpty():
            break
    cyclic = F.col("up_place").isNotNull()
    return e.select("conv_id", "turn", "place", "level", F.when(cyclic, F.lit(1).cast("long")).otherwise(F.col("depth")).alias("depth"), cyclic.alias("cyclic"))


def link(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]] = SCHEMAS) -> DataFrame:
    """One row per event of (conv_id, turn, role, text): messages, calls and results, linked and ordered.

    Calls: entries of `tool_calls` in an assistant's or tool's JSON text, and each user turn as a call of "reply" with its
    text as the prompt. Results: a tool's JSON text with `tool_call_id`, and an assistant turn without calls as the result
    of the user turn just before it. Identifiers hold within a conversation. Calls and results meet by a hash join.

    status: of the calls with one identifier the first, by turn, text hash and place in its text, is `answered` or `unanswered`, the others are
    `repeated`; a call without an identifier is `unnamed`. Of the results for a call the first `answers` it, the others are `repeated`; a
    result without a call is an `orphan`. linked: answered or answers. Messages have neither.

    Order: sort by (conv_id, level, depth, turn, step, call_id). A result's level is the largest turn, and its depth the number, of the
    messages that it depends on: that of its call, that of the call which this one answers, and so on; so it stands after its call even
    if its turn doesn't. step 0 is a message or result, 1 a call in it. Results that depend on themselves are `cyclic`: level is the largest turn
    of the cycle and the way to it, depth 1.

    valid: a call's arguments fit its schema; a result has its call's. Null text is "", null role "" and a message. Rows equal in all four columns are
    told apart by nothing and share their flags. Texts of any length are parsed whole; calls don't carry them. Events aren't collected by conversation, so one of any
    length costs no task more than its share. An empty table gives an empty table; other columns are ignored.
    """
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # Only texts that look like objects are parsed.
    object_text = F.when(F.ltrim("text").startswith("{"), F.col("text"))
    m = m.withColumns({"body": F.from_json(object_text, f"struct<tool_calls: {CALLS}, tool_call_id: string, content: string>"), "place": F.md5(F.concat("role", F.lit(":"), "text"))})
    of_tool = (F.col("role") == "tool") & F.col("body.tool_call_id").isNotNull()
    is_tool_call = F.coalesce(F.col("role").isin("assistant", "tool") & F.col("body.tool_calls").isNotNull(), F.lit(False))
    call = lambda i, n, a: F.struct(i.alias("call_id"), n.alias("name"), a.alias("arguments"))
    calls = F.when(F.col("role") == "user", F.array(call(F.concat(F.lit("turn-"), F.col("turn").cast("string")), F.lit("reply"), F.to_json(F.struct(F.col("text").alias("prompt"))))))
    calls = calls.when(is_tool_call, F.transform("body.tool_calls", lambda c: call(c["id"], c["function"]["name"], c["function"]["arguments"])))
    result_of = F.when(of_tool, F.col("body.tool_call_id")).when((F.col("role") == "assistant") & ~is_tool_call, F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")))
    # A message of its own format is written as its content; with fields beyond that format its whole text stays.
    formats = F.when(of_tool & is_tool_call, F.array(F.lit("content"), F.lit("tool_call_id"), F.lit("tool_calls"))).when(of_tool, F.array(F.lit("content"), F.lit("tool_call_id"))).when(is_tool_call, F.array(F.lit("content"), F.lit("tool_calls")))
    content = F.when(F.size(F.array_except(F.json_object_keys("text"), formats)) == 0, F.coalesce(F.col("body.content"), F.col("text"))).otherwise(F.col("text"))
    m = m.select("conv_id", "turn", "role", "place", F.coalesce(calls, F.array().cast("array<struct<call_id: string, name: string, arguments: string>>")).alias("calls"), result_of.alias("call_id"), content.alias("content"))
    made = m.filter("size(calls) > 0").select("conv_id", "turn", "role", "place", F.col("call_id").alias("answers"), F.posexplode("calls").alias("at", "c")).select("conv_id", "turn", "role", "place", "answers", "at", "c.*")
    made = made.withColumn("valid", valid_arguments(F.col("name"), F.col("arguments"), schemas))
    results = m.filter("call_id is not null")
    # By identifier: the first call and the first result.
    call_type, result_type = "struct<turn: bigint, place: string, at: int, name: string, valid: boolean>", "struct<turn: bigint, place: string>"
    ends = made.filter("call_id is not null").select("conv_id", "call_id", F.struct("turn", "place", "at", "name", "valid").cast(call_type).alias("c"), F.lit(None).cast(result_type).alias("r"))
    ends = ends.unionByName(results.select("conv_id", "call_id", F.lit(None).cast(call_type).alias("c"), F.struct("turn", "place").cast(result_type).alias("r")))
    ids = ends.groupBy("conv_id", "call_id").agg(F.min("c").alias("c"), F.min("r").alias("r")).select(F.col("conv_id").alias("i_conv"), F.col("call_id").alias("i_call"), "c", "r")
    by_id = lambda rows: rows.join(ids.hint("shuffle_hash"), rows.conv_id.eqNullSafe(ids.i_conv) & (rows.call_id == ids.i_call), "left").drop("i_conv", "i_call")
    results = by_id(results.select("conv_id", "turn", "role", "place", "call_id", "content", (F.size("calls") > 0).alias("holds")))
    results = results.withColumns({"level": F.greatest("turn", "c.turn"), "depth": F.col("c").isNotNull().cast("long"), "cyclic": F.lit(False)})
    made = by_id(made).withColumns({"level": F.col("turn"), "depth": F.lit(0).cast("long")})
    if not m.filter("call_id is not null and size(calls) > 0").isEmpty():  # results with calls of their own: chains of any length
        edges = results.filter("c is not null").select("conv_id", "turn", "place", F.col("c.turn").alias("up_turn"), F.col("c.place").alias("up_place")).distinct()
        deep = chains(edges).select(*[F.col(c).alias(f"d_{c}") for c in ("conv_id", "turn", "place", "level", "depth", "cyclic")])
        placed = lambda rows: rows.join(deep, same(rows, deep, ("conv_id", "d_conv_id"), ("turn", "d_turn"), ("place", "d_place")), "left")
        at = {"level": F.coalesce("d_level", "level"), "depth": F.coalesce("d_depth", "depth")}
        results = placed(results).withColumns(at | {"cyclic": F.coalesce("d_cyclic", F.lit(False))})
        made = placed(made).withColumns(at)
    none = F.lit(None).cast("string")
    columns = lambda step, kind, name, linked, valid, status, body: [F.col("level"), F.col("depth"), F.col("turn"), F.lit(step).alias("step"), F.lit(kind).alias("kind"), F.col("call_id"), name.alias("name"), linked.alias("linked"), valid.alias("valid"), status.alias("status"), F.to_json(F.struct(*body)).alias("json")]
    # Keys in sorted order; absent fields are left out.
    plain = m.filter("call_id is null").withColumns({"level": F.col("turn"), "depth": F.lit(0).cast("long")})
    out = plain.select("conv_id", *columns(0, "message", none, F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), none, ["content", "role"]))
    first = F.col("r.turn").eqNullSafe(F.col("turn")) & (F.col("r.place") == F.col("place"))
    status = F.when(F.col("c").isNull(), "orphan").when(F.col("cyclic"), "cyclic").when(first, "answers").otherwise("repeated")
    out = out.unionByName(results.select("conv_id", *columns(0, "result", F.col("c.name"), status == "answers", F.col("c.valid"), status, ["content", F.col("call_id").alias("id"), "role"])))
    first = F.col("c.turn").eqNullSafe(F.col("turn")) & (F.col("c.place") == F.col("place")) & (F.col("c.at") == F.col("at"))
    status = F.when(F.col("call_id").isNull(), "unnamed").when(~first, "repeated").when(F.col("r").isNotNull(), "answered").otherwise("unanswered")
    # A user turn's prompt isn't written again: its message has it.
    arguments = F.when(F.col("role") != "user", F.coalesce(canonical(F.col("arguments")), F.col("arguments")))
    return out.unionByName(made.select("conv_id", *columns(1, "call", F.col("name"), status == "answered", F.col("valid"), status, [arguments.alias("arguments"), F.col("call_id").alias("id"), F.col("name")])))
