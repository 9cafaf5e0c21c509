"""Chat formatting: tool calls are linked to results, ordered and serialised.

A message's text may be JSON: ``{"tool_calls": [{"id", "name", "arguments"}]}``
makes calls, ``{"tool_call_id", "content"}`` is the result of one.  Calls and
results are hash-joined by conversation and identifier; a message that holds a
result is ordered after the message that made the call (all else keeps the order
of turns); arguments are checked against the tool's schema; each message becomes
one line of canonical JSON (keys sorted, no spaces).  Everything is DataFrame
expressions and joins.

The result has a row for each message, so that a conversation of any length is
never gathered in one task; ``level`` and ``turn`` order it.  Defined results:
null texts and roles are empty texts; JSON may follow blanks; malformed JSON is
plain content; a call identifier used twice belongs to the call of the smallest
turn; messages that share a turn go behind the latest call of any of them; results
without a call keep their turn and have ``orphan`` true; messages on a cycle of
calls keep their turn, with ``cyclic`` true; messages without conv_id or turn link
with nothing; repeated rows are returned as often as they stand; other columns
don't matter; very long texts are read whole; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: JSON kinds of an argument by the name of its variant type.
KINDS = {"string": "^STRING", "integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|DECIMAL.*)$", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT"}
_MESSAGE = "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>,tool_call_id:string,content:string>"

#: name -> {argument: (kind, required)}
Schemas = dict[str, dict[str, tuple[str, bool]]]


def arguments_fit(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Whether the arguments (JSON) of a call fit the schema of its tool:
    a known tool, an object, all required arguments, no unknown ones, right kinds."""
    variant = F.try_parse_json(arguments)
    keys = F.json_object_keys(arguments)
    fits = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        own = F.size(F.array_except(keys, F.array(*map(F.lit, sorted(schema))))) == 0 if schema else F.size(keys) == 0
        for key, (kind, required) in sorted(schema.items()):
            found = F.schema_of_variant(F.try_variant_get(variant, f"$['{key}']", "variant"))
            right = F.coalesce(found.rlike(KINDS[kind]), F.lit(not required))
            own = own & F.when(F.array_contains(keys, key), F.coalesce(found.rlike(KINDS[kind]), F.lit(False))).otherwise(right if required else F.lit(True))
        fits = F.when(name == tool, F.coalesce(own, F.lit(False))).otherwise(fits)
    return F.coalesce(fits, F.lit(False))


def parse_messages(messages: DataFrame) -> DataFrame:
    """Messages with ``calls`` (array of id, name, arguments as canonical JSON),
    ``result_of`` (null if none) and ``content``."""
    text = F.coalesce("text", F.lit(""))
    said = F.when(text.rlike(r"^[ \t\r\n]*\{"), F.from_json(text, _MESSAGE))
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"), said.alias("said"))
    calls = F.filter(F.coalesce("said.tool_calls", F.array().cast("array<struct<id:string,name:string,arguments:string>>")), lambda c: c["id"].isNotNull())
    calls = F.transform(
        calls,
        lambda c: F.struct(
            c["id"].alias("id"),
            F.coalesce(c["name"], F.lit("")).alias("name"),
            F.coalesce(F.to_json(F.try_parse_json(F.coalesce(c["arguments"], F.lit("{}")))), F.lit("null")).alias("arguments"),
        ),
    )
    own = F.col("said.tool_calls").isNotNull() | F.col("said.tool_call_id").isNotNull()
    content = F.when(own, F.coalesce("said.content", F.lit(""))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", "role", calls.alias("calls"), F.col("said.tool_call_id").alias("result_of"), content.alias("content"))


def turns_as_calls(messages: DataFrame) -> DataFrame:
    """Parsed messages; those of conversations without tool JSON get calls and
    results that are derived from roles, turns and lengths (n characters).

    A user turn calls ``reply`` with its length under the name ``conv:turn``; with n
    divisible by 5 it uses the name of two turns before again, by 7 it calls the
    unknown ``search``, by 3 the length is a string, by 4 there is a second call with
    an unknown argument.  An assistant's turn is the result of the turn before, with
    n divisible by 11 of the turn after, by 13 of none.  User turns are results too:
    with n divisible by 6 of two turns later, else by 9 of two turns before.
    """
    parsed = parse_messages(messages)
    n, turn = F.length("content"), F.col("turn")
    mark = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    by = lambda k: n % k == 0
    first = F.struct(
        F.when(by(5), mark(turn - 2)).otherwise(mark(turn)).alias("id"),
        F.when(by(7), "search").otherwise("reply").alias("name"),
        F.when(by(3), F.format_string('{"chars":"%d"}', n)).otherwise(F.format_string('{"chars":%d}', n)).alias("arguments"),
    )
    second = F.struct(F.concat(mark(turn), F.lit(":b")).alias("id"), F.lit("reply").alias("name"), F.format_string('{"chars":%d,"extra":1}', n).alias("arguments"))
    plain = (F.size("calls") == 0) & F.col("result_of").isNull()
    asks, tells = plain & (F.col("role") == "user"), plain & (F.col("role") == "assistant")
    told = F.when(by(11), mark(turn + 1)).when(by(13), F.concat(F.lit("none:"), turn.cast("string"))).otherwise(mark(turn - 1))
    return parsed.withColumns(
        {
            "calls": F.when(asks & by(4), F.array(first, second)).when(asks, F.array(first)).otherwise(F.col("calls")),
            "result_of": F.when(tells, told).when(asks & by(6), mark(turn + 2)).when(asks & by(9), mark(turn - 2)).otherwise(F.col("result_of")),
        }
    )


def format_chats(parsed: DataFrame, schemas: Schemas) -> DataFrame:
    """A row for each message: its order, what was linked, and its canonical JSON."""
    made = parsed.select("conv_id", "turn", F.explode("calls").alias("call")).select("conv_id", F.col("call.id").alias("id"), F.col("turn").alias("call_turn"))
    calls = made.groupBy("conv_id", "id").agg(F.min("call_turn").alias("call_turn"))
    results = parsed.where(F.col("result_of").isNotNull()).select("conv_id", F.col("result_of").alias("id")).distinct()
    answered = calls.join(results.hint("shuffle_hash"), ["conv_id", "id"]).groupBy("conv_id", F.col("call_turn").alias("turn")).agg(F.count("*").alias("n_answered"))

    # messages without a result get keys of their own, so that they don't meet in one task
    key = F.coalesce("result_of", F.concat(F.lit("\x00"), F.xxhash64("content", "turn").cast("string")))
    linked = (
        parsed.withColumn("id", key)
        .join(calls.hint("shuffle_hash"), ["conv_id", "id"], "left")
        .drop("id")
        .join(answered.hint("shuffle_hash"), ["conv_id", "turn"], "left")
        .withColumns({"n_answered": F.coalesce("n_answered", F.lit(0)).cast("long"), "level": F.col("turn")})
    )
    levels = _levels(linked.select("conv_id", "turn", "call_turn"))
    if levels is not None:
        linked = linked.drop("level").join(levels.hint("shuffle_hash"), ["conv_id", "turn"], "left").withColumns(
            {"level": F.coalesce("level", "turn"), "cyclic": F.coalesce("cyclic", F.lit(False))}
        )
    else:
        linked = linked.withColumn("cyclic", F.lit(False))
    checked = F.transform("calls", lambda c: F.struct(c["arguments"].alias("arguments"), c["id"].alias("id"), c["name"].alias("name"), arguments_fit(c["name"], c["arguments"], schemas).alias("valid")))
    rows = linked.withColumn("checked", checked)
    # arguments are canonical JSON already: they're spliced in, not quoted
    one = lambda c: F.concat(
        F.lit('{"arguments":'), c["arguments"], F.lit(',"id":'), _quoted(c["id"]), F.lit(',"name":'), _quoted(c["name"]), F.lit(',"valid":'), c["valid"].cast("string"), F.lit("}")
    )
    line = F.concat(
        F.lit('{"calls":['),
        F.array_join(F.transform("checked", one), ","),
        F.lit('],"content":'),
        _quoted(F.col("content")),
        F.lit(',"result_of":'),
        _quoted(F.coalesce("result_of", F.lit(""))),
        F.lit(',"role":'),
        _quoted(F.col("role")),
        F.lit("}"),
    )
    return rows.select(
        "conv_id",
        "turn",
        F.col("level").cast("long").alias("level"),
        "cyclic",
        F.size("calls").cast("long").alias("n_calls"),
        "n_answered",
        F.size(F.filter("checked", lambda c: ~c["valid"])).cast("long").alias("n_invalid"),
        (F.col("result_of").isNotNull() & F.col("call_turn").isNull()).alias("orphan"),
        line.alias("json"),
    )


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    both = F.to_json(F.array(text))
    return F.substring(both, F.lit(2), F.length(both) - 2)


def _levels(links: DataFrame) -> DataFrame | None:
    """(conv_id, turn, level, cyclic) of messages in conversations where a result
    stands before its call; None if there are none.

    A message has one call at most, so calls form trees that may hang on cycles.
    Reaches double each round: after as many rounds as the longest chain has binary
    digits, only messages on or below a cycle have a call that far up, and these
    calls are the cycles.
    """
    arcs = links.where(F.col("call_turn").isNotNull()).groupBy("conv_id", "turn").agg(F.max("call_turn").alias("up"))
    late = arcs.where(F.col("up") >= F.col("turn")).select("conv_id").distinct()
    arcs = cut(arcs.join(late, "conv_id", "left_semi"))
    longest = arcs.groupBy("conv_id").count().agg(F.max("count").alias("n")).first()["n"]
    if longest is None:
        return None
    far = arcs
    for _ in range(longest.bit_length()):
        further = far.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further")).hint("shuffle_hash")
        far = cut(far.join(further, ["conv_id", "up"]).select("conv_id", "turn", F.col("further").alias("up")))
    cycles = cut(far.select("conv_id", F.col("up").alias("turn")).distinct())

    # behind: late arcs on the way up; level: the most that a message on that way asks for, without `up`
    free = arcs.join(cycles, ["conv_id", "turn"], "left_anti")
    way = cut(free.select("conv_id", "turn", "up", (F.col("up") >= F.col("turn")).cast("long").alias("behind"), F.col("turn").cast("long").alias("level")))
    while way.where(F.col("up").isNotNull()).limit(1).count():
        above = way.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("behind").alias("behind2"), F.col("level").alias("level2")).hint("shuffle_hash")
        joined = way.join(above, ["conv_id", "up"], "left")
        # a message above that has no call itself asks for its own turn
        asked = F.coalesce("level2", "up") + F.col("behind")
        way = cut(
            joined.select(
                "conv_id", "turn", F.col("up2").alias("up"), (F.col("behind") + F.coalesce("behind2", F.lit(0))).alias("behind"), F.greatest("level", asked).alias("level")
            )
        )
    return way.select("conv_id", "turn", "level", F.lit(False).alias("cyclic")).unionByName(
        cycles.select("conv_id", "turn", F.col("turn").cast("long").alias("level"), F.lit(True).alias("cyclic"))
    )
