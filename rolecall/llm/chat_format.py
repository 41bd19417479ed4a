"""Tool calls of conversations: linked with their results, ordered, validated, serialised.

Calls and results meet in a hash join on conversation and identifier. A call may
name another that it comes after; levels of that order come from pointer doubling,
so their number of rounds is the logarithm of the longest chain. Arguments are
checked against each tool's schema, and every event becomes one line of canonical
JSON: keys sorted, no blanks, whatever the order and spacing they came in.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import staged

_IDS = ("conv_id", "call_id")
_CALL = "struct<turn: bigint, name: string, arguments: string, after: string>"
_RESULT = "struct<turn: bigint, content: string>"


def _match(left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in _IDS])


def _firsts(rows: DataFrame, value: str) -> DataFrame:
    """Different rows with `copies`, and `first`: whether the row is its identifier's earliest."""
    rows = rows.groupBy(*_IDS, value).agg(F.count(F.lit(1)).alias("copies"))
    least = rows.groupBy(*_IDS).agg(F.min(value).alias("least"))
    return rows.alias("l").join(least.alias("r"), _match("l", "r")).select("l.*", F.col(value).eqNullSafe(F.col("least")).alias("first"))


def call_levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level, cyclic of calls (conv_id, call_id, after), ids not null and unique.

    Level 0 comes after no call of its conversation, other levels follow the call
    they name. Calls on a circle, or after one, have no level and are cyclic.
    """
    ids = calls.select(F.col("conv_id"), F.col("call_id").alias("after"), F.lit(True).alias("_there"))
    state = calls.join(ids, ["conv_id", "after"], "left").select("conv_id", "call_id", F.when(F.col("_there"), F.col("after")).alias("up"), F.when(F.col("_there"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("level"))
    state = staged(state, "levels")
    left = state.filter("up IS NOT NULL").count()
    while left:
        above = state.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("_up"), F.col("level").alias("_level"))
        state = staged(state.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("_up").alias("up"), (F.col("level") + F.coalesce("_level", F.lit(0))).alias("level")), "levels")
        before, left = left, state.filter("up IS NOT NULL").count()
        if before == left:  # a chain would have let its next part go
            break
    return state.select("conv_id", "call_id", F.expr("CASE WHEN up IS NULL THEN level END").alias("level"), F.col("up").isNotNull().alias("cyclic"))


# variant types as schema_of_variant names them, for each type of a schema
_TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


def _broken(arguments: Column, field: str, rule: dict) -> Column:
    """The field's first fault, or null."""
    value = F.variant_get(arguments, f"$['{field}']", "variant")
    kind = F.schema_of_variant(value)
    right = reduce(lambda a, b: a | b, [kind.startswith(t) for t in _TYPES[rule["type"]]])
    missing = value.isNull() | F.is_variant_null(value)
    out = F.when(missing, F.lit(f"{field}: missing") if rule.get("required") else F.lit(None)).when(~right, F.lit(f"{field}: not {rule['type']}"))
    number, text = F.try_variant_get(arguments, f"$['{field}']", "double"), F.try_variant_get(arguments, f"$['{field}']", "string")
    if "minimum" in rule:
        out = out.when(number < rule["minimum"], F.lit(f"{field}: under {rule['minimum']}"))
    if "maximum" in rule:
        out = out.when(number > rule["maximum"], F.lit(f"{field}: over {rule['maximum']}"))
    if "min_length" in rule:
        out = out.when(F.length(text) < rule["min_length"], F.lit(f"{field}: too short"))
    if "enum" in rule:
        out = out.when(~text.isin(*rule["enum"]), F.lit(f"{field}: not allowed"))
    return out


def argument_errors(name: Column, text: Column, schemas: dict[str, dict[str, dict]]) -> Column:
    """Comma-joined faults of a call's JSON arguments, empty if they fit the tool's schema.

    `schemas` maps a tool to its fields: type, required, minimum, maximum, min_length, enum.
    """
    arguments = F.try_parse_json(text)
    out = F.when(name.isNull() | ~name.isin(*schemas), F.lit("unknown tool")).when(arguments.isNull(), F.lit("arguments are not JSON"))
    out = out.when(~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("arguments are not an object"))
    for tool, fields in schemas.items():
        out = out.when(name == tool, F.array_join(F.array_compact(F.array(*[_broken(arguments, f, r) for f, r in sorted(fields.items())])), ", "))
    return out


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, dict]]) -> DataFrame:
    """One row per different call and per result that no call takes.

    `calls`: conv_id, turn, call_id, name, arguments (JSON text), after (a call_id or
    null). `results`: conv_id, turn, call_id, content. Other columns are ignored.
    Returns conv_id, call_id, status, call_turn, result_turn, level, cyclic, errors,
    copies and json.

    status: linked, unanswered, orphan (a result without call), duplicate call or
    duplicate result (an identifier's later rows; the earliest turn is the call or
    result, then the smaller other values). Equal rows are one, counted in copies.
    Rows without conv_id or call_id link with nothing. Arguments that are not JSON
    stand in the line as text. Order events by conv_id, level, call_turn, result_turn.
    """
    asked = calls.select(*_IDS, F.struct(F.col("turn").cast("long").alias("turn"), "name", "arguments", "after").cast(_CALL).alias("call"))
    given = results.select(*_IDS, F.struct(F.col("turn").cast("long").alias("turn"), "content").cast(_RESULT).alias("result"))
    asked, given = staged(_firsts(asked, "call"), "calls"), staged(_firsts(given, "result"), "results")
    named = F.col("first") & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()

    left = asked.filter(named).select(*_IDS, "call", "copies")
    right = given.filter(named).select(*_IDS, "result", F.col("copies").alias("_copies"))
    both = left.join(right, list(_IDS), "full").select(
        *_IDS, "call", "result", F.coalesce("copies", "_copies").alias("copies"),
        F.when(F.col("call").isNull(), "orphan").when(F.col("result").isNull(), "unanswered").otherwise("linked").alias("status"),
    )
    levels = call_levels(left.select(*_IDS, F.col("call.after").alias("after")))
    both = both.join(levels, list(_IDS), "left")

    def apart(rows: DataFrame, call: Column, result: Column, what: str, without: str) -> DataFrame:
        status = F.when(F.col("first"), without).otherwise(f"duplicate {what}")
        return rows.filter(~named).select(*_IDS, call.alias("call"), result.alias("result"), "copies", status.alias("status"), F.lit(None).cast("long").alias("level"), F.lit(False).alias("cyclic"))

    events = both.unionByName(apart(asked, F.col("call"), F.lit(None).cast(_RESULT), "call", "unanswered"))
    events = events.unionByName(apart(given, F.lit(None).cast(_CALL), F.col("result"), "result", "orphan"))
    arguments = F.col("call.arguments")
    parsed = F.coalesce(F.try_parse_json(arguments), arguments.cast("variant"))
    line = F.struct(parsed.alias("arguments"), "call_id", F.col("result.content").alias("content"), "conv_id", F.col("call.name").alias("name"), "status")
    return events.select(
        *_IDS, "status", F.col("call.turn").alias("call_turn"), F.col("result.turn").alias("result_turn"), "level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
        F.when(F.col("call").isNotNull(), argument_errors(F.col("call.name"), arguments, schemas)).alias("errors"), "copies", F.to_json(line).alias("json"),
    )
