"""Tool-call linking of conversations.

Calls (call_id, conv_id, turn, name, arguments, after) and results (call_id,
conv_id, turn, content) are hash-joined by conversation and identifier: an
identifier means nothing outside its conversation (rows without a conversation
are one of their own). ``after`` names the call of the conversation whose result a
call builds on; the topological level of a call is the number of
calls before it on that way, found by pointer doubling: every round joins each
open call with the call it points to and doubles the step, so a chain of n
calls takes log2(n) rounds. Arguments are parsed, checked against the JSON
schema of the tool's name, and each call with its result becomes one message in
canonical JSON (keys sorted, no white space, UTF-8).

No conversation is gathered in one task: joins are on conversation and call
identifier, and a result's first-ness is a partial aggregate.

Defined cases: a call without identifier (null) is linked to nothing, level 0.
A call whose ``after`` names no call, is null or names itself has level 0; a
call on a cycle, or behind one, has level null and the error ``cycle``. Of
several results of one identifier the first by turn, then content, is linked,
the others (and results of no call) come out as rows of their own with the
error ``no open call``. A result of a turn before the first call of its identifier
answers no call (where a turn is null, order is unknown and it does). Calls that repeat an identifier share its result, and
its first ``after`` in text order counts. Unparsable, duplicate-key, non-finite
and too deeply nested arguments, unknown tools and schema violations are named
in ``error``; such messages carry the arguments as a string. Empty tables give
no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specweave.llm.common import need
from specweave.session import materialize

CALLS = ("call_id", "conv_id", "turn", "name", "arguments", "after")
RESULTS = ("call_id", "conv_id", "turn", "content")
MESSAGES = "conv_id long, turn long, call_id string, name string, level int, linked boolean, result_turn long, valid boolean, error string, message string"

_TYPES = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind in ("integer", "number"):
        if isinstance(value, bool) or not isinstance(value, (int, float)):
            return False
        return kind == "number" or isinstance(value, int) or value.is_integer()
    return isinstance(value, _TYPES[kind])


def violation(value, schema: dict, path: str = "$") -> str | None:
    """First violation of a JSON schema (type, enum, required, properties,
    additionalProperties, items, length and range limits), or None."""
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: not of type {kinds}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{path}: length"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{path}: range"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := violation(value[name], known[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{name}: not allowed"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if found := violation(x, schema["items"], f"{path}[{i}]"):
                return found
    return None


def _unique(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("repeated key")
    return out


def _finite(name):
    raise ValueError(name)


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def canonical(value) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    try:
        text.encode()
    except UnicodeEncodeError:  # lone surrogates have no UTF-8
        text = json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)
    return text


def check_arguments(name: str | None, arguments: str | None, schemas: dict) -> tuple[object, str | None]:
    """(parsed arguments, error)."""
    if arguments is None:
        return None, "arguments: missing"
    try:
        value = json.loads(arguments, object_pairs_hook=_unique, parse_constant=_finite, parse_float=_number)
        if name not in schemas:
            return value, "unknown tool"
        return value, violation(value, schemas[name])
    except RecursionError:
        return arguments, "arguments: nested too deeply"
    except ValueError as e:
        return arguments, f"arguments: {e}"


def _messages(schemas: dict):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out = []
            for r in b.to_pylist():
                error = value = None
                if r["is_call"]:
                    value, error = check_arguments(r["name"], r["arguments"], schemas)
                    valid = error is None
                    if r["level"] is None:
                        error = f"cycle; {error}" if error else "cycle"
                    message = {"arguments": value, "id": r["call_id"], "name": r["name"], "result": r["content"] if r["linked"] else None}
                else:
                    valid, error = False, "no open call"
                    message = {"id": r["call_id"], "result": r["content"]}
                try:
                    text = canonical(message)
                except RecursionError:
                    valid, error = False, "arguments: nested too deeply"
                    text = canonical(message | {"arguments": r["arguments"]})
                out.append((r["conv_id"], r["turn"], r["call_id"], r["name"], r["level"], r["linked"], r["result_turn"], valid, error, text))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.string(), pa.string())
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            names = [c.split()[0] for c in MESSAGES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _key(call_id: str = "call_id") -> Column:
    """Conversation and identifier as one key; null without an identifier."""
    return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col(call_id))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every distinct identifier of a conversation;
    level null on and behind cycles."""
    keyed = calls.where("call_id IS NOT NULL").select(_key().alias("key"), "conv_id", "call_id", _key("after").alias("after"))
    own = keyed.groupBy("key").agg(F.first("conv_id").alias("conv_id"), F.first("call_id").alias("call_id"), F.min("after").alias("after"))
    own = materialize(own, "chat-calls")
    known = own.select(F.col("key").alias("up"))
    step = own.join(known, (F.col("after") == F.col("up")) & (F.col("after") != F.col("key")), "left")
    step = materialize(step.select("key", "up", F.when(F.col("up").isNull(), 0).otherwise(1).alias("level")), "chat-levels")
    rounds = max(1, own.count()).bit_length()
    for _ in range(rounds):
        if step.where("up IS NOT NULL").isEmpty():
            break
        there = step.select(F.col("key").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        step = step.join(there, "up", "left").select("key", F.col("next").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        step = materialize(step, "chat-levels")
    found = step.select("key", F.when(F.col("up").isNull(), F.col("level")).cast("int").alias("level"))
    return own.select("key", "conv_id", "call_id").join(found, "key").drop("key")


def link(calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """MESSAGES: a row per call and per result that no call is open for."""
    calls = need(calls, CALLS).withColumn("key", _key())
    results = materialize(need(results, RESULTS).withColumn("number", F.monotonically_increasing_id()).withColumn("key", _key()), "chat-results")
    opened = calls.where("key IS NOT NULL").groupBy("key").agg(F.min("turn").alias("opened"))
    answers = results.where("key IS NOT NULL").join(opened, "key").where("turn IS NULL OR opened IS NULL OR turn >= opened")
    first = answers.groupBy("key").agg(F.min(F.struct(F.col("turn").isNull().alias("n"), "turn", "content", "number")).alias("r"))
    first = materialize(first.select("key", F.col("r.number").alias("number"), F.col("r.turn").alias("result_turn"), F.col("r.content").alias("content")), "chat-first")
    linked = calls.join(first, "key", "left").join(levels(calls).select(_key().alias("key"), "level"), "key", "left")
    rows = linked.select(
        F.lit(True).alias("is_call"), "conv_id", "turn", "call_id", "name", "arguments",
        F.when(F.col("call_id").isNull(), F.lit(0)).otherwise(F.col("level")).alias("level"),
        F.col("number").isNotNull().alias("linked"), "result_turn", "content",
    )
    open_ = results.join(first.select("number"), "number", "left_anti").select(
        F.lit(False).alias("is_call"), "conv_id", "turn", "call_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"),
        F.lit(None).cast("int").alias("level"), F.lit(False).alias("linked"), F.col("turn").alias("result_turn"), "content",
    )
    return rows.unionByName(open_).mapInArrow(_messages(schemas), MESSAGES)


#: What a call of a plain conversation must look like, by role.
TURN_SCHEMA = {
    "type": "object",
    "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    "required": ["text", "turn"],
    "additionalProperties": False,
}
TURN_SCHEMAS = {"system": TURN_SCHEMA, "user": TURN_SCHEMA, "tool": TURN_SCHEMA}


def from_conversations(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a table of plain turns (conv_id, turn, role, text).

    Each turn that is not the assistant's is a call of the tool of its role,
    identified by its turn (so conversations share identifiers), with its text and turn as arguments,
    and builds on the call two turns before it; an assistant's turn is the
    result of the turn before it.
    """
    rows = need(table, ("conv_id", "turn", "role", "text"))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")

    def name(back: int):
        return F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.format_string("call_%d", F.col("turn") - back))

    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    calls = rows.where(~answer).select(name(0).alias("call_id"), "conv_id", "turn", F.col("role").alias("name"), F.to_json(F.struct("text", "turn")).alias("arguments"), F.when(F.col("turn") >= 2, name(2)).alias("after"))
    results = rows.where(answer).select(name(1).alias("call_id"), "conv_id", "turn", F.col("text").alias("content"))
    return calls, results
