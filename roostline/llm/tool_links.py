"""Tool calls in chats: calls meet their results, are ordered by what they refer to, checked and written canonically."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roostline.llm.common import table
from roostline.session import staged

BLOCK = 1024

# ------------------------------------------------------------------ canonical JSON and schemas


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("not a JSON number")
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def canonical(value) -> str:
    """Members in the order of their UTF-16 units, no white space, no needless escape, whole numbers without fraction."""
    if isinstance(value, dict):
        order = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k])}" for k in order) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return _number(value) if isinstance(value, float) else json.dumps(value, ensure_ascii=False)


def _no_repeats(pairs):
    if len({k for k, _ in pairs}) < len(pairs):
        raise ValueError("a name occurs twice in an object")
    return dict(pairs)


def parsed(text: str):
    return json.loads(text, object_pairs_hook=_no_repeats, parse_constant=lambda x: _number(float(x)))


def _is(value, kind: str) -> bool:
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool),
        "null": value is None, "number": number, "integer": number and value == int(value),
    }[kind]


def violation(value, schema: dict, path: str = "$") -> str | None:
    """The first fault of a value against a schema: type, enum, bounds, lengths, properties, required, items."""
    if "type" in schema and not _is(value, schema["type"]):
        return f"{path}: not of type {schema['type']}"
    if "enum" in schema and not any(x == value and isinstance(x, bool) == isinstance(value, bool) for x in schema["enum"]):
        return f"{path}: not one of the allowed values"
    if _is(value, "number") and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{path}: out of bounds"
    if isinstance(value, (str, list)) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{path}: length out of bounds"
    if isinstance(value, list) and "items" in schema:
        return next((v for i, x in enumerate(value) if (v := violation(x, schema["items"], f"{path}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for name in schema.get("required", ()):
            if name not in value:
                return f"{path}.{name}: missing"
        for name in sorted(value):
            if name in known:
                if found := violation(value[name], known[name], f"{path}.{name}"):
                    return found
            elif schema.get("additionalProperties") is False:
                return f"{path}.{name}: unknown"
    return None


def checked(name: str | None, arguments: str | None, schemas: dict[str, dict]) -> tuple[str | None, str | None]:
    """Canonical arguments and fault of a call; without arguments that parse there is no canonical form."""
    try:
        value = parsed(arguments or "")
        text = canonical(value)
        text.encode()  # half of a surrogate pair is no text
    except (ValueError, RecursionError):
        return None, "$: no JSON"
    return text, f"unknown tool {name}" if name not in schemas else violation(value, schemas[name])


# ------------------------------------------------------------------ linking and order


def depths(calls: DataFrame, refers: DataFrame) -> DataFrame:
    """``call_id`` and ``depth`` of each call that no cycle holds back: 0, or one more than the deepest it refers to.

    ``calls``: distinct call_id; ``refers``: call_id, needs. References to calls that do not exist do not hold back.
    A round removes the references to calls that the round before has placed; each is a written table.
    There are as many rounds as the longest chain of references has calls.
    """
    known = refers.select("call_id", "needs").distinct().join(calls.withColumnRenamed("call_id", "needs"), "needs", "left_semi")
    open_ = staged(known.join(calls, "call_id", "left_semi"), "references")
    waiting = staged(open_.select("call_id").distinct(), "waiting")
    placed = staged(calls.join(waiting, "call_id", "left_anti").withColumn("depth", F.lit(0)), "placed")
    done = placed
    while not placed.isEmpty() and not waiting.isEmpty():
        depth = F.lit(placed.first().depth + 1)
        open_ = staged(open_.join(placed.select(F.col("call_id").alias("needs")), "needs", "left_anti"), "references")
        still = staged(open_.select("call_id").distinct(), "waiting")
        placed = staged(waiting.join(still, "call_id", "left_anti").withColumn("depth", depth), "placed")
        waiting, done = still, done.unionByName(placed)
    return done


def _serialise(schemas: dict[str, dict]):
    def serialise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            valid, errors, texts = [], [], []
            for r in rows:
                text, fault = checked(r["name"], r["arguments"], schemas) if r["kind"] == "call" else (None, None)
                valid.append(fault is None if r["kind"] == "call" else None)
                errors.append(fault)
                whole = {"id": r["call_id"], "kind": r["kind"]}
                if r["kind"] == "call":
                    whole |= {"name": r["name"], "arguments": None if text is None else parsed(text), "result": r["result"]}
                else:
                    whole |= {"content": r["content"]}
                texts.append(canonical(whole))
            keep = [i for i, n in enumerate(batch.schema.names) if n not in ("name", "arguments", "content", "result")]
            columns = [*(batch.column(i) for i in keep), pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(batch.schema.names[i] for i in keep), "valid", "error", "json"])

    return serialise


def linked(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Per message: conv_id, turn, kind, call_id, status, depth, position, valid, error, json.

    ``messages``: conv_id, turn, kind (call, result, other), call_id, name, arguments (JSON text), content, needs (array
    of call ids). Of several calls, or results, with one id the first by (conv_id, turn) counts and the
    others are ``duplicate``. A call is ``linked`` or ``unanswered``, or ``cycle`` if its references never end; a result is
    ``linked`` or ``orphan``; other messages and those without an id are ``none``. ``position`` counts the messages of a
    conversation from 0 in topological order: by depth (a result has the depth of its call), then turn,
    then id, calls before results. Arguments are checked against the tool's schema; json is canonical. A call with arguments that do not
    parse, or that hold half of a surrogate pair, has null arguments there. Null conversations form one; an empty table gives no rows.
    """
    rows = staged(messages.withColumn("_row", F.monotonically_increasing_id()), "messages")
    per_kind = lambda kind: rows.where((F.col("kind") == kind) & F.col("call_id").isNotNull())
    place = F.struct("conv_id", "turn", "_row")
    # One row per id on either side, summed up before the shuffle: the join is one to one.
    calls = per_kind("call").groupBy("call_id").agg(F.min_by(F.struct("_row", "needs"), place).alias("c"))
    results = per_kind("result").groupBy("call_id").agg(F.min_by(F.struct("_row", "content"), place).alias("r"))
    pairs = staged(calls.join(results, "call_id", "full"), "pairs")
    with_call = pairs.where("c IS NOT NULL")
    refers = with_call.select("call_id", F.explode("c.needs").alias("needs"))
    depth = depths(with_call.select("call_id"), refers)
    ids = staged(pairs.join(depth, "call_id", "left"), "pairs")

    joined = rows.join(ids.withColumnRenamed("call_id", "_id"), F.col("call_id") == F.col("_id"), "left")
    first = F.when(F.col("kind") == "call", F.col("c._row")).otherwise(F.col("r._row")) == F.col("_row")
    status = (
        F.when(~F.col("kind").isin("call", "result") | F.col("kind").isNull() | F.col("call_id").isNull(), "none")
        .when(~first, "duplicate")
        .when(F.col("kind") == "result", F.when(F.col("c").isNull(), "orphan").otherwise("linked"))
        .when(F.col("depth").isNull(), "cycle")
        .when(F.col("r").isNull(), "unanswered")
        .otherwise("linked")
    )
    stated = joined.select(
        "conv_id", "turn", F.coalesce("kind", F.lit("other")).alias("kind"), "call_id", status.alias("status"), "depth", "_row",
        "name", "arguments", "content", F.when(status == "linked", F.col("r.content")).alias("result"),
    )
    placed = _positions(staged(stated, "stated"))
    out = "conv_id BIGINT, turn BIGINT, kind STRING, call_id STRING, status STRING, depth INT, position BIGINT, valid BOOLEAN, error STRING, json STRING"
    return placed.mapInArrow(_serialise(schemas), out)


def _positions(rows: DataFrame) -> DataFrame:
    """Adds ``position``. A conversation of any length is ranked in stretches of turns, whose sizes are summed up first."""
    last = F.coalesce("depth", F.lit(2**31 - 1))
    stretch = F.floor(F.coalesce("turn", F.lit(-1)) / BLOCK)
    keyed = rows.withColumn("_depth", last).withColumn("_stretch", stretch)
    group = ["conv_id", "_depth", "_stretch"]
    sizes = staged(keyed.groupBy(*group).agg(F.count("*").alias("n")), "stretches")
    over = Window.partitionBy("conv_id").orderBy("_depth", "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = staged(sizes.select(*group, F.coalesce(F.sum("n").over(over), F.lit(0)).alias("_before")), "stretches")
    order = Window.partitionBy(*group).orderBy("turn", "call_id", "kind", "_row")
    ranked = keyed.withColumn("_rank", F.row_number().over(order) - 1)
    b = before.select(*[F.col(c).alias(f"{c}_b") for c in group], "_before")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_b")) for c in group]
    joined = ranked.join(b, same[0] & same[1] & same[2])
    return joined.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "kind", "call_id", "status", F.col("depth").cast("int"),
        (F.col("_before") + F.col("_rank")).cast("bigint").alias("position"), "name", "arguments", "content", "result",
    )


# ------------------------------------------------------------------ the query

TOOLS = {
    tool: {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 0, "maximum": most}, "strict": {"type": "boolean"}},
    }
    for tool, most in (("search", 15), ("lookup", 19), ("summary", 10))
}


def tool_messages(conversations: DataFrame) -> DataFrame:
    """Chats read as tool use: a user's turn calls a tool with the whole text, the assistant's next turn is the result.

    A call refers to the call two turns before it within the same eight turns.
    """
    call_id = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn, size = F.col("turn"), F.length(F.coalesce("text", F.lit("")))
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("other")
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), (F.pmod(size, F.lit(len(TOOLS))) + 1).cast("int"))
    arguments = F.to_json(F.struct((size % 3 == 0).alias("strict"), F.col("text").alias("query"), (size % 20).alias("limit")))
    is_call = kind == "call"
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), turn.cast("bigint").alias("turn"), kind.alias("kind"),
        F.when(is_call, call_id(turn)).when(kind == "result", call_id(turn - 1)).alias("call_id"),
        F.when(is_call, tool).alias("name"), F.when(is_call, arguments).alias("arguments"),
        F.when(~is_call, F.col("text")).alias("content"),
        F.when(is_call & (turn % 8 >= 2), F.array(call_id(turn - 2))).otherwise(F.array().cast("array<string>")).alias("needs"),
    )


def op2_tool_links(spark: SparkSession, folder: str) -> DataFrame:
    return linked(tool_messages(table(spark, folder, "conversations")), TOOLS)
