"""Tool calls of conversations, linked to their results and written as canonical JSON.

Calls and results are joined by conversation and identifier; of an identifier that is used twice the first call (by turn
and place) and the first result count.  Calls may name others whose results they need.  A call's level is its turn, or
one more than the highest level of what it needs, if that is more; on a circle or behind one it is null.  Conversations
whose calls only need earlier ones have their turns as levels.  Others are ordered by one pass over each, if they have
at most GROUP_CALLS calls and needs; larger ones by rounds of joins, in which a circle shows by rising longer than
there are calls.  Arguments are checked against the tool's JSON schema, and each linked call is written as JSON with
sorted keys, without spaces, in UTF-8; halves of surrogate pairs, which UTF-8 hasn't, stay escaped.

status, the first that applies: no_id, duplicate_call, unknown_tool, invalid_json, invalid_arguments, cycle,
missing_dependency, missing_result, ok; for results: no_id, orphan_result, duplicate_result; for the query's
rows of no role or another one than user, system and assistant: other_role.  Nulls: a null conv_id is a
conversation of its own, a null turn comes before all others, null text is null in JSON, null arguments are invalid_json,
and so are numbers that Python can't read (beyond a double's range, or integers of over 4,300 digits) and JSON nested
beyond Python's stack.
Repeated rows are duplicates; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, saved, table

#: Calls and needs of a conversation that is ordered in one pass.
GROUP_CALLS = 50_000
SURROGATE = re.compile("[\ud800-\udfff]")
SCHEMA_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value: type, enum, const, bounds, lengths, pattern, items, properties, required,
    additionalProperties."""
    out = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []

    def is_(kind: str) -> bool:
        if kind in ("number", "integer"):
            return isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
        return isinstance(value, SCHEMA_TYPES[kind])

    if kinds and not any(map(is_, kinds)):
        return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at}: not allowed")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] * (value < schema.get("minimum", value)) + [f"{at}: above maximum"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
        out += [f"{at}: no match"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if isinstance(value, list):
        out += [f"{at}: too few"] * (len(value) < schema.get("minItems", 0)) + [f"{at}: too many"] * (len(value) > schema.get("maxItems", len(value)))
        for k, x in enumerate(value) if "items" in schema else ():
            out += errors(x, schema["items"], f"{at}[{k}]")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k, x in value.items():
            if k in known:
                out += errors(x, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: unknown")
    return out


def escaped(text: str) -> str:
    return SURROGATE.sub(lambda c: f"\\u{ord(c[0]):04x}", text)


def canonical(value) -> str:
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def check_arguments(schemas: dict[str, dict]):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds wrong (a status or null) and detail to rows with name and arguments, whose JSON becomes canonical."""
        for batch in batches:
            wrong, detail, clean = [], [], []
            for name, text in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist()):
                status, said = None, []
                try:
                    value = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
                    text = canonical(value)
                    if name not in schemas:
                        status = "unknown_tool"
                    elif said := errors(value, schemas[name]):
                        status = "invalid_arguments"
                except (ValueError, TypeError, RecursionError):
                    status = "unknown_tool" if name not in schemas else "invalid_json"
                wrong.append(status)
                detail.append(escaped("; ".join(said)) or None)
                clean.append(text)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"arguments": pa.array(clean, pa.string()), "wrong": pa.array(wrong, pa.string()), "detail": pa.array(detail, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


@lean
def write_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds json: the call with its arguments and result."""
    for batch in batches:
        out = []
        for r in batch.select(["call_id", "name", "arguments", "wrong", "needs", "result"]).to_pylist():
            arguments = r["arguments"]
            if r["wrong"] not in ("invalid_json", "unknown_tool"):
                arguments = json.loads(arguments)
            out.append(canonical({"id": r["call_id"], "name": r["name"], "arguments": arguments, "after": sorted(r["needs"] or []), "result": r["result"]}))
        columns = {n: batch.column(n) for n in batch.schema.names} | {"json": pa.array(out, pa.string())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def topological(calls):
    """A conversation's calls (pandas: conv_key, call_id, start, needs) → level, null on a circle or behind one; and cycle."""
    start = dict(zip(calls["call_id"], calls["start"]))
    needs = {c: {n for n in some if n in start} for c, some in zip(calls["call_id"], calls["needs"])}
    behind: dict[str, list[str]] = {}
    for c, some in needs.items():
        for n in some:
            behind.setdefault(n, []).append(c)
    waits = {c: len(some) for c, some in needs.items()}
    level = {c: int(start[c]) for c, k in waits.items() if k == 0}
    ready = list(level)
    for c in ready:
        for d in behind.get(c, ()):
            waits[d] -= 1
            start[d] = max(start[d], level[c] + 1)
            if waits[d] == 0:
                level[d] = int(start[d])
                ready.append(d)
    out = calls[["conv_key", "call_id"]].copy()
    out["level"] = calls["call_id"].map(level).astype("Int64")
    out["cycle"] = out["level"].isna()
    return out


def levels(calls: DataFrame, group_calls: int = GROUP_CALLS) -> DataFrame:
    """calls: conv_key, call_id, start (long), needs (array of ids).  Adds level and cycle; missing needs count for nothing."""
    edges = calls.select("conv_key", "call_id", "start", F.explode("needs").alias("need"))
    starts = calls.select("conv_key", F.col("call_id").alias("need"), F.col("start").alias("before"))
    edges = saved(edges.join(starts, ["conv_key", "need"]), "needs")
    forward = edges.where("before >= start").select("conv_key").distinct()
    sized = calls.groupBy("conv_key").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.size("needs") + 1).alias("size"))
    sized = saved(sized.join(forward, "conv_key"), "forward")
    most = sized.where(F.col("size") > group_calls).agg(F.max("calls")).first()[0]
    if most is None and sized.isEmpty():
        return calls.withColumn("level", F.col("start")).withColumn("cycle", F.lit(False))
    names = ["conv_key", "call_id", "level", "cycle"]
    some = calls.select("conv_key", "call_id", "start", "needs").join(sized.where(F.col("size") <= group_calls), "conv_key", "left_semi")
    found = saved(some.groupBy("conv_key").applyInPandas(topological, "conv_key string, call_id string, level bigint, cycle boolean"), "levels")
    if most is not None:
        large = sized.where(F.col("size") > group_calls).select("conv_key")
        found = found.unionByName(rounds(calls.join(large, "conv_key", "left_semi"), edges.join(large, "conv_key", "left_semi"), most).select(*names))
    known = calls.join(found, ["conv_key", "call_id"], "left")
    return known.withColumn("level", F.when(F.col("cycle").isNull(), F.col("start")).otherwise(F.col("level"))).withColumn("cycle", F.coalesce("cycle", F.lit(False)))


def rounds(calls: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """Levels (conv_key, call_id, level, cycle) by raising every call above what it needs, until none rises."""
    now = calls.select("conv_key", "call_id", F.col("start").alias("level"))
    settled = None
    # A chain without a circle is settled after as many rounds as the conversation has calls.
    for k in range(2 * most + 1):
        if k == most:
            settled = now
        above = edges.select("conv_key", "call_id", "need").join(now.withColumnRenamed("call_id", "need"), ["conv_key", "need"]).groupBy("conv_key", "call_id").agg((F.max("level") + 1).alias("least"))
        stepped = saved(now.join(above, ["conv_key", "call_id"], "left").select("conv_key", "call_id", F.greatest("level", F.coalesce("least", "level")).alias("new"), "level"), "levels")
        now = stepped.select("conv_key", "call_id", F.col("new").alias("level"))
        if stepped.where("new > level").isEmpty():
            return now.withColumn("cycle", F.lit(False))
    # What still rises in as many rounds again is on a circle or behind one.
    rising = settled.withColumnRenamed("level", "old").join(now, ["conv_key", "call_id"]).withColumn("cycle", F.col("level") > F.col("old"))
    return rising.select("conv_key", "call_id", F.when(~F.col("cycle"), F.col("level")).alias("level"), "cycle")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls: conv_id, turn, place, call_id, name, arguments (JSON), needs (ids); results: conv_id, turn, call_id, result.
    One row per call and one per result that belongs to none: conv_id, turn, level, call_id, name, arguments,
    result_turn, result, status, detail, json.  Within a conversation, level, turn and call_id give the order."""
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("-")).alias("conv_key")
    # Rows are told apart by a hash of all they hold and a count of equal ones, so a lost task's rows come out alike.
    c = calls.select("conv_id", key, "turn", "place", "call_id", "name", "arguments", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    c = saved(c.groupBy(*c.columns).agg(F.count(F.lit(1)).alias("times")), "calls")
    r = results.select("conv_id", key, "turn", "call_id", "result")
    r = saved(r.groupBy(*r.columns).agg(F.count(F.lit(1)).alias("times")), "results")
    mark_c = F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), F.coalesce("place", F.lit(-1)).alias("p"), F.coalesce("name", F.lit("")).alias("n"), F.coalesce("arguments", F.lit("")).alias("a"), F.to_json("needs").alias("d"))
    mark_r = F.struct(F.coalesce("turn", F.lit(-1)).alias("t"), F.coalesce("result", F.lit("")).alias("x"))
    first_c = c.where("call_id is not null").groupBy("conv_key", "call_id").agg(F.min(mark_c).alias("first"))
    first_r = r.where("call_id is not null").groupBy("conv_key", "call_id").agg(F.min(mark_r).alias("first"))
    c = c.withColumn("mark", mark_c).join(first_c, ["conv_key", "call_id"], "left").withColumn("is_first", F.coalesce(F.col("mark") == F.col("first"), F.lit(False))).drop("mark", "first")
    r = r.withColumn("mark", mark_r).join(first_r, ["conv_key", "call_id"], "left").withColumn("is_first", F.coalesce(F.col("mark") == F.col("first"), F.lit(False))).drop("mark", "first")
    c, r = saved(c, "calls"), saved(r, "results")
    good = levels(c.where("is_first").withColumn("start", F.coalesce(F.col("turn").cast("long"), F.lit(-1))))
    missing = good.select("conv_key", "call_id", F.explode("needs").alias("need")).join(good.select("conv_key", F.col("call_id").alias("need")), ["conv_key", "need"], "left_anti").groupBy("conv_key", "call_id").agg(F.lit(True).alias("lacks"))
    answers = r.where("is_first").select("conv_key", "call_id", F.col("turn").alias("result_turn"), "result", F.lit(True).alias("answered"))
    # Answers are one a call, so no part of their hash table outgrows the others.
    linked = good.join(answers.hint("shuffle_hash"), ["conv_key", "call_id"], "left").join(missing, ["conv_key", "call_id"], "left").drop("start", "is_first")
    schema = "conv_key string, call_id string, conv_id bigint, turn bigint, place int, name string, arguments string, needs array<string>, times bigint, level bigint, cycle boolean, result_turn bigint, result string, answered boolean, lacks boolean"
    linked = linked.select("conv_key", "call_id", F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("place").cast("int"), "name", "arguments", "needs", "times", "level", "cycle", F.col("result_turn").cast("bigint"), "result", "answered", "lacks")
    linked = linked.mapInArrow(check_arguments(schemas), schema + ", wrong string, detail string").mapInArrow(write_json, schema + ", wrong string, detail string, json string")
    status = F.coalesce("wrong", F.when(F.col("cycle"), "cycle").when(F.col("lacks"), "missing_dependency").when(F.col("answered").isNull(), "missing_result").otherwise("ok"))
    columns = ["conv_id", "turn", "level", "call_id", "name", "arguments", "result_turn", "result", "status", "detail", "json"]
    main = linked.withColumn("status", status)
    none = lambda t: F.lit(None).cast(t)
    blank = {"level": none("bigint"), "result_turn": none("bigint"), "result": none("string"), "detail": none("string"), "json": none("string")}
    again = main.where("times > 1").select(*[F.col(x) for x in columns if x not in (*blank, "status")], *[v.alias(k) for k, v in blank.items()], F.lit("duplicate_call").alias("status"), F.explode(F.sequence(F.lit(2), F.col("times").cast("int"))).alias("again")).drop("again")
    other = c.where("not is_first").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "call_id", "name", "arguments", *[v.alias(k) for k, v in blank.items()], F.when(F.col("call_id").isNull(), "no_id").otherwise("duplicate_call").alias("status"), F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("again")).drop("again")
    owned = c.where("is_first").select("conv_key", "call_id", F.lit(True).alias("owned"))
    loose = r.join(owned, ["conv_key", "call_id"], "left").withColumn("extra", F.col("times") - F.when(F.col("is_first") & F.col("owned"), 1).otherwise(0)).where("extra > 0")
    said = F.when(F.col("call_id").isNull(), "no_id").when(F.col("owned").isNull(), "orphan_result").otherwise("duplicate_result")
    loose = loose.select(F.col("conv_id").cast("bigint").alias("conv_id"), none("bigint").alias("turn"), none("bigint").alias("level"), "call_id", none("string").alias("name"), none("string").alias("arguments"), F.col("turn").cast("bigint").alias("result_turn"), "result", said.alias("status"), none("string").alias("detail"), none("string").alias("json"), F.explode(F.sequence(F.lit(1), F.col("extra").cast("int"))).alias("again")).drop("again")
    return main.select(*columns).unionByName(again.select(*columns)).unionByName(other.select(*columns)).unionByName(loose.select(*columns))


SCHEMAS = {
    "respond": {"type": "object", "required": ["query", "turn"], "additionalProperties": False, "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 1800}, "turn": {"type": "integer", "minimum": 0}}},
    "configure": {"type": "object", "required": ["system"], "properties": {"system": {"type": "string"}}},
}


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A user's message as a call to respond, which needs the call two turns before, a system's as one to configure; an
    assistant's as the result of the call one turn before."""
    name = F.concat(F.lit("call-"), F.col("turn").cast("string"))
    before = F.concat(F.lit("call-"), (F.col("turn") - 2).cast("string"))
    user = F.col("role") == "user"
    arguments = F.when(user, F.to_json(F.struct(F.col("turn"), F.col("text").alias("query")))).otherwise(F.to_json(F.struct(F.col("text").alias("system"))))
    calls = conversations.where(F.col("role").isin("user", "system")).select("conv_id", "turn", F.lit(0).alias("place"), name.alias("call_id"), F.when(user, "respond").otherwise("configure").alias("name"), arguments.alias("arguments"), F.when(user & (F.col("turn") >= 2), F.array(before)).otherwise(F.array().cast("array<string>")).alias("needs"))
    results = conversations.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("result"))
    return calls, results


def others_of(conversations: DataFrame, like: DataFrame) -> DataFrame:
    """A row, with the columns of like, for each message that is neither a call nor a result: its role as name, its text
    as result."""
    rows = conversations.where(~F.coalesce(F.col("role").isin("user", "system", "assistant"), F.lit(False)))
    have = {"conv_id": F.col("conv_id"), "turn": F.col("turn"), "name": F.col("role"), "result": F.col("text"), "status": F.lit("other_role")}
    return rows.select(*[have.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in like.dtypes])


def op10_tool_calls(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    linked = link(*calls_of(conversations), SCHEMAS)
    return linked.unionByName(others_of(conversations, linked))
