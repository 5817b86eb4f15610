"""Chat formatting: links tool calls with their results, orders them, validates arguments and writes canonical JSON.

A message's text may hold calls and results, each as one JSON object between marks (`<tool_call>`, `<tool_result>`). A
call has id, name, arguments and, if it waits for others, after (their ids); a result has id and content. Calls and
results are hash-joined by conversation and id. The waiting calls make a graph, which is ordered topologically by peeling
off, round by round, the calls whose predecessors are all ordered: a call's level is the round it leaves in, and the order
within a conversation is level, turn, place. One row stands for each message, call and result, so that a conversation of
any size is never collected.

Defined results: null texts are empty; a mark whose object is no JSON object, or has no string id, is a part with a
problem and is linked with nothing; of calls with one id in a conversation the first (turn, place) is linked, the others
are problems; a result before or without its call is a problem; calls in a cycle, or after one, have level null and a
problem; a predecessor that is not there is a problem but does not hold its call back; repeated rows give repeated parts
(linked to the first); other columns, whatever their names, are kept out of the way; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.common import saved, ship, slices

MARK = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.DOTALL)
#: Types of arguments by the names that schemas use.
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict}
Schemas = Mapping[str, Mapping[str, Mapping[str, object]]]

#: Schemas by tool: for each argument its type and whether it must be there; enum lists the values allowed.
TOOLS: Schemas = {
    "search": {"query": {"type": "string", "required": True}, "limit": {"type": "integer"}},
    "calculate": {"expression": {"type": "string", "required": True}},
    "fetch": {"url": {"type": "string", "required": True}, "format": {"type": "string", "enum": ["text", "html"]}},
}


def canonical(value: object) -> str:
    """JSON with sorted keys, no white space, and non-ASCII characters as they are."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def problems_of(name: object, arguments: object, tools: Schemas) -> list[str]:
    """What a tool's schema says against a call's arguments."""
    if not isinstance(name, str) or name not in tools:
        return ["unknown tool"]
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    out = []
    for key, rule in sorted(tools[name].items()):
        if key not in arguments:
            if rule.get("required"):
                out.append(f"{key} is missing")
            continue
        value, kind = arguments[key], TYPES[str(rule["type"])]
        if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
            out.append(f"{key} is no {rule['type']}")
        elif "enum" in rule and value not in rule["enum"]:
            out.append(f"{key} is not allowed")
    return out + [f"{key} is unknown" for key in sorted(set(arguments) - set(tools[name]))]


def parts_of(role: str | None, text: str | None, tools: Schemas) -> list[dict]:
    """The message itself, then its calls and results in place."""
    text = text or ""
    plain = MARK.sub("", text)
    out = [{"place": 0, "part": "message", "id": None, "after": [], "problems": [], "body": {"content": plain, "role": role}}]
    for k, m in enumerate(MARK.finditer(text), 1):
        try:
            found = json.loads(m[2])
        except ValueError:
            found = None
        row = {"place": k, "part": m[1], "id": None, "after": [], "problems": [], "body": {"raw": m[2]}}
        if not isinstance(found, dict) or not isinstance(found.get("id"), str):
            row["problems"] = ["no object with an id"]
        else:
            row["id"], row["body"] = found["id"], found
            if m[1] == "call":
                row["problems"] = problems_of(found.get("name"), found.get("arguments"), tools)
                after = found.get("after", [])
                row["after"] = sorted({x for x in after if isinstance(x, str)}) if isinstance(after, list) else []
        row["body"] = {m[1]: row["body"]}
        out.append(row)
    return out


PARTS = "conv_id long, turn long, place int, part string, id string, after array<string>, problems array<string>, json string"


def parsed(batches: Iterator[pa.RecordBatch], tools: Schemas) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "turn", "place", "part", "id", "after", "problems", "json"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    for batch in slices(batches):
        out: list[list] = [[] for _ in names]
        for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
            for x in parts_of(role, text, tools):
                for o, v in zip(out, (conv, turn, x["place"], x["part"], x["id"], x["after"], x["problems"], canonical(x["body"]))):
                    o.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds)], names)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, id and level of calls(conv_id, id, after); calls in a cycle or after one are absent."""
    known = calls.select("conv_id", "id")
    waits = calls.select("conv_id", "id", F.explode("after").alias("before"))
    edges = saved(waits.join(known.select("conv_id", F.col("id").alias("before")), ["conv_id", "before"]).distinct(), "waits")
    left = saved(known, "left")
    done = None
    level = 0
    while True:
        free = left.join(edges.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti").withColumn("level", F.lit(level))
        free = saved(free, "free")
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        ready = free.drop("level")
        left = saved(left.join(ready, ["conv_id", "id"], "left_anti"), "left")
        edges = saved(edges.join(ready.withColumnRenamed("id", "before"), ["conv_id", "before"], "left_anti"), "waits")
        level += 1
    return done if done is not None else known.withColumn("level", F.lit(0)).limit(0)


def formatted(conversations: DataFrame, tools: Schemas = TOOLS) -> DataFrame:
    """conv_id, turn, place, part (message, call, result), id, level, linked, problems and json (canonical) of every part.

    linked: a call has a result after it, or a result a call before it.
    """
    ship(conversations.sparkSession)
    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    parts = saved(source.mapInArrow(lambda b: parsed(b, tools), PARTS), "parts")
    at = F.struct("turn", "place")
    calls = parts.where("part = 'call' and id is not null and conv_id is not null")
    first = saved(calls.groupBy("conv_id", "id").agg(F.min(F.struct("turn", "place", "after")).alias("c")).select("conv_id", "id", F.struct("c.turn", "c.place").alias("called"), "c.after"), "calls")
    answers = parts.where("part = 'result' and id is not null").groupBy("conv_id", "id").agg(F.max(at).alias("answered"))
    level = saved(levels(first.select("conv_id", "id", "after")), "levels")
    missing = first.select("conv_id", "id", F.explode("after").alias("before")).join(first.select("conv_id", F.col("id").alias("before")), ["conv_id", "before"], "left_anti").groupBy("conv_id", "id").agg(F.count("*").alias("missing"))
    facts = first.drop("after").join(answers, ["conv_id", "id"], "left").join(level, ["conv_id", "id"], "left").join(missing, ["conv_id", "id"], "left")
    found = parts.join(facts, ["conv_id", "id"], "left")
    is_call, is_result = F.col("part") == "call", F.col("part") == "result"
    own = is_call & (F.col("called") == at)
    linked = F.when(own, F.coalesce(F.col("answered") > F.col("called"), F.lit(False))).when(is_result, F.coalesce(F.col("called") < at, F.lit(False)))
    more = [
        F.when(is_call & F.col("id").isNotNull() & F.col("called").isNotNull() & (F.col("called") != at), F.lit("id is taken")),
        F.when(is_result & F.col("id").isNotNull() & ~linked, F.lit("no call before it")),
        F.when(own & F.col("level").isNull(), F.lit("waits for itself")),
        F.when(own & (F.col("missing") > 0), F.lit("waits for a call that is not there")),
    ]
    problems = F.concat("problems", F.filter(F.array(*more), lambda x: x.isNotNull()))
    return found.select("conv_id", "turn", "place", "part", "id", F.when(own, F.col("level")).alias("level"), linked.alias("linked"), problems.alias("problems"), "json")
