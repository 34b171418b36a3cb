"""Chat formatting: tool calls linked to results, put in order, validated and serialised.

Messages are rows of a conversation (conv_id, turn, role, text). An assistant's text may hold
calls, a JSON object {"tool_calls": [{"id", "name", "arguments"}]}; a tool's text a result, a
JSON object {"tool_call_id", "content"}. Calls and results are rows of their own tables; they
are hash-joined by (conversation, identifier), and a call depends on the results that its
arguments name as {"$result": id}.

Order. Messages with calls, results and calls are nodes of one graph: a result needs the message
of its call and the results that the call names; a message needs the results that its calls name,
but for those of its own calls, which are written with it. A node's place is its own turn or, if
later, the last place of what it needs; its level is one more than the highest it needs. By
(place, level, turn, role, text) a conversation reads in topological order, over any number of
turns and in chains of any length. Calls inside a message are written in order of their levels.
Nodes that depend on each other are settled in one task a group, with a few numbers a dependency;
nodes on a cycle share place and level. ``cyclic`` tells of calls that need their own results,
over however many steps, not of those that follow a cycle.

Validation checks arguments against the tool's JSON schema (type, required, properties,
additionalProperties, items, enum). Every message is one line of canonical JSON: keys sorted,
no blanks, characters unescaped. Every key of a call's, a result's and their message's object is
kept; a "role" in it that differs from the row's is kept as "_role". What is listed as a call but is
no object with an id is kept as it is, counts among the calls, is never valid and links to nothing.

Positions in a conversation are counted in two steps (sums over ranges of places, then rows
within a range), so that no conversation is sorted whole in one task.

Defined cases: a null text is an empty text; a null role is "unknown"; rows with a null
conv_id or turn keep them and sort first; equal rows of a conversation are one message with
``copies`` of them; a repeated identifier links to its first call; results without a call are
orphans and calls without a result open; an empty table gives an empty result. Text that is not
such JSON is plain, and so is JSON that other parsers may refuse: NaN, Infinity, numbers beyond
a double's range, nesting of more than ``DEEPEST`` levels. Escaped lone surrogates become U+FFFD.
"""

from __future__ import annotations

import functools
import json
import math
import re
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table
from .components import components

#: Schemas of the tools that calls are checked against; another name is "unknown".
SCHEMAS: dict[str, dict] = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "additionalProperties": False},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
    "fetch": {"type": "object", "required": ["url"], "properties": {"url": {"type": "string"}, "headers": {"type": "object"}}},
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}
SPAN = 1024
#: Dependencies settled in one task, or those of one group if it has more.
DEALT = 50_000
#: Levels of arrays and objects that a text may nest.
DEEPEST = 200
_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def fits(value: Any, schema: dict) -> bool:
    """Whether a value meets the part of JSON schema named in the module's text; a {"$result": id} fits anywhere."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return True
    kind = schema.get("type")
    if kind in _KINDS and not isinstance(value, _KINDS[kind]):
        return False
    if kind in ("integer", "number") and (isinstance(value, bool) or not isinstance(value, (int, float)) or kind == "integer" and value % 1 != 0):
        return False
    if "enum" in schema and value not in schema["enum"]:
        return False
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())) or schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(fits(v, known[k]) for k, v in value.items() if k in known)
    if isinstance(value, list) and "items" in schema:
        return all(fits(v, schema["items"]) for v in value)
    return True


def named_results(value: Any) -> list[str]:
    """The identifiers under {"$result": id}, wherever they stand."""
    found, rest = [], [value]
    while rest:
        x = rest.pop()
        if isinstance(x, dict) and set(x) == {"$result"}:
            found.append(str(x["$result"]))
        elif isinstance(x, (dict, list)):
            rest.extend(x.values() if isinstance(x, dict) else x)
    return found


def _nests_deep(value: Any) -> bool:
    layer = [value]
    for _ in range(DEEPEST):
        layer = [y for x in layer if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not layer:
            return False
    return any(isinstance(x, (dict, list)) for x in layer)


def _refused(name: str) -> None:
    raise ValueError(f"not JSON: {name}")


def _finite(digits: str) -> float:
    value = float(digits)
    return value if math.isfinite(value) else _refused(digits)


def _object(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text, parse_constant=_refused, parse_float=_finite)
        if not isinstance(found, dict) or text.count("[") + text.count("{") > DEEPEST and _nests_deep(found):
            return None
        if _SURROGATE.search(text):
            found = json.loads(json.dumps(found, ensure_ascii=False).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))
    except (ValueError, RecursionError):
        return None
    return found


PARSED = "struct<calls: array<struct<id: string, valid: boolean, needs: array<string>>>, result_of: string>"


def _read(role: str, text: str) -> tuple[str, dict]:
    """("calls", "result" or "plain", the text's object)."""
    found = _object(text) if role in ("assistant", "tool") else None
    if found is not None and role == "tool" and "tool_call_id" in found:
        return "result", found
    if found is not None and role == "assistant" and isinstance(found.get("tool_calls"), list) and found["tool_calls"]:
        return "calls", found
    return "plain", {}


def _call(call: Any) -> dict | None:
    """A call with id and name as strings and its arguments read, every further key as it is; none for what is not an object with an id."""
    if not isinstance(call, dict) or "id" not in call:
        return None
    arguments = call.get("arguments")
    if isinstance(arguments, str):
        arguments = _object(arguments) or {"": arguments}
    return call | {"id": str(call["id"]), "name": str(call.get("name")), "arguments": arguments}


def _parse(role: str, text: str, schemas: dict[str, dict]) -> dict:
    kind, found = _read(role, text)
    out = []
    for c in map(_call, found["tool_calls"] if kind == "calls" else ()):
        if c is None:
            out.append({"id": None, "valid": False, "needs": []})
        else:
            valid = c["name"] in schemas and fits(c["arguments"], schemas[c["name"]])
            out.append({"id": c["id"], "valid": valid, "needs": sorted(set(named_results(c["arguments"])))})
    return {"calls": out, "result_of": str(found["tool_call_id"]) if kind == "result" else None}


def parsed(schemas: dict[str, dict]):
    @F.pandas_udf(PARSED)
    def run(role: pd.Series, text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_parse(r, t, schemas) for r, t in zip(role, text, strict=True)], columns=["calls", "result_of"])

    return run


def _message(role: str, text: str, order) -> str:
    kind, found = _read(role, text)
    if kind == "plain":
        return canonical({"role": role, "content": text})
    message = found | {"role": role}
    if found.get("role", role) != role:
        message["_role"] = found["role"]
    if kind == "result":
        return canonical({"content": None} | message | {"tool_call_id": str(found["tool_call_id"])})
    return canonical(message | {"tool_calls": [_call(found["tool_calls"][k]) or found["tool_calls"][k] for k in order]})


def serialised():
    @F.pandas_udf("string")
    def run(role: pd.Series, text: pd.Series, order: pd.Series) -> pd.Series:
        return pd.Series([_message(*row) for row in zip(role, text, order, strict=True)], dtype=object)

    return run


def _later(*turns: int | None) -> int | None:
    return max((x for x in turns if x is not None), default=None)


def _settled(t: pa.Table) -> pa.Table:
    """Level, place and whether it is on a cycle, of each node of whole groups: strong components (Tarjan's), needs first."""
    place, needs = {}, {}
    for node, own, need, need_own in zip(*(t.column(c).to_pylist() for c in ("node", "own", "need", "need_own")), strict=True):
        place[node], place[need] = _later(place.get(node), own), _later(place.get(need), need_own)
        needs.setdefault(node, set()).add(need)
        needs.setdefault(need, set())
    seen, low, stack, held, level, cyclic = {}, {}, [], set(), {}, {}

    def enter(x: int) -> None:
        seen[x] = low[x] = len(seen)
        stack.append(x)
        held.add(x)
        path.append((x, iter(needs[x])))

    for root in needs:
        path: list = []
        if root not in seen:
            enter(root)
        while path:
            x, rest = path[-1]
            for y in rest:
                if y not in seen:
                    enter(y)
                    break
                if y in held:
                    low[x] = min(low[x], seen[y])
            else:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[x])
                if low[x] == seen[x]:
                    at = len(stack) - 1
                    while stack[at] != x:
                        at -= 1
                    group = stack[at:]
                    del stack[at:]
                    held.difference_update(group)
                    outside = {z for y in group for z in needs[y]}.difference(group)
                    top, last = 1 + max((level[z] for z in outside), default=0), _later(*(place[y] for y in group), *(place[z] for z in outside))
                    for y in group:
                        level[y], place[y], cyclic[y] = top, last, len(group) > 1 or y in needs[y]
    nodes = list(needs)
    return pa.table([pa.array(nodes, pa.int64()), pa.array([level[x] for x in nodes], pa.int64()), pa.array([place[x] for x in nodes], pa.int64()), pa.array([cyclic[x] for x in nodes], pa.bool_())], names=["node", "level", "place", "cyclic"])


def settle(links: DataFrame) -> DataFrame:
    """(node, level, place, cyclic) of links (node, own, need, need_own): a node of turn own comes after its need, of turn need_own.

    Nodes that are linked over any number of steps form a group; a group is settled in one task.
    """
    links = stored(links)
    n = links.count()
    if not n:
        return links.sparkSession.createDataFrame([], "node long, level long, place long, cyclic boolean")
    if n <= DEALT:  # one task has room for all groups
        dealt = links.withColumn("part", F.lit(0).cast("long"))
    else:
        groups = components(links.where("need <> node").select(F.col("node").alias("a"), F.col("need").alias("b")))
        dealt = links.join(groups.select(F.col("node").alias("g"), "label"), F.col("node") == F.col("g"), "left")
        dealt = dealt.select("node", "own", "need", "need_own", F.pmod(F.xxhash64(F.coalesce("label", "node")), F.lit(n // DEALT + 1)).alias("part"))
    return stored(dealt.groupBy("part").applyInArrow(_settled, "node long, level long, place long, cyclic boolean"))


def _link(rows: DataFrame, node: str, own: str | None, need: str, need_own: str | None) -> DataFrame:
    turn = lambda c: (F.lit(None) if c is None else F.col(c)).cast("long")
    return rows.select(F.col(node).alias("node"), turn(own).alias("own"), F.col(need).alias("need"), turn(need_own).alias("need_own"))


def format_chats(messages: DataFrame, schemas: dict[str, dict] = SCHEMAS, most_levels: int = 50) -> DataFrame:
    """One row a distinct message: conv_id, position, turn, role, message (canonical JSON), copies, and the states of its calls and result.

    ``most_levels`` is still taken, but nothing is cut at it.
    """
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    base = messages.select(F.col("conv_id").alias("conv"), "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base = base.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    base = stored(base.withColumn("p", parsed(schemas)("role", "text")).withColumn("row", F.monotonically_increasing_id()))
    calls = base.select("conv", "turn", "row", F.xxhash64("role", "text").alias("tie"), F.posexplode("p.calls").alias("pos", "c")).select("conv", "turn", "row", "tie", "pos", "c.*")
    first = calls.where("id is not null").groupBy("conv", "id").agg(F.min_by(F.struct("turn", "row", "needs"), F.struct("turn", "tie", "row", "pos")).alias("x"))
    first = first.select("conv", "id", "x.*")
    results = base.where("p.result_of is not null").select("conv", "turn", "row", F.col("p.result_of").alias("result_of"))
    # a result without a call can still be named: its identifier stands for a call without a message
    orphans = results.select("conv", F.col("result_of").alias("id")).distinct().join(first.select(F.col("conv").alias("c1"), F.col("id").alias("i1")), same("conv", "c1") & same("id", "i1"), "left_anti")
    first = first.unionByName(orphans, allowMissingColumns=True)
    first = stored(first.withColumn("call", -1 - F.monotonically_increasing_id()))  # messages are counted from 0, calls from -1
    of = first.select(F.col("conv").alias("c1"), F.col("id").alias("i1"), F.col("call").alias("of_call"), F.col("row").alias("of_row"), F.col("turn").alias("of_turn"), F.col("needs").alias("of_needs"))
    named = lambda rows: rows.join(of.drop("of_needs"), same("conv", "c1") & same("named", "i1"))

    # calls alone, for their levels and cycles
    needs = named(first.select("conv", F.col("call").alias("node"), F.explode("needs").alias("named"))).where("of_row is not null")
    ranks = settle(_link(needs, "node", None, "of_call", None)).select(F.col("node").alias("n"), "level", "cyclic")
    first = first.join(ranks, F.col("call") == F.col("n"), "left").select("conv", "id", F.coalesce("level", F.lit(1)).alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"))

    # messages, results and calls together, for the order
    linked = stored(results.join(of, same("conv", "c1") & same("result_of", "i1")).drop("c1", "i1", "result_of"))
    links = [
        _link(named(calls.select("conv", "turn", "row", F.explode("needs").alias("named"))).where("of_row is null or row <> of_row"), "row", "turn", "of_call", None),
        _link(linked.where("of_row is not null"), "row", "turn", "of_row", "of_turn"),
        _link(named(linked.select("conv", "turn", "row", F.explode("of_needs").alias("named"))), "row", "turn", "of_call", None),
        _link(linked, "of_call", None, "row", "turn"),
        _link(of.where("of_row is not null"), "of_call", None, "of_row", "of_turn"),
    ]
    order = settle(functools.reduce(DataFrame.union, links)).where("node >= 0").select(F.col("node").alias("m"), F.col("level").alias("m_level"), F.col("place").alias("m_place"))

    answered = results.groupBy(F.col("conv").alias("rc"), F.col("result_of").alias("ro")).agg(F.count("*").alias("n_results"))
    ranked = first.select(F.col("conv").alias("c2"), F.col("id").alias("i2"), "level", "cyclic")
    state = (
        calls.join(ranked, same("conv", "c2") & same("id", "i2"), "left").join(answered, same("conv", "rc") & same("id", "ro"), "left")
        .groupBy(F.col("row").alias("r2")).agg(F.count("*").alias("n_calls"), F.count_if("valid").alias("n_valid"), F.count("n_results").alias("n_answered"), F.bool_or("cyclic").alias("cyclic"),
             F.sort_array(F.collect_list(F.struct(F.coalesce("level", F.lit(1)).alias("level"), "pos"))).alias("order"))
    )
    met = linked.where("of_row is not null").select(F.col("row").alias("r1"), F.lit("linked").alias("result_state"))
    out = base.join(met, F.col("row") == F.col("r1"), "left").join(state, F.col("row") == F.col("r2"), "left").join(order, F.col("row") == F.col("m"), "left")
    out = out.withColumns({"place": F.coalesce("m_place", "turn"), "level": F.coalesce("m_level", F.lit(0))}).withColumn("range", F.floor(F.coalesce("place", F.lit(-1)) / SPAN))
    sizes = out.groupBy("conv", "range").agg(F.count("*").alias("c"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("conv").alias("oc"), F.col("range").alias("orange"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv", "range").orderBy(F.asc_nulls_first("place"), "level", "turn", "role", "text")
    placed = out.withColumn("k", F.row_number().over(within)).join(offsets, same("conv", "oc") & same("range", "orange"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    result_state = F.coalesce("result_state", F.when(F.col("p.result_of").isNotNull(), "orphan"), F.lit("none"))
    return placed.select(
        F.col("conv").alias("conv_id"), (F.col("offset") + F.col("k") - 1).cast("long").alias("position"), "turn", "role",
        serialised()("role", "text", "order.pos").alias("message"),
        F.col("copies").cast("long").alias("copies"), zero("n_calls"), zero("n_valid"), zero("n_answered"),
        result_state.alias("result_state"), F.coalesce("cyclic", F.lit(False)).alias("cyclic"),
    )


def op9_tool_chat(spark, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP9_SQL = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, count(*) AS copies FROM conversations GROUP BY ALL)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1)::BIGINT AS position, turn, role,
       '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}' AS message,
       copies::BIGINT AS copies, 0::BIGINT AS n_calls, 0::BIGINT AS n_valid, 0::BIGINT AS n_answered, 'none' AS result_state, false AS cyclic
FROM m
"""
