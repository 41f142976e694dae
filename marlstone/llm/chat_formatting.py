"""Chat formatting: tool calls linked to their results, in order, checked and in canonical JSON.

1. Every turn is read as events: messages, calls (with identifier, tool name and arguments) and
   results (with the identifier of their call). Arguments are checked against the tool's schema.
2. Calls and results are hash-joined by (conversation, identifier). The first call and the first
   result of an identifier are linked; a call without result is `unanswered`, a result without call
   `orphan`, later ones with a used identifier `duplicate`.
3. Events get a topological order: (level, depth, turn, sub) ascends within a conversation so that a
   result stands behind its call, and a call behind the results of the calls that its arguments refer
   to. Calls that wait for others are peeled: one is placed when all that it refers to are. A task
   peels a range of a conversation's turns of about PART_CALLS calls as far as it can; what waits for
   another range is tried again when that is placed. So the rounds follow the ranges that a chain crosses, not
   its calls: one round for a conversation of a single range. Calls that are never placed wait for
   themselves or for such; they are `cyclic` and keep the place of their turn.
4. Each event is serialised as canonical JSON: keys sorted, no spaces, no escapes but those needed.
   `conversations` puts them together, in pieces of bounded length.

A conversation is never gathered in one task: events stay rows, ordered by their columns.

Two protocols. `tools`: an assistant's text that is a JSON object with a list `tool_calls` of {id,
name, arguments} holds calls; a turn of role `tool` whose text is a JSON object with `tool_call_id`
is a result. `turns`, for tables without tool records: a user's turn is a call of the tool `reply`
named by its turn number, and an assistant's turn is the result of the turn before it. `tool_records`
makes tool records of such a table, with all that can go wrong in them.

Defined results: a null text is an empty one; a null role is `unknown`. Events of a null
conv_id form a conversation of their own; a null turn comes first, as turn -1. Repeated rows are
events of their own, the later ones `duplicate` if they are calls or results. Text that should be
JSON and is not, or is nested too deeply, is a message with an error. Empty tables give an empty result.
Other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.runtime import hinted, materialize, ship
from marlstone.operators.ranking import ranked

#: The tool of the `turns` protocol.
REPLY = {"reply": {"type": "object", "properties": {"prompt": {"type": "string", "minLength": 1}}, "required": ["prompt"], "additionalProperties": False}}

#: The tool of `tool_records`.
DIALOGUE = {
    "reply": {
        "type": "object",
        "properties": {"after": {"type": "array", "items": {"type": "string"}}, "prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0, "maximum": 1_000_000}},
        "required": ["prompt", "turn"],
        "additionalProperties": False,
    }
}
#: Calls of a range of turns that a task peels, about.
PART_CALLS = 50_000
#: Events of a piece of a serialised conversation.
PIECE_EVENTS = 1_000

EVENT = "conv_id long, turn long, sub int, kind string, role string, call_id string, name string, refs array<string>, valid boolean, error string, json string"
_TYPES = {
    "object": dict,
    "array": list,
    "string": str,
    "boolean": bool,
    "integer": int,
    "number": (int, float),
    "null": type(None),
}


def canonical(value: Any) -> str:
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    return text.encode("utf-8", "replace").decode()  # a lone surrogate becomes a question mark


def _constant(name: str) -> Any:
    raise ValueError(f"{name} is no JSON")


def parsed(text: str) -> Any:
    try:
        return json.loads(text, parse_constant=_constant)
    except (ValueError, RecursionError):
        return None


def schema_error(value: Any, schema: Mapping, at: str = "$") -> str | None:
    """The first way in which value breaks schema (a subset of JSON Schema), or None."""
    kind = schema.get("type")
    if kind and (not isinstance(value, _TYPES[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return f"{at}: not of type {kind}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return f"{at}: length"
    if isinstance(value, (int, float)) and not isinstance(value, bool) and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: range"
    if isinstance(value, list) and "items" in schema:
        return next(filter(None, (schema_error(x, schema["items"], f"{at}[{i}]") for i, x in enumerate(value))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", ()):
            if k not in value:
                return f"{at}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if found := schema_error(value[k], known[k], f"{at}.{k}"):
                    return found
            elif schema.get("additionalProperties", True) is False:
                return f"{at}.{k}: unknown"
    return None


def references(value: Any, prefix: str = "$call:") -> list[str]:
    """Identifiers that strings anywhere in value refer to, as in "$call:7"."""
    todo, found = [value], set()
    while todo:
        x = todo.pop()
        if isinstance(x, str) and x.startswith(prefix):
            found.add(x.removeprefix(prefix))
        elif isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            todo += x
    return sorted(found)


def _call(call_id: Any, name: Any, arguments: Any, schemas: Mapping) -> tuple:
    if isinstance(arguments, str):
        arguments = parsed(arguments)
    call_id = None if call_id is None else str(call_id)
    if name not in schemas:
        error = "unknown tool"
    else:
        error = schema_error(arguments, schemas[name])
    if call_id is None:
        error = error or "no identifier"
    body = {"role": "assistant", "tool_call": {"id": call_id, "name": name, "arguments": arguments}}
    return "call", "assistant", call_id, None if name is None else str(name), references(arguments), error, body


def _result(call_id: Any, content: Any) -> tuple:
    call_id = None if call_id is None else str(call_id)
    return "result", "tool", call_id, None, [], None if call_id is not None else "no identifier", {"role": "tool", "tool_call_id": call_id, "content": content}


def _message(role: str, content: Any, error: str | None = None) -> tuple:
    return "message", role, None, None, [], error, {"role": role, "content": content}


def read_turn(role: str, turn: int, text: str, schemas: Mapping, protocol: str) -> list[tuple]:
    """(kind, role, call_id, name, refs, error, body) of the events of a turn."""
    if protocol == "turns":
        if role == "user":
            return [_call(turn, "reply", {"prompt": text}, schemas)]
        if role == "assistant":
            return [_result(turn - 1, text)]
        return [_message(role, text)]
    if role == "tool":
        value = parsed(text)
        if isinstance(value, dict) and "tool_call_id" in value:
            return [_result(value["tool_call_id"], value.get("content"))]
        return [_message(role, text, "not a tool result")]
    if role == "assistant" and text.lstrip()[:1] == "{":
        value = parsed(text)
        if isinstance(value, dict) and isinstance(value.get("tool_calls"), list):
            said = [_message(role, value["content"])] if value.get("content") is not None else []
            return said + [_call(c.get("id"), c.get("name"), c.get("arguments"), schemas) if isinstance(c, dict) else _message(role, c, "not a call") for c in value["tool_calls"]]
    return [_message(role, text)]


def events(turns: DataFrame, schemas: Mapping[str, Mapping], protocol: str) -> DataFrame:
    """The events of turns (conv_id, turn, role, text), checked and serialised."""
    ship(turns.sparkSession)
    types = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, pa.list_(pa.string()), pa.bool_(), pa.string(), pa.string()]
    names = [f.split()[0] for f in EVENT.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                turn, role, text = -1 if turn is None else turn, "unknown" if role is None else role, text or ""
                for sub, (kind, who, call_id, name, refs, error, body) in enumerate(read_turn(role, turn, text, schemas, protocol)):
                    try:
                        line = canonical(body)
                    except (ValueError, RecursionError):
                        error, line = "not serialisable", canonical({"role": who, "content": text})
                    rows.append((conv, turn, sub, kind, who, call_id, name, refs, error is None, error, line))
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    picked = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return picked.mapInArrow(read, EVENT)


def tool_records(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with tool records as texts, by rules on conversation and turn
    s = conv_id + turn: a user's turn is a call `c<turn>` that refers to the call two turns before (but if
    5 divides s), at times to the one two turns behind it (s mod 7 is 3); its identifier is at times that of
    an earlier call (s mod 13 is 12), its tool unknown (s mod 17 is 5), or its argument `turn` a string
    (s mod 19 is 7). An assistant's turn is the result of the turn before it, at times of an earlier one
    (s mod 11 is 10)."""
    s, t = F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.coalesce("turn", F.lit(0))

    def named(turn: Column) -> Column:
        return F.concat(F.lit("c"), turn.cast("string"))

    refs = F.array_compact(F.array(F.when((t >= 2) & (s % 5 != 0), F.concat(F.lit("$call:"), named(t - 2))), F.when(s % 7 == 3, F.concat(F.lit("$call:"), named(t + 2)))))
    number = F.when(s % 19 == 7, F.to_json(F.struct(t.cast("string").alias("x")))).otherwise(F.to_json(F.struct(t.alias("x"))))
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("x")))
    # Numbers and strings can't share a type: the objects are put together from their JSON.
    value = F.substr(number, F.lit(6), F.length(number) - 6)
    prompt = F.substr(said, F.lit(6), F.length(said) - 6)
    call = F.concat(
        F.lit('{"tool_calls":[{"id":"'), named(F.when(s % 13 == 12, t - 2).otherwise(t)), F.lit('","name":"'), F.when(s % 17 == 5, "forget").otherwise("reply"),
        F.lit('","arguments":{"after":'), F.to_json(refs), F.lit(',"prompt":'), prompt, F.lit(',"turn":'), value, F.lit("}}]}"),
    )
    result = F.concat(F.lit('{"tool_call_id":"'), named(F.when(s % 11 == 10, t - 3).otherwise(t - 1)), F.lit('","content":'), prompt, F.lit("}"))
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    return turns.select(
        "conv_id", "turn",
        F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role")).alias("role"),
        F.when(user, call).when(assistant, result).otherwise(F.col("text")).alias("text"),
    )


_PLACED = "conv string, call_id string, level long, depth int"


def _after(level: int, depth: int, answered: int | None) -> tuple[int, int]:
    """What a call waits for ends at the later of the other call's place and its result's."""
    return (answered, 1) if answered is not None and answered > level else (level, depth + 1)


def _peel(rows: pa.Table) -> pa.Table:
    """Places of the calls of a range whose references are all placed, there or (level, depth) before."""
    turn, answered, open_refs, waiting, need, placed = {}, {}, {}, {}, {}, {}
    for call, at, reply, dep, level, depth, dep_reply in zip(*(rows.column(c).to_pylist() for c in ("call_id", "turn", "answered", "dep", "level", "depth", "dep_answered")), strict=True):
        turn[call], answered[call] = at, reply
        open_refs.setdefault(call, 0)
        if level is not None:
            need[call] = max(need.get(call, (-1, -1)), _after(level, depth, dep_reply))
        else:
            open_refs[call] += 1
            waiting.setdefault(dep, []).append(call)
    ready = [c for c, n in open_refs.items() if not n]
    while ready:
        call = ready.pop()
        placed[call] = max((turn[call], 0), need.get(call, (-1, -1)))
        for other in waiting.get(call, ()):
            need[other] = max(need.get(other, (-1, -1)), _after(*placed[call], answered[call]))
            open_refs[other] -= 1
            if not open_refs[other]:
                ready.append(other)
    conv = rows.column("conv")[0].as_py()
    columns = [[conv] * len(placed), list(placed), [p[0] for p in placed.values()], [p[1] for p in placed.values()]]
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
    return pa.table({n.split()[0]: pa.array(c, k) for n, c, k in zip(_PLACED.split(", "), columns, kinds, strict=True)})


def _ranges(wants: DataFrame, start: DataFrame, part_calls: int) -> DataFrame:
    """conv, call_id, turn, answered, part of the calls that refer to others: ranges of about part_calls
    references, cut by the rank of the calls, so neither a late turn nor many calls of one turn fill one."""
    sizes = wants.groupBy("conv", "call_id").agg(F.count(F.lit(1)).alias("refs")).groupBy("conv")
    sizes = hinted(materialize(sizes.agg(F.ceil(F.sum("refs") / part_calls).alias("parts"), F.count(F.lit(1)).alias("callers")), "ranges"), 64)
    callers = start.join(wants.select("conv", "call_id"), ["conv", "call_id"], "left_semi")
    placed = ranked(callers, ["conv"], ["turn", "call_id"], "nth").join(sizes, "conv")
    part = F.floor((F.col("nth") - 1) * F.col("parts") / F.col("callers")).alias("part")
    return placed.select("conv", "call_id", "turn", "answered", part)


def _levels(calls: DataFrame, answers: DataFrame, part_calls: int = PART_CALLS) -> DataFrame:
    """conv, call_id, level, depth, cyclic of linked calls that refer to others, directly or not."""
    wants = calls.select("conv", "call_id", F.explode("refs").alias("dep"))
    wants = materialize(wants.join(calls.select("conv", F.col("call_id").alias("dep")), ["conv", "dep"], "left_semi"), "references")
    start = calls.join(answers.select("conv", "call_id", F.col("turn").alias("answered")), ["conv", "call_id"], "left").select("conv", "call_id", "turn", "answered")
    if not wants.limit(1).count():
        return start.select("conv", "call_id", F.col("turn").alias("level"), F.lit(0).alias("depth"), F.lit(False).alias("cyclic")).where("false")
    start = materialize(start, "calls")
    waits = wants.join(_ranges(wants, start, part_calls), ["conv", "call_id"])
    waits = materialize(waits.join(start.select("conv", F.col("call_id").alias("dep"), F.col("turn").alias("dep_turn"), F.col("answered").alias("dep_answered")), ["conv", "dep"]), "waits")
    # A call that refers to none has the place of its turn.
    idle = waits.select("conv", F.col("dep").alias("call_id"), "dep_turn").distinct().join(wants, ["conv", "call_id"], "left_anti")
    done = materialize(idle.select("conv", "call_id", F.col("dep_turn").alias("level"), F.lit(0).alias("depth")), "placed")
    found, left = None, waits
    while True:
        known = done.select("conv", F.col("call_id").alias("dep"), "level", "depth")
        tried = left.join(known, ["conv", "dep"], "left").select("conv", "part", "call_id", "turn", "answered", "dep", "level", "depth", "dep_answered")
        new = materialize(tried.groupBy("conv", "part").applyInArrow(_peel, _PLACED), "placed")
        found = new if found is None else found.unionByName(new)
        rest = materialize(left.join(new.select("conv", "call_id"), ["conv", "call_id"], "left_anti"), "waits")
        if not rest.limit(1).count() or not new.limit(1).count():
            break
        done, left = done.unionByName(new), rest
    stuck = rest.select("conv", "call_id", F.col("turn").alias("level"), F.lit(0).alias("depth"), F.lit(True).alias("cyclic")).distinct()
    return found.withColumn("cyclic", F.lit(False)).unionByName(stuck)


def format_turns(turns: DataFrame, schemas: Mapping[str, Mapping], protocol: str = "tools", part_calls: int = PART_CALLS) -> DataFrame:
    """conv_id, turn, sub, kind, role, call_id, status, valid, error, level, depth, json: a row for
    each event of turns (conv_id, turn, role, text)."""
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("none"))
    rows = materialize(events(turns, schemas, protocol).withColumns({"place": F.monotonically_increasing_id(), "conv": conv}), "events")
    first = F.struct("turn", "sub", "place")
    named = rows.where("kind <> 'message' and call_id is not null")
    keys = named.groupBy("kind", "conv", "call_id").agg(F.min(first).alias("first"))
    calls = named.where("kind = 'call'").join(keys.where("kind = 'call'").select(F.col("first.place").alias("place")), "place", "left_semi")
    calls = materialize(calls.select("place", "conv", "call_id", "turn", "refs"), "calls")
    answers = materialize(keys.where("kind = 'result'").select("conv", "call_id", F.col("first.place").alias("place"), F.col("first.turn").alias("turn")), "answers")
    levels = _levels(calls, answers, part_calls)
    pairs = (
        calls.select("conv", "call_id", F.col("place").alias("call_place"), F.col("turn").alias("call_turn"))
        .hint("shuffle_hash")
        .join(answers.select("conv", "call_id", F.col("place").alias("result_place")), ["conv", "call_id"], "full")
        .join(levels, ["conv", "call_id"], "left")
    )
    level, depth = F.coalesce("level", "call_turn"), F.coalesce("depth", F.lit(0))
    linked = F.col("call_place").isNotNull() & F.col("result_place").isNotNull()
    of_calls = pairs.where("call_place is not null").select(
        F.col("call_place").alias("place"), level.alias("level"), depth.alias("depth"),
        F.when(F.coalesce("cyclic", F.lit(False)), "cyclic").when(linked, "linked").otherwise("unanswered").alias("status"),
    )
    of_results = pairs.where("result_place is not null").select(
        F.col("result_place").alias("place"), level.alias("level"), (depth + F.when(linked, 1).otherwise(0)).alias("depth"), F.when(linked, "linked").otherwise("orphan").alias("status")
    )
    placed = of_calls.unionByName(of_results)
    out = rows.join(placed, "place", "left")
    behind = F.col("level") > F.col("turn")
    near = (F.col("level") == F.col("turn")) & F.col("depth").isNotNull()
    return out.select(
        "conv_id", "turn", "sub", "kind", "role", "call_id",
        F.coalesce("status", F.when(F.col("kind") == "message", "message").when(F.col("call_id").isNull(), F.when(F.col("kind") == "call", "unanswered").otherwise("orphan")).otherwise("duplicate")).alias("status"),
        "valid", "error",
        F.when(behind, F.col("level")).otherwise(F.col("turn")).alias("level"),
        F.when(behind | near, F.col("depth")).otherwise(0).cast("int").alias("depth"),
        "json",
    )


def conversations(formatted: DataFrame, piece_events: int = PIECE_EVENTS) -> DataFrame:
    """conv_id, piece, json: a conversation's events in order as canonical JSON arrays of at most
    piece_events events each, so that no conversation is gathered in one place."""
    keyed = formatted.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("conv"), "level", "depth", "turn", "sub", "json")
    placed = ranked(materialize(keyed, "events"), ["conv"], ["level", "depth", "turn", "sub", "json"], "nth")
    piece = F.floor((F.col("nth") - 1) / piece_events).cast("int").alias("piece")
    listed = placed.groupBy("conv_id", "conv", piece).agg(F.array_sort(F.collect_list(F.struct("nth", "json"))).alias("rows"))
    return listed.select("conv_id", "piece", F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["json"]), ","), F.lit("]")).alias("json"))


#: For the records that tool_records makes of a table without repeated turns, as the tables are. Paths of
#: references are followed one by one, which small conversations allow.
ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, turn, conv_id + turn AS s, coalesce(text, '') AS said, coalesce(role, 'unknown') AS role,
         CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations
), k AS (
  SELECT *, 'c' || CASE kind WHEN 'call' THEN turn - CASE WHEN s % 13 = 12 THEN 2 ELSE 0 END ELSE turn - CASE WHEN s % 11 = 10 THEN 3 ELSE 1 END END AS id,
         list_filter([CASE WHEN turn >= 2 AND s % 5 <> 0 THEN 'c' || (turn - 2) END, CASE WHEN s % 7 = 3 THEN 'c' || (turn + 2) END], lambda x: x IS NOT NULL) AS refs FROM t
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, kind, id ORDER BY turn) AS nth FROM k
), results AS (SELECT conv_id, id, turn AS answered FROM numbered WHERE kind = 'result' AND nth = 1
), calls AS (
  SELECT c.conv_id, c.id, c.turn, c.refs, r.answered FROM numbered c LEFT JOIN results r USING (conv_id, id) WHERE c.kind = 'call' AND c.nth = 1
), pairs AS (SELECT conv_id, id, unnest(refs) AS dep FROM calls
), wants AS (SELECT p.* FROM pairs p JOIN calls c ON c.conv_id = p.conv_id AND c.id = p.dep
), paths AS (
  SELECT conv_id, id, dep, [id, dep] AS seen, id = dep AS closed FROM wants
  UNION ALL
  SELECT p.conv_id, p.id, w.dep, list_append(p.seen, w.dep), list_contains(p.seen, w.dep) FROM paths p JOIN wants w ON w.conv_id = p.conv_id AND w.id = p.dep WHERE NOT p.closed
), cyclic AS (SELECT DISTINCT conv_id, id FROM paths WHERE closed
), free AS (SELECT c.* FROM calls c WHERE NOT EXISTS (SELECT 1 FROM cyclic y WHERE y.conv_id = c.conv_id AND y.id = c.id)
), places AS (
  SELECT conv_id, id, turn, answered, turn AS level, 0 AS depth FROM free
  UNION ALL
  SELECT f.conv_id, f.id, f.turn, f.answered, greatest(p.level, coalesce(p.answered, p.level), f.turn),
         CASE WHEN f.turn > greatest(p.level, coalesce(p.answered, p.level)) THEN 0 WHEN p.answered > p.level THEN 1 ELSE p.depth + 1 END
  FROM places p JOIN wants w ON w.conv_id = p.conv_id AND w.dep = p.id JOIN free f ON f.conv_id = w.conv_id AND f.id = w.id
), placed AS (
  SELECT c.conv_id, c.id, c.turn, c.answered, coalesce(m.place.level, c.turn) AS level, coalesce(m.place.depth, 0) AS depth, m.conv_id IS NULL AS cyclic
  FROM calls c LEFT JOIN (SELECT conv_id, id, max({'level': level, 'depth': depth}) AS place FROM places GROUP BY 1, 2) m USING (conv_id, id)
), joined AS (
  SELECT n.*, p.id IS NOT NULL AS called, p.answered, p.cyclic, CASE WHEN p.id IS NOT NULL AND nth = 1 THEN p.level END AS p_level,
         CASE WHEN p.id IS NOT NULL AND nth = 1 THEN p.depth + CASE kind WHEN 'result' THEN 1 ELSE 0 END END AS p_depth
  FROM numbered n LEFT JOIN placed p ON p.conv_id = n.conv_id AND p.id = n.id AND n.kind <> 'message'
), errors AS (
  SELECT *, CASE WHEN kind <> 'call' THEN NULL WHEN s % 17 = 5 THEN 'unknown tool' WHEN said = '' THEN '$.prompt: length' WHEN s % 19 = 7 THEN '$.turn: not of type integer' END AS error FROM joined
)
SELECT conv_id, turn, 0 AS sub, kind, CASE kind WHEN 'call' THEN 'assistant' WHEN 'result' THEN 'tool' ELSE role END AS role, CASE WHEN kind <> 'message' THEN id END AS call_id,
       CASE WHEN kind = 'message' THEN 'message' WHEN nth > 1 THEN 'duplicate' WHEN kind = 'call' AND cyclic THEN 'cyclic'
            WHEN kind = 'call' THEN CASE WHEN answered IS NULL THEN 'unanswered' ELSE 'linked' END WHEN called THEN 'linked' ELSE 'orphan' END AS status,
       error IS NULL AS valid, error,
       greatest(turn, coalesce(p_level, turn)) AS level, CASE WHEN p_level >= turn THEN p_depth ELSE 0 END::INTEGER AS depth,
       CASE kind
         WHEN 'call' THEN '{"role":"assistant","tool_call":{"arguments":{"after":[' || array_to_string(list_transform(refs, lambda x: '"$call:' || x || '"'), ',') || '],"prompt":' || to_json(said) || ',"turn":'
           || CASE WHEN s % 19 = 7 THEN '"' || turn || '"' ELSE turn::VARCHAR END || '},"id":"' || id || '","name":"' || CASE WHEN s % 17 = 5 THEN 'forget' ELSE 'reply' END || '"}}'
         WHEN 'result' THEN '{"content":' || to_json(said) || ',"role":"tool","tool_call_id":"' || id || '"}'
         ELSE '{"content":' || to_json(said) || ',"role":' || to_json(role) || '}' END AS json
FROM errors
"""
