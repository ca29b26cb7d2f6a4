"""Tool-call linking for chat data.

Messages are read into calls and results.  A message may carry them explicitly: an object with
``tool_calls`` (a list of ``id``, ``name`` or ``function``, ``arguments``, and ``after``, identifiers that
must come first) or with ``tool_call_id`` and ``content``, as the whole text or between
``<tool_call>``/``<tool_response>`` tags.  A plain message of anyone but the assistant is a call of the
tool ``reply``, identified by its turn; it comes after the one two turns before, if there is one, whose
reply stands between.  An assistant's plain message is the result of the turn before.

Calls and results meet in one hash join by conversation and identifier.  Results are reduced to the
first of each identifier, with their number, before the join, so repeated identifiers can't multiply
rows.  ``level`` orders calls topologically: 0 without dependencies, else one more than the highest
dependency.  Each conversation is ordered in one group; in conversations of more than ``LARGE`` calls, chains are
followed by pointer doubling, so their length costs its logarithm in rounds, and rounds over the calls with several
dependencies close the rest.  Arguments are checked against JSON schemas, and each row is serialised as canonical
JSON: sorted keys, no white space.

Cases: null text is an empty message; a null conversation is a value like any other; a message without a turn has no
neighbours: as a call it has no identifier, as an answer it answers nothing; a call or result without an identifier
is linked to nothing, and is a row of its own (results: with the number of equal ones); identifiers that are text and
identifiers of another kind differ; results without a call and calls without a result are kept; of repeated results
the first counts (ties: the least text); repeated calls are rows of their own with the level of their common
identifier; calls, arguments,
identifiers and dependencies of a wrong kind, and numbers that aren't finite, are invalid calls (results:
``null``); lone surrogates become U+FFFD; calls in a cycle, those behind one, and those that name a missing
dependency have no level; other columns, whatever their names, are never read; an empty table gives an
empty result; texts are read whole.
"""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridgauge.llm.common import drop_written, per_batch, written

TAG = re.compile(r"<(tool_call|tool_response)>")
REPLY = {"type": "object", "required": ["role", "text"], "properties": {"role": {"type": "string"}, "text": {"type": "string", "minLength": 1}}, "additionalProperties": False}
KINDS = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


SURROGATES = re.compile("[\ud800-\udfff]")


def plain(x: Any) -> Any:
    """``x`` with lone surrogates replaced, as UTF-8 has none."""
    if isinstance(x, str):
        return SURROGATES.sub("\ufffd", x)
    if isinstance(x, list):
        return [plain(y) for y in x]
    return {plain(k): plain(y) for k, y in x.items()} if isinstance(x, dict) else x


def canonical(x: Any) -> str:
    """Canonical JSON; ValueError if ``x`` has a number that isn't finite or is nested too deeply."""
    try:
        return json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
    except RecursionError as e:
        raise ValueError("too deep") from e


#: Calls of a conversation that are ordered in one group, at most.
LARGE = 2000


def key_of(x: Any) -> str | None:
    """What tells an identifier from others: its kind and its text; null for none."""
    return None if x is None else ("s" if isinstance(x, str) else "j") + as_id(x)


def as_id(x: Any) -> str | None:
    """An identifier as text."""
    if x is None:
        return None
    if isinstance(x, str):
        return plain(x)
    try:
        return canonical(x)
    except ValueError:
        return "not JSON"


def tagged(text: str) -> list[str]:
    """What stands between the tags; a tag that nothing ends has nothing."""
    out, at, absent = [], 0, set()
    while m := TAG.search(text, at):
        at = m.end()
        if m[1] not in absent:
            if (end := text.find(f"</{m[1]}>", at)) >= 0:
                out.append(text[at:end])
                at = end
            else:
                absent.add(m[1])
    return out


def _refuse(name: str):
    raise ValueError(f"{name} isn't JSON")


def read_json(text: str) -> Any:
    """The value; ValueError if the text isn't JSON."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError as e:
        raise ValueError("too deep") from e


def faults(x: Any, schema: dict, at: str = "$") -> list[str]:
    """Where ``x`` breaks the schema: type, enum, const, required, properties, items, lengths, bounds, pattern."""
    out = []
    if want := schema.get("type"):
        fits = False
        for t in [want] if isinstance(want, str) else want:
            if t in ("number", "integer"):
                fits |= isinstance(x, (int, float)) and not isinstance(x, bool) and (t == "number" or isinstance(x, int) or x.is_integer())
            else:
                fits |= isinstance(x, KINDS[t])
        if not fits:
            return [f"{at}: type"]
    if "enum" in schema and x not in schema["enum"]:
        out.append(f"{at}: enum")
    if "const" in schema and x != schema["const"]:
        out.append(f"{at}: const")
    if isinstance(x, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in x]
        for k in sorted(x):
            if k in own:
                out += faults(x[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(x, list):
        for k, y in enumerate(x):
            out += faults(y, schema.get("items", {}), f"{at}[{k}]")
    if isinstance(x, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(x, str) else ("minItems", "maxItems")
        if not schema.get(low, 0) <= len(x) <= schema.get(high, math.inf):
            out.append(f"{at}: length")
    if isinstance(x, str) and "pattern" in schema and not re.search(schema["pattern"], x):
        out.append(f"{at}: pattern")
    if isinstance(x, (int, float)) and not isinstance(x, bool) and not schema.get("minimum", -math.inf) <= x <= schema.get("maximum", math.inf):
        out.append(f"{at}: bounds")
    return out


def read_call(c: Any, schemas: dict[str, dict]) -> tuple:
    """(kind, identifier, its key, name, canonical arguments, valid, faults, dependencies, whether those may be missing) of one call."""
    if not isinstance(c, dict):
        return ("call", None, None, "", "null", False, ["$: no call"], [], False)
    own = c.get("function") if isinstance(c.get("function"), dict) else c
    name, arguments = own.get("name") or c.get("function") or "", own.get("arguments", {})
    after = c.get("after")
    wrong = [] if isinstance(name, str) else ["$: name"]
    if after is not None and not isinstance(after, list):
        wrong.append("$: after")
        after = None
    name = as_id(name)
    try:
        if isinstance(arguments, str):
            arguments = read_json(arguments)
        body = canonical(arguments)
        wrong += [plain(x) for x in faults(arguments, schemas[name])] if name in schemas else [f"no tool {name}"]
    except (ValueError, RecursionError):
        body = "null"
        wrong.append("$: not JSON")
    return ("call", as_id(c.get("id")), key_of(c.get("id")), name, body, not wrong, wrong, ["j" if a is None else key_of(a) for a in after or []], False)


def read_message(turn: int | None, role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, identifier, its key, name, canonical arguments or content, valid, faults, dependencies, whether those may be missing) of one message."""
    text = text or ""
    out: list[tuple] = []
    pieces = tagged(text) if "<tool_" in text else [text] if text.lstrip()[:1] == "{" else []
    for piece in pieces:
        try:
            x = read_json(piece)
        except ValueError:
            continue
        if not isinstance(x, dict):
            continue
        if "tool_calls" in x and x["tool_calls"] is not None:
            out += [read_call(c, schemas) for c in x["tool_calls"]] if isinstance(x["tool_calls"], list) else [read_call(None, schemas)]
        if "tool_call_id" in x:
            try:
                body = canonical(x.get("content"))
            except ValueError:
                body = "null"
            out.append(("result", as_id(x["tool_call_id"]), key_of(x["tool_call_id"]), None, body, None, None, None, None))
    if out:
        return out
    beside = (lambda d: None if turn is None else f"turn-{turn + d}")
    if role == "assistant":
        return [("result", beside(-1), key_of(beside(-1)), None, canonical(text), None, None, None, None)]
    arguments = {"role": role or "", "text": text}
    wrong = faults(arguments, schemas["reply"]) if "reply" in schemas else ["no tool reply"]
    return [("call", beside(0), key_of(beside(0)), "reply", canonical(arguments), not wrong, wrong, [] if turn is None else [key_of(beside(-2))], True)]


def read_messages(df: DataFrame, schemas: dict[str, dict], conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each call and result: conv, turn, nth, kind, id, id_key, name, body, valid, faults, after, optional (whether what it comes after may be missing)."""
    kind = dict(df.dtypes)[conv_col]
    df = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    texts = pa.list_(pa.string())

    def f(b: pa.RecordBatch) -> pa.RecordBatch:
        at, rows = [], []
        for k, (turn, role, text) in enumerate(zip(b.column("turn").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist())):
            for nth, x in enumerate(read_message(turn, role, text, schemas)):
                at.append(k)
                rows.append((nth, *x))
        cols = list(zip(*rows)) or [[]] * 10
        types = (pa.int32(), *[pa.string()] * 5, pa.bool_(), texts, texts, pa.bool_())
        take = pa.array(at, pa.int64())
        return pa.RecordBatch.from_arrays([b.column("conv").take(take), b.column("turn").take(take), *(pa.array(c, t) for c, t in zip(cols, types))], names=["conv", "turn", "nth", "kind", "id", "id_key", "name", "body", "valid", "faults", "after", "optional"])

    return per_batch(df, lambda: f, f"conv {kind}, turn long, nth int, kind string, id string, id_key string, name string, body string, valid boolean, faults array<string>, after array<string>, optional boolean")


def ordered(t: pa.Table) -> pa.Table:
    """(key, level) of the calls of one conversation that have dependencies: calls are taken when all they come after are."""
    keys = t.column("key").to_pylist()
    there, before, behind = set(keys), {}, {}
    for k, prefix, after, optional in zip(keys, t.column("prefix").to_pylist(), t.column("after").to_pylist(), t.column("optional").to_pylist()):
        mine = before.setdefault(k, set())
        mine.update(x for a in after or () if (x := prefix + a) in there or not optional)
    for k, mine in before.items():
        for x in mine:
            behind.setdefault(x, []).append(k)
    level = dict.fromkeys((k for k, mine in before.items() if not mine), 0)
    left = {k: len(mine) for k, mine in before.items()}
    ready = list(level)
    for k in ready:
        for x in behind.get(k, ()):
            left[x] -= 1
            if not left[x]:
                level[x] = 1 + max(level[y] for y in before[x])
                ready.append(x)
    said = [k for k, mine in before.items() if mine]
    return pa.table({"key": pa.array(said, pa.string()), "level": pa.array([level.get(k) for k in said], pa.int32())})


def levels(calls: DataFrame) -> DataFrame:
    """(key, level) of the calls with dependencies; the level is null in and behind a cycle or a missing identifier."""
    calls = calls.select("conv", "key", "after", "optional", "prefix")
    sizes, _ = written(calls.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > LARGE))
    n = sizes.count()
    if not n:
        return calls.groupBy("prefix").applyInArrow(ordered, "key string, level int")
    # At most one conversation in LARGE calls is that large; few of them are broadcast.
    sizes = sizes.select(F.col("prefix").alias("of_large"))
    sizes = F.broadcast(sizes) if n <= 10_000 else sizes
    same = calls["prefix"] == sizes["of_large"]
    return calls.join(sizes, same, "left_anti").groupBy("prefix").applyInArrow(ordered, "key string, level int").unionByName(levels_of_large(calls.join(sizes, same, "left_semi")))


def levels_of_large(calls: DataFrame) -> DataFrame:
    """(key, level) of the calls with dependencies; the level is null in and behind a cycle or an identifier that no call has.

    A call with one dependency points to it, and doubling the pointers brings each to the first call that isn't such a
    one, in as many rounds as the longest chain has binary digits.  Rounds over the calls with several dependencies
    follow, each adding the levels that it finds and nothing else.
    """
    spark = calls.sparkSession
    paths = []

    def table(df: DataFrame) -> DataFrame:
        got, path = written(df)
        paths.append(path)
        return got

    ids = calls.select("key").distinct()
    said = calls.where(F.size("after") > 0).select("key", "optional", "prefix", F.explode("after").alias("id")).select("key", "optional", F.concat("prefix", "id").alias("before"))
    held = said.join(ids.select(F.col("key").alias("before"), F.lit(True).alias("there")), "before", "left").where("there or not optional")
    edges = table(held.groupBy("key", "before").agg(F.max("there").alias("there")).withColumn("n", F.count("*").over(Window.partitionBy("key"))))
    # Chains: (key, to, far): ``to`` is ``far`` calls away; the end of a chain is no chained call, or missing, or in a cycle.
    chain = table(edges.where("n = 1").select("key", F.col("before").alias("to"), F.lit(1).cast("long").alias("far")))
    for _ in range(max(chain.count(), 1).bit_length() + 1):  # in a cycle a pointer moves for ever
        ahead = chain.select(F.col("key").alias("to"), F.col("to").alias("next"), F.col("far").alias("more"))
        chain = table(chain.join(ahead, "to", "left").select("key", F.coalesce("next", "to").alias("to"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("next").isNotNull().alias("moved")))
        moved = chain.where("moved").limit(1).count()
        chain = chain.drop("moved")
        if not moved:
            break
    ends = chain.join(chain.select(F.col("key").alias("to")).distinct(), "to", "left_anti").join(ids.select(F.col("key").alias("to")), "to", "left_semi")
    # Levels of calls with several dependencies, from those of calls without any.
    several = edges.where("n > 1").select("key", "before").join(ends.select(F.col("key").alias("before"), "to", "far"), "before", "left")
    open_ = table(several.select("key", F.coalesce("to", "before").alias("before"), F.coalesce("far", F.lit(0)).cast("long").alias("far")))
    base = table(ids.join(edges.select("key").distinct(), "key", "left_anti").join(open_.select(F.col("before").alias("key")).union(ends.select(F.col("to").alias("key"))).distinct(), "key", "left_semi").select("key", F.lit(0).cast("long").alias("level")))
    done = base
    while open_.count():
        known = open_.join(done.select(F.col("key").alias("before"), "level"), "before", "left")
        new = known.groupBy("key").agg(F.max(F.col("level") + F.col("far") + 1).alias("level"), F.bool_and(F.col("level").isNotNull()).alias("ready")).where("ready").select("key", "level")
        new = table(new)
        if not new.count():
            break
        done = done.unionByName(new)
        open_ = table(open_.join(new, "key", "left_anti"))
    of_chain = ends.join(done.select(F.col("key").alias("to"), "level"), "to").select("key", (F.col("level") + F.col("far")).alias("level"))
    found = done.join(edges.select("key").distinct(), "key", "left_semi").unionByName(of_chain)
    out, _ = written(edges.select("key").distinct().join(found, "key", "left").select("key", F.col("level").cast("int")))
    for path in paths:
        drop_written(spark, path)
    return out


def link(df: DataFrame, schemas: dict[str, dict] | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each call, and for each identifier of results without a call (``name`` is null).

    ``conv_col``, ``turn_col``, ``nth``, ``call_id``, ``name``, ``level``, ``valid``, ``faults``, ``linked``, ``n_results`` and ``json``.
    """
    schemas = {"reply": REPLY} if schemas is None else schemas
    said, _ = written(read_messages(df, schemas, conv_col, turn_col, role_col, text_col))
    prefix = F.coalesce(F.concat(F.length(F.col("conv").cast("string")).cast("string"), F.lit(":"), F.col("conv").cast("string"), F.lit("/")), F.lit("null/"))
    # Calls without an identifier get a key of their own; nothing can name it.
    own = F.concat(F.lit("n"), F.sha2(F.to_json(F.struct("turn", "nth", "body", "after")), 256))
    calls = said.where("kind = 'call'").withColumn("prefix", prefix).withColumn("key", F.concat("prefix", F.coalesce("id_key", own)))
    first = F.min(F.struct("turn", "nth", "body")).alias("first")
    results = said.where("kind = 'result'")
    named = results.where("id_key is not null").groupBy(F.col("conv").alias("r_conv"), F.col("id_key").alias("r_key")).agg(F.first("id").alias("r_id"), first, F.count("*").alias("n_results"))
    unnamed = results.where("id_key is null").groupBy(F.col("conv").alias("r_conv"), "turn", "nth", "body").agg(F.count("*").alias("n_results"))
    unnamed = unnamed.select("r_conv", F.struct("turn", "nth", "body").alias("first"), "n_results")
    same = F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("id_key") == F.col("r_key"))
    both = calls.where("id_key is not null").join(named.hint("shuffle_hash"), same, "full_outer").unionByName(calls.where("id_key is null"), True).unionByName(unnamed, True)
    both = both.join(levels(calls).withColumn("dependent", F.lit(True)), "key", "left")
    text = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    null = F.lit("null")
    as_json = F.concat(F.lit('{"arguments":'), F.coalesce("body", null), F.lit(',"id":'), F.when(F.col("call_id").isNull(), null).otherwise(text("call_id")), F.lit(',"name":'), F.when(F.col("name").isNull(), null).otherwise(text("name")), F.lit(',"result":'), F.coalesce("result", null), F.lit("}"))
    out = both.select(
        F.coalesce("conv", "r_conv").alias(conv_col), F.when(F.col("kind") == "call", F.col("turn")).otherwise(F.col("first.turn")).alias(turn_col), F.coalesce("nth", "first.nth").alias("nth"), F.coalesce("id", "r_id").alias("call_id"), "name",
        F.when(F.col("name").isNull(), F.lit(None)).when(F.col("dependent"), F.col("level")).otherwise(F.lit(0)).cast("int").alias("level"),
        F.coalesce("valid", F.lit(False)).alias("valid"), F.coalesce(F.array_join("faults", "; "), F.lit("no call")).alias("faults"),
        (F.col("id_key").isNotNull() & F.col("r_key").isNotNull()).alias("linked"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.col("first.body").alias("result"), "body",
    )
    return out.withColumn("json", as_json).drop("result", "body")


def oracle() -> str:
    """The query's rows in DuckDB SQL, for conversations of plain messages."""
    return """with c as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
      calls as (select conv_id, turn, 'turn-' || turn as id, '{"role":' || cast(to_json(coalesce(role, '')) as varchar) || ',"text":' || cast(to_json(text) as varchar) || '}' as body, text <> '' as valid
                from c where role is distinct from 'assistant'),
      numbered as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2 order by turn) as nth from (select distinct conv_id, turn from calls)),
      levels as (select conv_id, turn, row_number() over (partition by conv_id, turn % 2, turn - 2 * nth order by turn) - 1 as level from numbered),
      results as (select conv_id, 'turn-' || (turn - 1) as id, count(*) as n_results, min(turn) as turn, arg_min(cast(to_json(text) as varchar), turn) as body from c where role = 'assistant' group by all)
      select coalesce(c.conv_id, r.conv_id) as conv_id, coalesce(c.turn, r.turn) as turn, 0 as nth, coalesce(c.id, r.id) as call_id, case when c.id is not null then 'reply' end as name,
        l.level as level, coalesce(c.valid, false) as valid, case when c.id is null then 'no call' when c.valid then '' else '$.text: length' end as faults,
        c.id is not null and r.id is not null as linked, coalesce(n_results, 0) as n_results,
        sha256('{"arguments":' || coalesce(c.body, 'null') || ',"id":"' || coalesce(c.id, r.id) || '","name":' || case when c.id is null then 'null' else '"reply"' end || ',"result":' || coalesce(r.body, 'null') || '}') as json_sha256
      from calls c full outer join results r on c.conv_id = r.conv_id and c.id = r.id left join levels l on c.conv_id = l.conv_id and c.turn = l.turn"""
