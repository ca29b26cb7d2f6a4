"""Order of calls against brute force, and calls that are broken in every way."""

import json
import random
import time

from pyspark.sql import functions as F

from gridgauge.llm import toolcalls

SCHEMA = "conv_id string, turn long, role string, text string"


def call(i, after=(), arguments=None):
    return {"id": i, "name": "add", "arguments": {} if arguments is None else arguments, "after": list(after)}


def brute(calls):
    """Level by (conversation, identifier); null in and behind cycles and missing identifiers."""
    deps = {}
    for conv, i, after in calls:
        deps.setdefault((conv, i), set()).update((conv, a) for a in after)
    level = {k: 0 for k, d in deps.items() if not d}
    while new := {k: 1 + max(level[a] for a in d) for k, d in deps.items() if k not in level and all(a in level for a in d)}:
        level |= new
    return {k: level.get(k) for k in deps}


def test_order_brute_force(spark):
    rng = random.Random(3)
    calls = [("chain", f"n{k}", [f"n{k - 1}"] if k else []) for k in range(1500)]
    calls += [("grid", f"n{k}", [f"n{k - d}" for d in (1, 7) if k >= d]) for k in range(12)]
    calls += [("cycle", "a", ["c"]), ("cycle", "b", ["a"]), ("cycle", "c", ["b"]), ("cycle", "d", ["a"]), ("cycle", "e", ["d", "f"]), ("cycle", "f", []), ("cycle", "self", ["self"])]
    for conv in (f"r{k}" for k in range(60)):
        n = rng.randint(1, 40)
        for k in range(n):
            calls.append((conv, f"n{k}", rng.sample([f"n{j}" for j in range(k)], min(k, rng.choice((0, 1, 1, 1, 2)))) + (["missing"] if rng.random() < 0.02 else []) + ([f"n{n - 1}"] if rng.random() < 0.01 else [])))
    calls += [("a/b", "c", []), ("a", "b/c", ["x"]), ("a", "x", []), ("twice", "t", ["u"]), ("twice", "t", []), ("twice", "u", [])]
    rows = [(conv, k, "assistant", json.dumps({"tool_calls": [call(i, after)]})) for k, (conv, i, after) in enumerate(calls)]
    got = toolcalls.link(spark.createDataFrame(rows, SCHEMA), {"add": {"type": "object"}}).collect()
    want = brute(calls)
    assert len(got) == len(calls) and all(r.level == want[r.conv_id, r.call_id] for r in got)
    assert max(x for x in want.values() if x is not None) == 1499 and None in want.values()


def test_plain_turns(spark):
    rows = [("a", t, "assistant" if t % 2 else "user", f"m{t}") for t in range(9)] + [("b", 0, "system", "s"), ("b", 1, "user", "u"), ("b", 2, "assistant", "r"), ("b", 3, "user", "v"), ("b", 7, "user", "w"), (None, 0, "user", "x"), (None, 2, "user", "y")]
    got = {(r.conv_id, r.turn): r.level for r in toolcalls.link(spark.createDataFrame(rows, SCHEMA)).collect() if r.name}
    assert got == {("a", 0): 0, ("a", 2): 1, ("a", 4): 2, ("a", 6): 3, ("a", 8): 4, ("b", 0): 0, ("b", 1): 0, ("b", 3): 1, ("b", 7): 0, (None, 0): 0, (None, 2): 1}


def test_broken_calls(spark):
    deep = "[" * 5000 + "]" * 5000
    texts = {
        "five": '{"tool_calls": 5}', "after": '{"tool_calls": [{"id":"x","name":"add","after":7}]}', "inf": '{"tool_calls": [{"id":"x","name":"add","arguments":{"a":1e999}}]}',
        "nan": '{"tool_calls": [{"id":"x","name":"add","arguments":"NaN"}]}', "item": '{"tool_calls": [3, null, {"id":"x","name":"add"}]}', "lone": r'{"tool_call_id":"c","content":"\ud800"}',
        "lone id": r'{"tool_calls":[{"id":"\ud800","name":"\udfff","after":["\ud800x"],"arguments":{"\ud800":"\udc00"}}]}', "result": '{"tool_call_id":{"a":[1]},"content":1e999}',
        "deep": '{"tool_calls":[{"id":"x","name":"add","arguments":' + deep + "}]}", "named": '{"tool_calls":[{"id":1.5,"name":["add"],"function":9}]}', "null": '{"tool_calls": null, "tool_call_id": null}',
        "open": "<tool_call>" * 20_000, "half": "<tool_call>{</tool_call><tool_response>", "digits": '{"tool_calls":[{"id":"x","name":"add","arguments":{"a":' + "9" * 6000 + "}}]}", "long": "x" * 2_000_000,
    }
    rows = [(k, 3, "tool", t) for k, t in texts.items()]
    got = {}
    for r in toolcalls.link(spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("clash")), {"add": {"type": "object"}, "reply": toolcalls.REPLY}).collect():
        got.setdefault(r.conv_id, []).append(r)
        json.loads(r.json)
    assert got.keys() == texts.keys() and len(got["item"]) == 3
    for k in ("five", "after", "inf", "nan", "lone id", "named"):
        assert [r.valid for r in got[k]] == [False], k
    assert [r.faults for r in got["inf"]] == ["$: not JSON"] and sorted(r.valid for r in got["item"]) == [False, False, True]
    assert json.loads(got["lone"][0].json)["result"] == "\ufffd" and got["lone id"][0].call_id == "\ufffd" and json.loads(got["result"][0].json)["result"] is None


def test_repeated_and_tied(spark):
    rows = [("a", 0, "user", "x")] * 3 + [("a", 1, "assistant", "z"), ("a", 1, "assistant", "y")]
    got = toolcalls.link(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 3 and {(r.n_results, json.loads(r.json)["result"], r.level) for r in got} == {(2, "y", 0)}


def linked(spark, rows):
    schema = "conv_id string, turn long, role string, text string"
    return [(r.turn, r.call_id, r.name, r.level, r.linked, r.n_results, json.loads(r.json)["result"]) for r in toolcalls.link(spark.createDataFrame(rows, schema), {"add": {"type": "object"}, "reply": toolcalls.REPLY}).collect()]


def test_null_turns(spark):
    rows = [("a", None, "user", "x"), ("a", 0, "user", "y"), ("a", 1, "assistant", "of zero"), ("a", None, "assistant", "of none"), ("a", None, "assistant", "of none"), ("a", 2, "user", "z")]
    want = [(None, None, "reply", 0, False, 0, None), (0, "turn-0", "reply", 0, True, 1, "of zero"), (2, "turn-2", "reply", 1, False, 0, None), (None, None, None, None, False, 2, "of none")]
    assert sorted(linked(spark, rows), key=repr) == sorted(want, key=repr)


def test_identifiers(spark):
    """Without an identifier nothing is linked; 5 isn't "5"."""
    say = lambda x: json.dumps(x)
    rows = [("a", 0, "assistant", say({"tool_calls": [call(None), call(None, ["s"]), call(5), call("5", [5]), call("s"), call(None, [None])]})), ("a", 1, "tool", say({"tool_call_id": None, "content": 1})), ("a", 2, "tool", say({"tool_call_id": 5, "content": 2})), ("b", 1, "tool", say({"tool_call_id": "5", "content": 3}))]
    want = [(0, None, "add", 0, False, 0, None), (0, None, "add", 1, False, 0, None), (0, "5", "add", 0, True, 1, 2), (0, "5", "add", 1, False, 0, None), (0, "s", "add", 0, False, 0, None), (0, None, "add", None, False, 0, None), (1, None, None, None, False, 1, 1), (1, "5", None, None, False, 1, 3)]
    assert sorted(linked(spark, rows), key=repr) == sorted(want, key=repr)


def test_large_conversations(spark, monkeypatch):
    """Groups and rounds give the same levels."""
    rng = random.Random(6)
    rows = []
    for conv in ("small", "large", "chain"):
        for k in range({"small": 12, "large": 40, "chain": 60}[conv]):
            after = [f"n{k - 1}"] if conv == "chain" and k else rng.sample([f"n{j}" for j in range(k)], min(k, rng.choice((0, 1, 2)))) + (["missing"] if rng.random() < 0.03 else [])
            rows.append((conv, k, "assistant", json.dumps({"tool_calls": [call(f"n{k}", after)]})))
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted((r.conv_id, r.call_id, str(r.level)) for r in toolcalls.link(df, {}).collect())
    monkeypatch.setattr(toolcalls, "LARGE", 20)
    assert sorted((r.conv_id, r.call_id, str(r.level)) for r in toolcalls.link(df, {}).collect()) == whole


def test_ladder(spark):
    """A thousand calls, each after two others, take no thousand rounds."""
    rows = [("a", k, "assistant", json.dumps({"tool_calls": [call(f"n{k}", [f"n{j}" for j in (k - 1, k - 2) if j >= 0])]})) for k in range(1000)]
    t = time.time()
    assert {r.call_id: r.level for r in toolcalls.link(spark.createDataFrame(rows, SCHEMA), {}).collect()} == {f"n{k}": k for k in range(1000)}
    assert time.time() - t < 30
