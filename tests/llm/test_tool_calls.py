import json
import random
import time

from pinfold.llm.queries import QUERIES
from pinfold.llm.tool_calls import link_tool_calls

SCHEMA = "conv_id long, turn long, role string, text string, id string, position int"


def call(*calls):
    return json.dumps({"tool_calls": list(calls)})


def result(identifier, content):
    return json.dumps({"tool_call_id": identifier, "content": content})


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return [r.asDict() for r in link_tool_calls(df).orderBy("conv_id", "position").collect()]


def test_result_before_its_call_is_moved_behind_it(spark):
    got = linked(spark, [
        (1, 0, "user", "hi"),
        (1, 1, "tool", result("c1", {"b": 1, "a": [2]})),
        (1, 2, "assistant", call({"id": "c1", "name": "search", "arguments": {"query": "q"}})),
        (1, 3, "assistant", "done"),
    ])
    assert [r["turn"] for r in got] == [0, 2, 1, 3]
    assert [r["status"] for r in got] == ["ok", "ok", "linked", "ok"]
    assert got[1]["n_answered"] == 1 and got[1]["n_invalid"] == 0
    assert got[2]["message"] == '{"content":{"a":[2],"b":1},"role":"tool","tool_call_id":"c1"}'
    assert got[1]["message"] == '{"role":"assistant","tool_calls":[{"arguments":{"query":"q"},"id":"c1","name":"search"}]}'


def test_citations_order_calls_and_cycles_are_flagged(spark):
    got = linked(spark, [
        (1, 0, "assistant", call({"id": "b", "name": "fetch", "arguments": {"url": "$ref:a"}})),
        (1, 1, "assistant", call({"id": "a", "name": "search", "arguments": '{"query": "z"}'})),
        (1, 2, "tool", result("a", "r")),
        (1, 3, "tool", result("b", "s")),
        (2, 0, "assistant", call({"id": "x", "name": "fetch", "arguments": {"url": "$ref:y"}})),
        (2, 1, "tool", result("x", 1)),
        (2, 2, "assistant", call({"id": "y", "name": "fetch", "arguments": {"url": "$ref:x"}})),
        (2, 3, "tool", result("y", 1)),
    ])
    assert [r["turn"] for r in got if r["conv_id"] == 1] == [1, 2, 0, 3]
    two = [r for r in got if r["conv_id"] == 2]
    assert [r["status"] for r in two] == ["cyclic"] * 4 and [r["turn"] for r in two] == [0, 1, 2, 3]


def test_arguments_are_validated(spark):
    got = linked(spark, [
        (1, 0, "assistant", call(
            {"id": "1", "name": "search", "arguments": {"limit": "3"}},
            {"id": "2", "name": "dance", "arguments": {}},
            {"id": "3", "name": "run", "arguments": [1]},
            {"id": "4", "name": "run", "arguments": {"code": "x", "timeout": 1.5, "z": None}},
            {"id": "5", "name": "run", "arguments": {"code": "x"}},
        )),
    ])
    assert got[0]["n_calls"] == 5 and got[0]["n_invalid"] == 4
    assert got[0]["problems"] == sorted(["missing query", "type of limit", "unknown tool", "arguments are not an object", "unknown z"])


def test_orphans_duplicates_nulls_ties_and_long_texts(spark):
    long = "w " * 200_000
    got = linked(spark, [
        (1, 0, "tool", result("none", "a")),
        (1, 1, "assistant", call({"id": "c", "name": "run", "arguments": {"code": "1"}})),
        (1, 2, "tool", result("c", "a")),
        (1, 3, "tool", result("c", "b")),
        (1, 4, "assistant", call({"id": "c", "name": "run", "arguments": {"code": "2"}})),
        (2, 0, "user", None), (2, 0, "user", None), (2, None, None, ""), (2, 1, "user", long), (2, 2, "user", "{broken"),
        (None, 0, "tool", result("c", "a")), (None, 0, "tool", result("c", "a")),
    ])
    of = lambda c: [r for r in got if r["conv_id"] == c]
    assert [r["status"] for r in of(1)] == ["orphan", "ok", "linked", "duplicate", "duplicate"]
    assert [r["position"] for r in of(2)] == [1, 2, 3, 4, 5] and [r["turn"] for r in of(2)] == [None, 0, 0, 1, 2]
    assert json.loads(of(2)[3]["message"])["content"] == long
    assert [(r["position"], r["status"]) for r in of(None)] == [(1, "orphan"), (2, "orphan")]
    assert linked(spark, []) == []


def brute_order(rows):
    """Turns of one conversation by repeated search for a message that may come next."""
    calls, results, before = {}, {}, {}
    for k, (_, _, _, text) in enumerate(rows):
        body = json.loads(text)
        for c in body.get("tool_calls", []):
            calls[c["id"]] = k
        if "tool_call_id" in body:
            results[body["tool_call_id"]] = k
    for k, (_, _, _, text) in enumerate(rows):
        body = json.loads(text)
        cited = [v.removeprefix("$ref:") for c in body.get("tool_calls", []) for v in c["arguments"].values() if str(v).startswith("$ref:")]
        before[k] = {results[i] for i in cited if i in results} | ({calls[body["tool_call_id"]]} if "tool_call_id" in body and body["tool_call_id"] in calls else set())
    place = {}

    def at(k):
        if k not in place:
            place[k] = max([(rows[k][1], 0), *((a, d + 1) for a, d in map(at, before[k]))])
        return place[k]

    return [rows[k][1] for k in sorted(range(len(rows)), key=lambda k: (*at(k), rows[k][1]))]


def chain(n, cites=1):
    """Calls that each cite the results of the ones before, with their results."""
    rows = []
    for i in range(n):
        args = {f"a{c}": f"$ref:c{i - c}" for c in range(1, cites + 1) if i - c >= 0}
        rows += [("assistant", call({"id": f"c{i}", "name": "any", "arguments": args})), ("tool", result(f"c{i}", i))]
    return rows


def test_order_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(12):
        some = chain(rng.randint(2, 9), rng.randint(1, 3))
        turns = list(range(len(some)))
        rng.shuffle(turns)
        rows += [(conv, t, *m) for t, m in zip(turns, some)]
    got = linked(spark, rows)
    for conv in range(12):
        assert [r["turn"] for r in got if r["conv_id"] == conv] == brute_order([r for r in rows if r[0] == conv])


def test_long_chains_in_and_against_the_order_of_turns(spark):
    n = 1000
    rows = [(1, t, *m) for t, m in enumerate(chain(n, 2))] + [(2, 2 * n - t, *m) for t, m in enumerate(chain(n))]
    began = time.perf_counter()
    got = linked(spark, rows)
    assert time.perf_counter() - began < 90
    assert [r["turn"] for r in got if r["conv_id"] == 1] == list(range(2 * n))
    assert [r["turn"] for r in got if r["conv_id"] == 2] == list(range(2 * n, 0, -1))
    assert {r["status"] for r in got} == {"ok", "linked"}


def test_registered_query_over_a_table_with_calls(spark, tmp_path):
    rows = [(3, t, *m) for t, m in enumerate(chain(3))] + [(4, 0, "user", "hi"), (4, None, "tool", result("x", 1))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["op9_tool_call_linking"](spark, str(tmp_path)).orderBy("conv_id", "position").collect()
    assert [r.kind for r in got] == ["call", "result"] * 3 + ["result", "message"]
    assert [r.status for r in got] == ["ok", "linked"] * 3 + ["orphan", "ok"]
