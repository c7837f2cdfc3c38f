import json
import re

import duckdb
import pytest

from orebody.llm import chat_tools as chat
from orebody.llm.queries import op4_chat_tools

FIELDS = "array<struct<field:string,type:string,required:boolean>>"


@pytest.fixture(scope="module")
def tools(spark):
    rows = [("search", [("q", "string", True), ("n", "integer", False), ("w", "number", False)]), ("ping", [])]
    return spark.createDataFrame(rows, f"name string, fields {FIELDS}")


def said(turn, *calls):
    return (1, turn, "assistant", json.dumps({"content": "x", "tool_calls": list(calls)}))


def call(i, name="search", after=None, **args):
    return {"id": i, "name": name, "arguments": args, "after": after or []}


def told(turn, i, content="ok"):
    return (1, turn, "tool", json.dumps({"tool_call_id": i, "content": content}))


def run(spark, tools, messages):
    df = spark.createDataFrame(messages, "conv long, turn long, role string, text string")
    out = chat.link(chat.calls_of(df), chat.results_of(df), tools)
    return {r.call_id: r for r in out.collect()}


def test_link_order_and_status(spark, tools):
    got = run(spark, tools, [
        (1, 0, "user", "hello"), said(1, call("c", q="3", after=["b"]), call("a", q="1"), call("b", q="2", after=["a"])), told(2, "b"), told(2, "a", "é\n"),
        said(5, call("d", q="x", after=["a", "zz", "e"])), said(7, call("e", q="y")), told(4, "e"), told(9, "lost"), (1, 11, "assistant", "plain text"), (1, 12, "assistant", None), (1, 13, "tool", None),
        told(20, "a", "again"), (None, 3, "tool", json.dumps({"tool_call_id": "a", "content": "no conversation"})),
    ][:-1])
    assert {k: r.status for k, r in got.items()} == {"a": "linked", "b": "linked", "c": "unanswered", "d": "unanswered", "e": "linked", "lost": "orphan", None: "orphan"}
    chain = sorted((r for r in got.values() if r.turn == 1), key=lambda r: (r.turn, r.level, r.pos))
    assert [r.call_id for r in chain] == ["a", "b", "c"]
    assert {k: r.order_errors for k, r in got.items() if r.order_errors} == {"d": 2}
    assert got["e"].early and not got["a"].early and got["a"].n_results == 2
    assert got["a"].json == '{"after":[],"arguments":{"q":"1"},"call_id":"a","name":"search","result":"é\\n","result_turn":2,"turn":1}'
    assert got["lost"].json is None and got["lost"].errors is None


def test_calls_without_an_identifier_are_rows_of_their_own(spark, tools):
    messages = [said(1, call(None, q="a"), call(None, q="b", after=["x", "x", "y"]), call("x", q="c")), told(2, None), told(2, None), told(2, "x")]
    messages += [(None, *said(1, call("x", q="d"))[1:]), (None, *said(1, call("x", q="e"))[1:])]
    df = spark.createDataFrame(messages, "conv long, turn long, role string, text string")
    out = chat.link(chat.calls_of(df), chat.results_of(df), tools).collect()
    calls = sorted((json.loads(r.json)["arguments"]["q"], r.status, r.n_calls, r.order_errors, r.errors) for r in out if r.json)
    assert calls == [("a", "unanswered", 1, 0, ""), ("b", "unanswered", 1, 2, ""), ("c", "linked", 1, 0, ""), ("d", "unanswered", 1, 0, ""), ("e", "unanswered", 1, 0, "")]
    assert sum(r.status == "orphan" and r.n_results == 1 for r in out) == 2 and len(out) == 7


def test_cycles_inside_a_message(spark, tools):
    got = run(spark, tools, [said(1, call("a", after=["b"], q="x"), call("b", after=["a"], q="x"), call("c", q="x"), call("d", after=["d"], q="x"))])
    assert got["c"].order_errors == 0 and got["c"].level == 0
    assert all(got[k].order_errors > 0 and got[k].level is None for k in "abd")


def test_arguments_are_checked(spark, tools):
    bad = {"id": "raw", "name": "search", "arguments": "[1]"}, {"id": "none", "name": "search"}, {"id": "text", "name": "ping", "arguments": "{}"}
    got = run(spark, tools, [said(1, call("ok", q="x", n=3, w=1), call("float", q="x", w=1.5), call("types", q=1, n="x", w=True), call("miss", n=1, z=1), call("tool", name="rm"), *bad)])
    assert {k: r.errors for k, r in got.items()} == {
        "ok": "", "float": "", "types": "type n,type q,type w", "miss": "missing q,unexpected z", "tool": "unknown tool", "raw": "not an object", "none": "not an object", "text": "",
    }


def test_canonical_json_sorts_keys(spark, tools):
    got = run(spark, tools, [(1, 1, "assistant", '{"tool_calls": [{"id": "k", "name": "search", "arguments": {"z": [1, {"b": null, "a": 2}], "q": "ü\\u00e9"}}]}')])
    assert '"arguments":{"q":"üé","z":[1,{"a":2,"b":null}]}' in got["k"].json


def test_repeats_nulls_and_empty(spark, tools):
    df = spark.createDataFrame([said(1, call("a", q="1")), said(1, call("a", q="1")), (None, *told(2, "a")[1:]), (None, *said(1, call("a", q="1"))[1:])], "conv long, turn long, role string, text string")
    out = chat.link(chat.calls_of(df), chat.results_of(df), tools).collect()
    assert sorted((str(r.conv), r.status, r.n_calls) for r in out) == [("1", "unanswered", 2), ("None", "orphan", 0), ("None", "unanswered", 1)]
    none = df.limit(0)
    assert chat.link(chat.calls_of(none), chat.results_of(none), tools).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id long, turn long, role string, text string")
    messages = chat.turns_as_messages(df)
    plan = chat.link(chat.calls_of(messages), chat.results_of(messages), chat.sentence_tools(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|NestedLoop|Cartesian", plan)


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    cur = con.execute(chat.ORACLE_SQL)
    names = [c[0] for c in cur.description]
    want = sorted(map(str, cur.fetchall()))
    mine = op4_chat_tools(spark, folder)
    assert sorted(names) == sorted(mine.columns)
    rows = mine.select(*names).collect()
    assert sorted(str(tuple(r)) for r in rows) == want
    assert len({r.errors for r in rows}) > 3 and len({r.level for r in rows}) > 2 and len({r.status for r in rows}) == 3


def test_a_long_chain_and_very_long_texts(spark, tools):
    calls = [call(f"c{i}", after=[f"c{i + 1}"], q="é" * 1000) for i in range(150)]
    got = run(spark, tools, [said(1, *calls), told(2, "c3", "x" * 2_000_000)])
    assert [got[f"c{i}"].level for i in range(150)] == list(range(149, -1, -1))
    assert {r.order_errors for i, r in got.items()} == {0} | ({1} if got["c149"].order_errors else set())
    assert len(got["c3"].json) > 2_000_000


def test_a_long_conversation_and_columns_of_other_names(spark, tools):
    rows = [(1, 2 * i, "assistant", json.dumps({"tool_calls": [call(f"c{i}", after=[f"c{i - 1}"] if i else [], q="x")]}), "x", 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string, level string, name int")
    out = chat.link(chat.calls_of(df), chat.results_of(df), tools).collect()
    assert len(out) == 2000 and {r.order_errors for r in out} == {0} and {r.errors for r in out} == {""}
