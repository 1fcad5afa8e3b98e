import json

from mailspark.llm.chat import TOOLS, format_chat, tool_exchanges

from .conftest import CLASHING

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TOOLS_HERE = {"add": {"a": ("integer", True), "b": ("number", False), "name": ("string", False), "all": ("array", False), "o": ("object", False), "f": ("boolean", False)}}


def call(*calls, content=None):
    return json.dumps({"content": content, "tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def result(i, content):
    return json.dumps({"tool_call_id": i, "content": content})


def run(spark, rows, tools=TOOLS_HERE):
    got = format_chat(spark.createDataFrame(rows, SCHEMA), tools).collect()
    return sorted(got, key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["seq"]))


def test_order_and_status(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "tool", result("c2", "early")), (1, 2, "assistant", call(("c1", "add", {"a": 1}), ("c2", "add", {"a": 2}))),
        (1, 3, "tool", result("c1", "late")), (1, 4, "tool", result("c1", "again")), (1, 5, "tool", result("none", "lost")),
        (1, 6, "assistant", call(("c3", "add", {"a": 3}))), (1, 7, "assistant", "bye"),
    ]
    got = run(spark, rows)
    assert [r["seq"] for r in got] == list(range(1, 9))
    # The result of turn 1 follows its call of turn 2.
    assert [(r["turn"], r["status"]) for r in got] == [
        (0, "plain"), (2, "answered"), (1, "linked"), (3, "linked"), (4, "repeated"), (5, "orphan"), (6, "open"), (7, "plain")]


def test_canonical_json(spark):
    text = '{"tool_calls": [ {"name":"add","id":"x", "arguments": {"name": "é\\"\\n", "a": 1, "all": [2, {"z":1,"y":null}]}} ], "content":"ok"}'
    got = run(spark, [(1, 0, "assistant", text), (1, 1, "user", 'say "é"\n\t\\'), (1, 2, None, None)])
    assert got[0]["json"] == (
        '{"content":"ok","role":"assistant","tool_calls":[{"arguments":{"a":1,"all":[2,{"y":null,"z":1}],"name":"é\\"\\n"},"id":"x","name":"add"}]}')
    assert json.loads(got[1]["json"]) == {"content": 'say "é"\n\t\\', "role": "user"}
    assert got[2]["json"] == '{"content":null,"role":null}'
    for r in got:
        parsed = json.loads(r["json"])
        assert r["json"] == json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_arguments(spark):
    cases = [
        ({"a": 1, "b": 2.5, "name": "x", "all": [], "o": {}, "f": True}, []), ({"a": 1, "b": 2}, []), ({}, ["missing a"]),
        ({"a": "1"}, ["a is no integer"]), ({"a": 1, "b": "x", "c": 1}, ["b is no number", "unknown c"]), ({"a": None}, ["a is no integer"]),
        ({"a": 1, "all": {}, "o": []}, ["all is no array", "o is no object"]), ([1], ["arguments are no object"]), ("text", ["arguments are no object"]),
        ({"a": 1, "f": 0}, ["f is no boolean"]),
    ]
    rows = [(k, 0, "assistant", call((f"c{k}", "add", a))) for k, (a, _) in enumerate(cases)]
    rows.append((len(cases), 0, "assistant", call(("x", "other", {"a": 1}))))
    got = run(spark, rows)
    assert [r["errors"] for r in got] == [e for _, e in cases] + [["unknown tool"]]
    assert [r["valid"] for r in got] == [not e for _, e in cases] + [False]


def test_cases(spark, long_text):
    assert format_chat(spark.createDataFrame([], SCHEMA), TOOLS_HERE).collect() == []
    rows = [
        (None, None, None, None), (None, 1, "user", ""), (1, 0, "tool", "no json"), (1, 1, "assistant", "{broken"), (1, 2, "assistant", '{"tool_calls": []}'),
        (1, 3, "user", long_text), (1, 3, "user", long_text), (1, 4, "assistant", '{"tool_calls": [{"id": null, "name": null, "arguments": null}]}'),
        (1, 5, "tool", '{"tool_call_id": null}'),
    ]
    got = run(spark, rows)
    assert len(got) == len(rows) and [r["seq"] for r in got] == [1, 2, 1, 2, 3, 4, 5, 6, 7]
    assert [r["status"] for r in got] == ["plain"] * 7 + ["open", "plain"] and not got[7]["valid"]
    assert json.loads(got[5]["json"])["content"] == long_text


def test_extra_columns(spark):
    frame = spark.createDataFrame([(1, 0, "user", "x", *[None] * len(CLASHING.split(",")))], f"{SCHEMA}, {CLASHING}")
    assert format_chat(frame, {}).first()["json"] == '{"content":"x","role":"user"}'


def test_derived_exchanges(spark, sf):
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    got = format_chat(tool_exchanges(conversations), TOOLS).collect()
    statuses = {r["status"] for r in got}
    assert statuses == {"plain", "answered", "open", "linked"}
    by_conv = {}
    for r in got:
        by_conv.setdefault(r["conv_id"], []).append(r)
    for rows in by_conv.values():
        rows.sort(key=lambda r: r["seq"])
        seen = set()
        for r in rows:
            parsed = json.loads(r["json"])
            seen |= {c["id"] for c in parsed.get("tool_calls", [])}
            assert parsed["role"] != "tool" or parsed["tool_call_id"] in seen
    wrong = {r["conv_id"] for r in got if not r["valid"]}
    assert wrong == {r["conv_id"] for r in got if r["status"] in ("answered", "open") and (r["conv_id"] % 11 == 0 or r["conv_id"] % 13 == 0)}
