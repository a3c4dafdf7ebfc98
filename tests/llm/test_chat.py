import json

from strandloom.llm import chat

SCHEMAS = {"add": {"a": "integer", "b": "number", "note?": "string"}, "find": {"q": "string", "tags": "array"}}


def call(id_, name, arguments, after=None):
    return {"id": id_, "name": name, "arguments": arguments} | ({"after": after} if after else {})


def test_linking_order_and_validation(spark):
    rows = [
        ("c1", 0, "system", "Be brief."),
        ("c1", 1, "user", 'He said "hi"\n\tand left'),
        ("c1", 2, "assistant", json.dumps({"content": None, "tool_calls": [call("y", "find", {"tags": ["t"], "q": "é"}), call("x", "add", {"b": 2.5, "a": 1})]})),
        ("c1", 3, "tool", json.dumps({"tool_call_id": "x", "content": "3.5"})),
        ("c1", 4, "assistant", json.dumps({"tool_calls": [call("z", "add", {"a": "1", "b": 2}, ["x"])]})),
        ("c1", 5, "tool", json.dumps({"tool_call_id": "z", "content": "no"})),
        ("c1", 6, "tool", json.dumps({"tool_call_id": "lost", "content": "?"})),
        ("c2", 0, "tool", json.dumps({"tool_call_id": "x", "content": "other"})),
        ("c2", 1, "assistant", json.dumps({"tool_calls": [call("p", "nope", {}, ["q"]), call("q", "add", {"a": 1, "b": 1}, ["p"])]})),
        ("c2", 2, None, None),
        ("c2", 2, None, None),
        (None, None, "user", "{not json"),
    ]
    found = chat.format_chats(spark.createDataFrame([(*r, 1) for r in rows], "conv_id string, turn int, role string, text string, row int"), SCHEMAS).collect()
    assert len(found) == len(rows)
    at = {(r.conv_id, r.turn): r for r in found}
    assert (at["c1", 2].linked, at["c1", 2].valid, at["c1", 2].depth) == (False, True, 0)
    assert (at["c1", 3].linked, at["c1", 3].follows, at["c1", 3].depth, at["c1", 3].valid) == (True, 2, 1, True)
    assert (at["c1", 4].depth, at["c1", 4].valid, at["c1", 5].depth) == (2, False, 3)
    assert at["c1", 6].linked is False and at["c2", 0].linked is False
    assert at["c2", 1].depth is None and at["c2", 1].valid is False
    for (conv, turn), r in at.items():
        assert r.line == json.dumps(json.loads(r.line), sort_keys=True, separators=(",", ":"), ensure_ascii=False), (conv, turn)
    assert json.loads(at["c1", 2].line)["tool_calls"] == [{"arguments": {"a": 1, "b": 2.5}, "id": "x", "name": "add"}, {"arguments": {"q": "é", "tags": ["t"]}, "id": "y", "name": "find"}]
    assert json.loads(at["c1", 1].line) == {"content": 'He said "hi"\n\tand left', "role": "user"} and json.loads(at[None, None].line)["content"] == "{not json"


def test_nothing_is_lost_and_numbers_have_one_form(spark):
    wrong = json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": "a=1", "why": [1, {"z": 1, "b": None}]}, {"id": "b", "name": "add", "arguments": '{"b":1e2,"a":1.0}'}], "content": {"k": [1]}, "name": "me", "role": "other"})
    numbers = '{"tool_call_id":"a","content":[1.0,1e2,1.50,1.5e0,12345678.9,1.23456789e7,10000000,1e7,-0.0,1e-7,0.0000001,"1.0 and 1E5","q\\" 2.0",123456789012345678901234567890],"extra":{"b":1,"a":2.0}}'
    twice = '{"tool_calls":[{"id":"x","id":"y"}]}'
    rows = [(1, 0, "assistant", wrong), (1, 1, "tool", numbers), (1, 2, None, json.dumps({"tool_calls": [call("n", "find", {"q": "x" * 20_000})]})), (1, 3, "user", twice), (1, 4, "tool", json.dumps({"tool_call_id": "b"})), (1, 5, "user", "word " * 40_000)]
    found = {r.turn: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), SCHEMAS).collect()}
    assert found[0].line == '{"content":{"k":[1]},"name":"me","role":"assistant","tool_calls":[{"arguments":"a=1","id":"a","name":"add","why":[1,{"b":null,"z":1}]},{"arguments":{"a":1,"b":100},"id":"b","name":"add"}]}'
    assert (found[0].valid, found[0].linked, found[1].follows, found[4].depth) == (False, True, 0, 1)
    assert found[1].line == '{"content":[1,100,1.5,1.5,12345678.9,12345678.9,10000000,10000000,0,0.0000001,0.0000001,"1.0 and 1E5","q\\" 2.0",123456789012345678901234567890],"extra":{"a":2,"b":1},"role":"tool","tool_call_id":"a"}'
    assert found[2].call_ids == ["n"] and found[2].line.startswith('{"content":null,"role":null,"tool_calls":[{"arguments":{"q":"xxx') and found[2].valid is False
    assert json.loads(found[3].line) == {"content": twice, "role": "user"} and json.loads(found[4].line)["content"] is None
    assert json.loads(found[5].line)["content"] == "word " * 40_000


def test_the_plan_is_native_and_hashes(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(1, 1, "assistant", "b")] * 2
    plan = chat.format_chats(chat.as_calls(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), chat.SCHEMAS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "shuffle_hash" in plan


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.as_calls(empty), chat.SCHEMAS).count() == 0
    rows = [(1, 0, "user", "a")] * 3 + [(1, 1, "assistant", "b")] * 2
    found = chat.format_chats(chat.as_calls(spark.createDataFrame(rows, empty.schema)), chat.SCHEMAS).collect()
    assert len(found) == 5 and all(r.linked and r.valid for r in found)
