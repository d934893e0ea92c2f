"""Chat formatting against expectations written out and a plain-Python linker."""

import json
import random
from collections import Counter

from wordloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, call_id string, kind string, place string"


def table(spark, rows):
    """Messages with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def call(body):
    return f"<tool_call>{body if isinstance(body, str) else json.dumps(body)}</tool_call>"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


SCHEMAS = {"f": {"n": ("integer", True), "s": ("string", False), "o": ("object", False), "z": ("null", False), "a": ("array", False), "x": ("number", False), "b": ("boolean", False)}} | chat.SCHEMAS


def test_types_are_kept_and_checked(spark):
    good = {"n": 5, "s": "7", "o": {"k": [1, 2], "a": {"c": 1, "b": None}}, "z": None, "a": [], "x": -1.5e3, "b": True}
    bad = {"n": "5", "s": 7, "o": [1], "z": 0, "a": {}, "x": "1", "b": "true", "more": 1}
    bodies = [good, bad, {"n": 5.0}, {"n": 5.5}, {}, {"n": {"$result": "0"}, "s": {"$result": "0"}}]
    rows = [(1, i, "assistant", call({"id": str(i), "name": "f", "arguments": x})) for i, x in enumerate(bodies)]
    rows += [
        (1, 6, "assistant", call({"id": "6", "name": "f", "arguments": json.dumps({"n": 1})})),  # a string that holds JSON
        (1, 7, "assistant", call({"id": "7", "name": "f", "arguments": [1]})),
        (1, 8, "assistant", call({"id": "8", "name": "f"})),
        (1, 9, "assistant", call({"id": "9", "name": "nope", "arguments": {}})),
        (1, 10, "assistant", call('{"id": "10", "name": "f", "arguments": {"n": 1, "n": 2}}')),
        (1, 11, "assistant", call("{not json}")),
        (1, 12, "assistant", call({"id": 12, "arguments": {"n": 1}})),
    ]
    got = {r["turn"]: r for r in rows_of(chat.format_chats(table(spark, rows), SCHEMAS))}
    kinds = {"n": "integer", "s": "string", "o": "object", "z": "null", "a": "array", "x": "number", "b": "boolean"}
    wrong = [f"{k} isn't {v}" for k, v in sorted(kinds.items())] + ["unknown more"]
    expected = [[], wrong, [], ["n isn't integer"], ["missing n"], [], [], ["arguments aren't an object"], ["arguments aren't an object"], ["unknown tool"], ["arguments aren't an object", "unknown tool"], ["arguments aren't an object", "unknown tool"], ["unknown tool"]]
    assert [got[i]["problems"] for i in range(13)] == expected
    assert [got[i]["valid"] for i in range(13)] == [not e for e in expected]
    assert got[0]["message"] == '{"arguments":{"a":[],"b":true,"n":5,"o":{"a":{"b":null,"c":1},"k":[1,2]},"s":"7","x":-1500,"z":null},"call_id":"0","content":null,"kind":"call","level":0,"name":"f","role":"assistant","turn":0}'
    assert got[1]["arguments"] == '{"a":{},"b":"true","more":1,"n":"5","o":[1],"s":7,"x":"1","z":0}'
    assert got[5]["level"] == 1 and got[12]["call_id"] == "12" and got[11]["call_id"] is None


def test_strings_are_escaped_alike(spark):
    odd = "hi\x01\x1f\x0b\t\\ é\x7f \\u001f \"q\" 😀"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", call({"id": "a", "name": "reply", "arguments": {"text": odd}})), (1, 3, "tool", json.dumps({"id": "a", "content": {"k": [odd]}})), (1, 4, "system", odd)]
    got = rows_of(chat.format_chats(table(spark, rows)))
    plain = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert len(got) == 3
    for r in got:
        assert r["message"] == plain(json.loads(r["message"]))
    by = {r["kind"] + str(r["turn"]): json.loads(r["message"]) for r in got}
    assert by["call0"]["arguments"] == {"text": odd} and by["call0"]["content"] == odd
    assert by["call2"]["arguments"] == {"text": odd} and by["call2"]["content"] == {"k": [odd]}
    assert by["message4"]["content"] == odd and by["message4"]["role"] == "system"


def test_order_circles_repeats_and_nulls(spark):
    ref = lambda *ids: {"text": [{"$result": i} for i in ids]}
    rows = [
        (1, 0, "system", "be brief"),
        (1, 1, "assistant", "I look. " + call({"id": "a", "name": "reply", "arguments": ref("c")}) + " and " + call({"id": "b", "name": "reply", "arguments": {"text": "x"}})),
        (1, 2, "tool", json.dumps({"id": "b", "content": 7})),
        (1, 2, "tool", json.dumps({"id": "b", "content": 7})),
        (1, 3, "tool", json.dumps({"id": "b", "content": "late"})),
        (1, 4, "assistant", call({"id": "c", "name": "reply", "arguments": ref("b", "d")})),
        (1, 5, "assistant", call({"id": "c", "name": "reply", "arguments": {"text": "again"}})),
        (1, 5, "assistant", call({"id": "d", "name": "reply", "arguments": {"text": "y"}})),
        (1, 6, "tool", "no json"),
        (1, 7, "tool", json.dumps({"id": "zz", "content": None})),
        (2, 0, "assistant", call({"id": "e", "name": "reply", "arguments": ref("f")})),
        (2, 1, "assistant", call({"id": "f", "name": "reply", "arguments": ref("e")})),
        (2, 2, "assistant", call({"id": "g", "name": "reply", "arguments": ref("gone")})),
        (3, 0, "user", None),
        (3, 0, "user", None),
        (3, 1, "assistant", "hello"),
        (3, None, "user", "no turn"),
        (None, 0, "user", "no conversation"),
        (None, 1, "assistant", "no conversation"),
        (4, 0, None, "x" * 300_000),
        (4, 1, "narrator", ""),
    ]
    out = rows_of(chat.format_chats(table(spark, rows)))
    assert Counter((r["conv_id"], r["kind"]) for r in out) == {(1, "message"): 2, (1, "call"): 4, (1, "repeated"): 3, (1, "orphan"): 2, (2, "call"): 3, (3, "call"): 2, (3, "repeated"): 1, (None, "call"): 1, (None, "orphan"): 1, (4, "call"): 1, (4, "message"): 1}
    one = [(r["call_id"], r["kind"], r["level"], r["place"]) for r in out if r["conv_id"] == 1 and r["kind"] == "call"]
    assert one == [("b", "call", 0, 1), ("d", "call", 0, 5), ("c", "call", 1, 5), ("a", "call", 2, 5)]
    b = next(r for r in out if r["call_id"] == "b" and r["kind"] == "call")
    assert (b["linked"], b["result_turn"], b["content"]) == (True, 2, "7")
    assert sorted(((r["turn"], r["content"], r["arguments"]) for r in out if r["kind"] == "repeated" and r["conv_id"] == 1), key=str) == [(2, "7", None), (3, '"late"', None), (5, None, '{"text":"again"}')]
    assert [r["content"] for r in out if r["conv_id"] == 1 and r["kind"] == "message"] == ['"be brief"', '"I look.   and"']
    assert [(r["level"], r["place"], r["valid"]) for r in out if r["conv_id"] == 2] == [(None, None, False)] * 3
    assert [r["linked"] for r in out if r["conv_id"] == 3 and r["kind"] == "call"] == [True, False]
    assert all(not r["linked"] for r in out if r["conv_id"] is None)
    assert chat.format_chats(table(spark, [])).count() == 0


def test_many_random_conversations(spark):
    """Kinds, links and levels as a plain loop finds them."""
    rng = random.Random(5)
    rows = []
    for conv in range(12):
        for turn in range(rng.randint(1, 8)):
            ids = [rng.choice("abcdef") for _ in range(rng.randint(1, 2))]
            if rng.random() < 0.5:
                bodies = [{"id": i, "name": "reply", "arguments": {"text": {"$result": rng.choice("abcdef")} if rng.random() < 0.4 else "t"}} for i in ids]
                rows.append((conv, turn, "assistant", "".join(map(call, bodies))))
            else:
                rows.append((conv, turn, "tool", json.dumps({"id": ids[0], "content": turn})))
    out = rows_of(chat.format_chats(table(spark, rows)))
    expected = Counter()
    for conv in range(12):
        calls, results, n_calls, n_results = {}, {}, Counter(), Counter()
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            if role == "tool":
                got = json.loads(text)
                n_results[got["id"]] += 1
                results.setdefault(got["id"], turn)
            else:
                for at, body in enumerate(text.removeprefix("<tool_call>").removesuffix("</tool_call>").split("</tool_call><tool_call>")):
                    own = json.loads(body)
                    n_calls[own["id"]] += 1
                    calls.setdefault(own["id"], (turn, own["arguments"]["text"]))
        level = {}
        for _ in calls:
            for i, (_, need) in calls.items():
                if isinstance(need, str):
                    level[i] = 0
                elif need["$result"] in level:
                    level[i] = level[need["$result"]] + 1
        for i, (turn, _) in calls.items():
            expected[conv, i, "call", level.get(i), results.get(i)] += 1
        for i, n in n_calls.items():
            expected[conv, i, "repeated"] += n - 1
        for i, n in n_results.items():
            expected[conv, i, "repeated"] += n - 1
            if i not in calls:
                expected[conv, i, "orphan"] += 1
    found = Counter((r["conv_id"], r["call_id"], "call", r["level"], r["result_turn"]) if r["kind"] == "call" else (r["conv_id"], r["call_id"], r["kind"]) for r in out)
    assert found == +expected
    place = {(r["conv_id"], r["call_id"]): n for n, r in enumerate(out) if r["kind"] == "call" and r["level"] is not None}
    for r in out:
        if r["kind"] == "call" and r["level"]:
            need = json.loads(r["arguments"])["text"]["$result"]
            assert place[r["conv_id"], need] < place[r["conv_id"], r["call_id"]]
