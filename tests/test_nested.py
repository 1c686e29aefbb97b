import json

from radiolake.operators.nested import child_table, flat_tables, label_text, parent_label, rebuilt, shred_json
from pyspark.sql import functions as F


def shred(spark, lines, **kw):
    df = spark.createDataFrame([(i, x, "clash") for i, x in enumerate(lines)], "raw_id long, line string, label string")
    got = shred_json(df, "raw_id", "line", **kw).collect()
    return {(r["raw_id"], r["node_table"], tuple(r["label"])) for r in got}


FULL = {"turns": [{"turn": 0, "tool_calls_this_turn": [{"tool_name": "a"}, None, {"tool_name": "b"}]}, None, {"turn": 2}], "messages": [{"role": "user", "content": "hi"}, {"role": "x", "content": [{"type": "text"}, None]}], "final_answer": {"quadrant": 1}, "assistant_token_spans": None}
WANT = {("turns", (0,)), ("turns", (2,)), ("turns.tool_calls_this_turn", (0, 0)), ("turns.tool_calls_this_turn", (0, 2)), ("messages", (0,)), ("messages", (1,)), ("messages.content", (0, 0)), ("messages.content", (1, 0)), ("final_answer", (0,))}


def test_shapes_of_a_line(spark):
    text = json.dumps(FULL)
    lines = [text, json.dumps({"trajectory": FULL}), json.dumps({"trajectory": text}), json.dumps({"partial_trajectory": FULL, "trajectory": None}), "﻿" + text, json.dumps(text)]
    got = shred(spark, lines)
    for i in range(len(lines)):
        assert {(t, p) for k, t, p in got if k == i} == WANT, lines[i][:60]


def test_lines_without_rows(spark):
    assert shred(spark, [None, "", "null", "[]", "[1]", "5", '"x"', json.dumps(FULL)[:-5], "{", "{}", '{"turns": null}', '{"turns": []}', "[" * 5000]) == set()


def test_round_trip(spark):
    df = spark.createDataFrame([(1, json.dumps(FULL))], "raw_id long, line string")
    rows = shred_json(df, "raw_id", "line").select("node_table", "label", parent_label(F.col("label")).alias("up"), "value").collect()
    turns = {tuple(r["label"]): json.loads(r["value"]) for r in rows if r["node_table"] == "turns"}
    calls = [r for r in rows if r["node_table"] == "turns.tool_calls_this_turn"]
    rebuilt = [dict(turns[(i,)], tool_calls_this_turn=[json.loads(c["value"]) for c in sorted(calls, key=lambda c: c["label"]) if tuple(c["up"]) == (i,)]) for i in (0, 2)]
    assert rebuilt == [{"turn": 0, "tool_calls_this_turn": [{"tool_name": "a"}, {"tool_name": "b"}]}, {"turn": 2, "tool_calls_this_turn": []}]


def test_typed_columns(spark):
    df = spark.createDataFrame([(1, [{"turn": 0, "c": [{"n": "a"}, None, {"n": "b"}]}, None]), (2, None), (3, [])], "k long, t array<struct<turn int, c array<struct<n string>>>>")
    got = sorted(tuple(r) for r in child_table(df, "k", ["t", "c"]).collect())
    assert got == [(1, "0.0", "0", "a"), (1, "0.2", "0", "b")]
    assert [tuple(r) for r in child_table(df, "k", ["t"], {"turn": "turn"}).collect()] == [(1, "0", None, 0)]
    assert child_table(df.where("false"), "k", ["t"]).count() == 0


def test_label_text(spark):
    assert spark.range(1).select(label_text(F.array(F.lit(3), F.lit(0))).alias("x")).first()["x"] == "3.0"


def arrays_of(value, path=()):
    """(path, place or None, element) of all arrays' elements below a value, in plain Python."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from arrays_of(v, (*path, k))
    elif isinstance(value, list):
        for v in value:
            if v is not None:
                yield ".".join(path)
                yield from arrays_of(v, (*path, "[]") if isinstance(v, list) else path)


RAW = [
    {"id": 1, "turns": [{"n": 0, "calls": [{"t": "a", "box": [1, 2.5]}, None]}, None, {"n": 1}], "who": {"name": "x", "tags": ["p", "q"]}},
    {"id": 2, "turns": [], "grid": [[1, 2], [], [3]], "who": None},
    {"id": 3, "grid": [None, [4]], "odd": "text"},
    {"id": 4, "odd": 5},
]


def test_tables_by_discovered_path(spark):
    lines = [json.dumps(r) for r in RAW] + [None, "", "{", "[1]", json.dumps(json.dumps({"id": 5}))]
    tables = flat_tables(spark.createDataFrame(list(enumerate(lines)), "k long, line string"), "k", "line")
    want = {}
    for r in RAW:
        for path in arrays_of(r):
            want[path] = want.get(path, 0) + 1
    assert {p: t.count() for p, t in tables.items() if p and t.count()} == want
    assert tables[""].count() == 5 and {(r["k"], r["odd"]) for r in tables[""].select("k", "odd").collect()} == {(0, None), (1, None), (2, '"text"'), (3, "5"), (8, None)}
    assert sorted(tuple(r) for r in tables["turns.calls.box"].collect()) == [(0, "0.0.0", "0.0", 1.0), (0, "0.0.1", "0.0", 2.5)]
    assert sorted(tuple(r) for r in tables["turns"].select("k", "label", "n").collect()) == [(0, "0", 0), (0, "2", 1)]
    assert sorted(tuple(r) for r in tables["grid.[]"].select("k", "label", "parent_label", "value").collect()) == [(1, "0.0", "0", 1), (1, "0.1", "0", 2), (1, "2.0", "2", 3), (2, "1.0", "1", 4)]
    assert flat_tables(spark.createDataFrame([(1, None)], "k long, line string"), "k", "line")[""].count() == 0


def test_a_lone_value_where_others_have_arrays(spark):
    lines = ['{"m": [{"c": "plain"}, {"c": [{"t": 1}, "two"]}, {"c": {"t": 3}}]}', '{"m": {"c": null}}']
    tables = flat_tables(spark.createDataFrame(list(enumerate(lines)), "k long, line string"), "k", "line")
    assert sorted(tuple(r) for r in tables["m.c"].select("k", "label", "t", "value").collect()) == [(0, "0.0", None, "plain"), (0, "1.0", 1, None), (0, "1.1", None, "two"), (0, "2.0", 3, None)]
    assert sorted(r["label"] for r in tables["m"].collect() if r["k"] == 1) == ["0"]


def test_tables_give_back_the_records(spark):
    """The flat tables, put together again from the leaves up, are the records."""
    tables = flat_tables(spark.createDataFrame([(r["id"], json.dumps(r)) for r in RAW[:3]], "k long, line string"), "k", "line")
    boxes = {(r["k"], r["parent_label"]): r["items"] for r in rebuilt(tables["turns.calls.box"], "k", F.col("value")).collect()}
    calls = {(r["k"], r["parent_label"]): r["items"] for r in rebuilt(tables["turns.calls"], "k", F.struct("label", "t")).collect()}
    turns = {r["k"]: r["items"] for r in rebuilt(tables["turns"], "k", F.struct("label", "n")).collect()}
    got = [x and {"n": x["n"], **({"calls": [{"t": c["t"], "box": boxes[(1, c["label"])]} for c in calls[(1, x["label"])]]} if (1, x["label"]) in calls else {})} for x in turns[1]]
    assert got == [{"n": 0, "calls": [{"t": "a", "box": [1, 2.5]}]}, None, {"n": 1}]
    rows = rebuilt(tables["grid.[]"], "k", F.col("value"))
    grid = {(r["k"], r["parent_label"]): r["items"] for r in rows.collect()}
    assert [grid.get((2, str(i)), []) for i in range(3)] == [[1, 2], [], [3]] and grid[(3, "1")] == [4]
