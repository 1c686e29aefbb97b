"""Queries that once left rows out, over whole small tables against brute force."""

import json
import posixpath
import re
from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import DATA
from radiolake.operators import metrics
from radiolake.plans import CORE_QUERIES, evaluation


@pytest.fixture
def stored(spark, tmp_path):
    def write(table, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        return str(tmp_path)

    return write


def reward(text):
    found = re.search(r"<think>(.*?)</think>", text, re.DOTALL)
    try:
        json.loads(text[found.end() :].strip())
    except (AttributeError, ValueError):
        return -1.0
    return 1.0


CONTENTS = [
    "", " ", "plain", "Zähne geprüft – keine Auffälligkeit", '{"réponse": "dent n° 16"}', '{"зуб":\n [1, 2]}', ' {"a": 1} \n', '{"a": 1}\n', '{"a": 1} and more', '[1] [2]', "3 teeth", '{"a": 1, "a": 2}',
    "NaN", "-Infinity", "null", '"x"', '{"a": "b\nc"}', "{'a': 1}", "\n\n", '{"a": 1', "<think>я\nты</think>\n[1]", "<think>a</think>x<think>b</think>[1]", "<THINK>a</THINK>[1]", "[1]​", "\x1f[1]\x1c", "[1]\x00",
]


def test_format_reward_of_every_message(spark, stored):
    rows = [(t, [{"role": "assistant", "content": c} for c in CONTENTS] + [None, {"role": "user", "content": None}]) for t in range(3)]
    sf = stored("agent_trajectory", [*rows, rows[0], (7, None), (8, [])], "trajectory_id long, messages array<struct<role string, content string>>")
    got = sorted(tuple(r) for r in CORE_QUERIES["format_reward"](spark, sf).collect())
    before = ["", "<think>as before</think>", "<think>as before</think> "]
    assert got == [(t, i, reward(before[(t + i) % 3] + c)) for t in range(3) for i, c in enumerate(CONTENTS, 1)]


SOURCES = ["data/a/x.json", "data\\a\\x.json", "data//a//x.json", "data/a/x.json ", "data/a /x.json", "Data/Blue-Lamp/X.JSON", "data/zähne/ü.json", "data/a\nb/x.json", "data/a/x.json\n", "./data\\a/x.json", "x.json", " ", "", "file:///data/a%20b/x.json"]
IMAGE = "id long, file_name string, width int, height int, source_file string, local_path string, loaded_at timestamp"


def test_source_folders_of_every_spelling(spark, stored):
    sf = stored("images_df", [(i, None, 1, 1, s, None, datetime(2024, 1, 1)) for i, s in enumerate([*SOURCES, None])], IMAGE)
    got = dict(tuple(r) for r in CORE_QUERIES["source_folders"](spark, sf).collect())
    assert got == {i: posixpath.dirname(s.replace("\\", "/")) for i, s in enumerate(SOURCES)}


def latest(column):
    """The column in the latest row of each image, where there is no doubt which that is."""
    return dict(duckdb.execute(f"SELECT id, any_value(v) FROM (SELECT id, {column} AS v, rank() OVER (PARTITION BY id ORDER BY loaded_at DESC NULLS LAST) AS r FROM '{DATA}/sf0.01/images_df.parquet' WHERE id IS NOT NULL) WHERE r = 1 GROUP BY id HAVING count(DISTINCT coalesce(v, '')) = 1").fetchall())


def test_source_folders_of_the_whole_table(spark):
    want = {i: posixpath.dirname(s.replace("\\", "/")) for i, s in latest("source_file").items() if s is not None}
    got = dict(tuple(r) for r in CORE_QUERIES["source_folders"](spark, f"{DATA}/sf0.01").collect())
    assert len(want) > 1000 and {i: got.get(i) for i in want} == want


TRAJECTORY = """trajectory_id long, turns array<struct<turn int, raw_output string, status string, tool_calls_this_turn array<struct<tool_name string, tool_args map<string,string>, tool_ok boolean, tool_error string>>>>,
    final_answer array<struct<quadrant int, tooth_position int, diagnosis string, confidence double>>, assistant_token_spans array<struct<prompt_len int, token_ids array<int>>>, messages array<struct<role string, content string>>"""


def test_trajectory_children(spark, stored):
    calls = [None, ("zoom", {"x": "1", "y": None}, True, None), ("view", None, False, "e"), ("view", {}, True, None)]
    contents = ["Grüße", '[{"type": "image", "image": "<Image>"}, null, {"type": "text", "text": "ü"}, "and", 5]', "[]", '[{"type": "te', '[1] and more', '{"thought": "t"}', "null", "", None, '["\\ud800"]']
    row = (1, [(0, "raw", "ok", calls), None, (2, None, None, None)], [(1, 2, "Caries", 0.5), None, (None,) * 4], [None, (3, [7, 8]), (4, None)], [None, *[("user", c) for c in contents]])
    sf = stored("agent_trajectory", [row, row, (2, None, None, None, None), (3, [], [], [], [])], TRAJECTORY)
    rows = lambda name, *columns: sorted((tuple(r) for r in CORE_QUERIES[f"p5_trajectory_{name}"](spark, sf).select("trajectory_id", *columns).collect()), key=repr)
    assert rows("turns", "label", "turn", "raw_output", "status") == [(1, "0", 0, "raw", "ok"), (1, "2", 2, None, None)]
    assert rows("token_spans", "label", "prompt_len", "token_ids") == [(1, "1", 3, [7, 8]), (1, "2", 4, None)]
    assert rows("findings", "label", "quadrant", "tooth_position", "diagnosis", "confidence") == [(1, "0", 1, 2, "Caries", 0.5), (1, "2", None, None, None, None)]
    assert rows("tool_args", "parent_label", "name", "value") == [(1, "0.1", "x", "1"), (1, "0.1", "y", None)]
    want = [
        (1, "1.0", "1", None, "Grüße", None), (1, "2.0", "2", "image", None, '{"type": "image", "image": "<Image>"}'), (1, "2.2", "2", "text", "ü", '{"type": "text", "text": "ü"}'), (1, "2.3", "2", None, "and", '"and"'), (1, "2.4", "2", None, None, "5"),
        *[(1, f"{i}.0", f"{i}", None, contents[i - 1], None) for i in (4, 5, 6, 7, 8)], (1, "10.0", "10", None, "?", '"?"'),
    ]
    assert rows("blocks", "label", "parent_label", "type", "text", "value") == sorted(want, key=repr)


def test_trajectory_blocks_of_the_whole_table(spark):
    def blocks(content):
        try:
            got = json.loads(content)
        except ValueError:
            got = content
        return [(i, b.get("text") if isinstance(b, dict) else b) for i, b in enumerate(got if isinstance(got, list) else [content]) if b is not None]

    sf = f"{DATA}/sf0.01"
    messages = duckdb.execute(f"SELECT DISTINCT trajectory_id, i, m.content FROM (SELECT trajectory_id, generate_subscripts(messages, 1) - 1 AS i, unnest(messages) AS m FROM '{sf}/agent_trajectory.parquet') WHERE m.content IS NOT NULL").fetchall()
    want = {(t, f"{i}.{j}", f"{i}", text) for t, i, content in messages for j, text in blocks(content)}
    got = CORE_QUERIES["p5_trajectory_blocks"](spark, sf).select("trajectory_id", "label", "parent_label", "text").collect()
    assert len(want) > 4000 and {tuple(r) for r in got} == want


def poisson_interval(rows, replicates, seed):
    """The interval from weights drawn one by one in plain Python, ids far enough apart for the replicates."""
    v = {i: x for i, x in rows if i is not None and x is not None}
    assert len(v) == sum(i is not None and x is not None for i, x in rows)
    stride, p = max(1000, replicates), 2147483647
    at = np.array([[i * stride + b for i in v] for b in range(1, replicates + 1)], dtype=np.int64)
    h = (at * 48271 + seed * 69621 + 12345) % p
    u = (h * h + at) % p * 48271 % p / p
    w = sum((u > x).astype(int) for x in metrics.POISSON)
    x = np.array([*v.values()])
    means = (w * x).sum(1) / w.sum(1)
    return len(v), float(x.mean()), *(float(np.percentile(means, q)) for q in (2.5, 97.5))


@pytest.mark.parametrize("name, replicates, seed", [("paired_bootstrap_ci", 2000, 0), ("metric_bootstrap_ci", 1000, 42)])
def test_bootstrap_of_all_replicates(spark, name, replicates, seed):
    sf = f"{DATA}/sf0.01"
    if name.startswith("paired"):
        rows = [(r["image_id"], r["a"] - r["b"]) for r in evaluation._runs(spark, sf).collect()]
    else:
        clean = lambda d: d and d.strip(" ").lower()
        same = lambda a, b: a is not None and a == b
        pairs = evaluation.first_pairs(spark, sf).select("record_id", "pr", "tr").collect()
        rows = [(r["record_id"], float(bool(r["pr"] and same(r["pr"]["quadrant"], r["tr"]["quadrant"]) and same(r["pr"]["tooth_position"], r["tr"]["tooth_position"]) and same(clean(r["pr"]["diagnosis"]), clean(r["tr"]["diagnosis"]))))) for r in pairs]
    got = tuple(CORE_QUERIES[name](spark, sf).select("n", "point", "low", "high").first())
    assert got == pytest.approx(poisson_interval(rows, replicates, seed), abs=2e-6)
    assert got[2] <= got[1] <= got[3] and got[2] < got[3]


def test_neighbouring_ids_draw_on_their_own(spark):
    """Of two rows at distance 1 the first must not take the draws of the second 1000 replicates on."""
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(300)], "i long, v double")
    got = tuple(metrics.bootstrap_mean(df, "i", F.col("v"), 2000, 0).first())
    assert got == pytest.approx(poisson_interval([(i, float(i % 2)) for i in range(300)], 2000, 0), abs=2e-6)


def test_image_basenames_of_every_spelling(spark, stored):
    names = ["x.png", ".\\scans\\x.png", "C:\\a b\\X-1.PNG", "a\\b/x.png", "a/b\\x.png", "//h\\ü.png", "a\\\\x.png", "a\nb\\x.png", "a\\x.png\n", " ", ""]
    sf = stored("images_df", [(i, n, 1, 1, None, None, datetime(2024, 1, 1)) for i, n in enumerate([*names, None])], IMAGE)
    got = dict(tuple(r) for r in CORE_QUERIES["image_basenames"](spark, sf).collect())
    assert got == {i: posixpath.basename(n.replace("\\", "/")) for i, n in enumerate(names)}


def test_image_basenames_of_the_whole_table(spark):
    want = {i: posixpath.basename(n.replace("\\", "/")) for i, n in latest("file_name").items() if n is not None}
    got = dict(tuple(r) for r in CORE_QUERIES["image_basenames"](spark, f"{DATA}/sf0.01").collect())
    assert any("\\" in n for n in latest("file_name").values() if n) and {i: got.get(i) for i in want} == want
