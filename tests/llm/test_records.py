import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from radiolake.llm import groupsplit, overlap, survivors


def winners(spark, rows, fields=("a", "b")):
    df = spark.createDataFrame(rows, "g long, r long, rank int, a string, b string, _group string, real string")
    real = {f: (survivors.has_value(F.col(f)), F.col(f)) for f in fields}
    got = survivors.field_winners(df, "g", "r", real, [F.col("rank"), -F.col("r")])
    return {(x["g"], x["field_name"]): (x["r"], x["value"]) for x in got.collect()}


def test_survivors_field_by_field(spark):
    rows = [
        (1, 10, 0, None, "b10", "x", "x"), (1, 11, 1, "a11", "b11", "x", "x"), (1, 12, 1, "a12", " N/A ", "x", "x"),
        (2, 20, 0, "a", "b", "x", "x"), (2, 20, 0, "a", "b", "x", "x"),
        (3, 30, None, "a30", "nan", None, None), (3, 31, 5, "-", "None", None, None),
        (None, 40, 0, "a", "b", "x", "x"), (None, 41, 0, "a", "b", "x", "x"), (4, None, 0, "a", "b", "x", "x"), (4, 42, 0, "a", "b", "x", "x"),
    ]
    assert winners(spark, rows) == {(1, "a"): (12, "a12"), (1, "b"): (10, "b10"), (3, "a"): (30, "a30")}
    assert winners(spark, []) == {}


def test_survivors_of_a_hot_group_need_no_full_sort(spark):
    df = spark.range(1000).select(F.lit(1).alias("g"), F.col("id").alias("r"), F.lit("v").alias("a"))
    got = survivors.field_winners(df, "g", "r", {"a": (F.lit(True), F.col("a"))}, [-F.col("r")])
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert [tuple(x) for x in got.select("r").collect()] == [(999,)]


def test_values_that_say_nothing(spark):
    df = spark.createDataFrame([(x,) for x in (None, "", "  ", " nan", "NULL", "-", "ok", " Unknown\n", "none of them")], "x string")
    assert [r[0] for r in df.select(survivors.has_value(F.col("x"))).collect()] == [False] * 6 + [True, False, True]
    df = spark.createDataFrame([(None,), ([],), ([None],), ([("",)],), ([(None,), ("x",)],)], "d array<struct<diagnosis string>>")
    assert [r[0] for r in df.select(survivors.has_diagnosis(F.col("d"))).collect()] == [False, False, False, False, True]


def brute_components(links):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


@pytest.mark.parametrize("per_task", [1, 3, 500_000])
def test_components(spark, monkeypatch, per_task):
    monkeypatch.setattr(groupsplit, "TASK_LINKS", per_task)
    rnd = random.Random(2)
    links = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(None, 5), (5, None), (7, 7), (200, 201)]
    rnd.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long").repartition(8)
    got = {r["node"]: r["component"] for r in groupsplit.components(df, "a", "b").collect()}
    assert got == brute_components(links)


def test_no_links(spark):
    assert groupsplit.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def brute_deal(sizes, weights):
    total = sum(s * n for s, n in sizes)
    short = [w * total for w in weights]
    out = []
    for s, n in sorted(sizes, reverse=True):
        got = [0] * len(weights)
        for _ in range(n):
            i = max(range(len(weights)), key=lambda k: (short[k], -k))
            got[i] += 1
            short[i] -= s * sum(weights)
        out.append((s, got))
    return out


def test_deal_is_the_greedy_rule():
    rnd = random.Random(9)
    for _ in range(200):
        sizes = [(s, rnd.randrange(1, 30)) for s in rnd.sample(range(1, 60), rnd.randrange(1, 8))]
        weights = rnd.choice([[80, 10, 10], [1, 1], [5, 3, 2], [1]])
        assert groupsplit.deal(sizes, weights) == brute_deal(sizes, weights)
    assert groupsplit.deal([], [80, 10, 10]) == []


def test_splits_keep_groups_together(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, *range(300)]) if i % 3 else 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "rec long, ent long")
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 100, 2)], "a long, b long")
    got = groupsplit.assign_splits(df, "ent", links, "a", "b", {"train": 80, "validation": 10, "test": 10}, [F.col("rec").cast("string")]).collect()
    assert len(got) == 3000
    by = defaultdict(set)
    for r in got:
        if r["ent"] is not None:
            by[r["group_id"]].add(r["split"])
    assert all(len(s) == 1 for s in by.values())
    assert next(r["group_id"] for r in got if r["ent"] == 7) == 6
    n = Counter(r["split"] for r in got)
    assert abs(n["train"] / 3000 - 0.8) < 0.02 and abs(n["test"] / 3000 - 0.1) < 0.02


NAMES = {
    "opg_2mwyphx_074.png": ("opg2mwyphx", "74"), "OPG%5F2MWYPHX%5F074.PNG": ("opg2mwyphx", "74"), "xrays/opg 2mwyphx 0074 copy 2_rot180.jpeg": ("opg2mwyphx", "74"),
    ".\\scans\\opg-2mwyphx-74-aug3.tif": ("opg2mwyphx", "74"), "opg__2mwyphx__074.gray.png": ("opg2mwyphx", "74"), "opg_2mwyphx_074 (2).png": ("opg2mwyphx", "74"),
    "opg_2mwyphx_074~.png": ("opg2mwyphx", "74"), "opg_2mwyphx_074 - Copy.png": ("opg2mwyphx", "74"), "opg_2mwyphx_074_v2.png": ("opg2mwyphx", "74"),
    "hp-pano_huctthy_144.png": ("hppanohuctthy", "144"), "image_0021.png": ("image", "21"), "000.png": ("000", ""), "a_000.png": ("a", "0"), "": ("", ""), ".png": ("", ""),
}


def test_names(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "n string")
    text, number = overlap.name_parts(F.col("n"))
    assert {r["n"]: (r[1], r[2]) for r in df.select("n", text, number).collect()} == NAMES


def slip(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
    s, t = sorted((a, b), key=len)
    return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))


def test_one_slip_and_its_candidates(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("ab") for _ in range(rnd.choice([6, 7]))) for _ in range(60)]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    got = df.select("a", "b", overlap.one_slip(F.col("a"), F.col("b")).alias("s"), F.arrays_overlap(overlap.variants(F.col("a")), overlap.variants(F.col("b"))).alias("c")).collect()
    for r in got:
        assert r["s"] == slip(r["a"], r["b"]), (r["a"], r["b"])
        assert r["c"] or not r["s"]


def test_overlaps(spark):
    images = spark.createDataFrame(
        [
            (1, "opg_2mwyphx_074.png", 10, 20, "data/t.json"), (2, "opg-2mwyphx-74 (1).jpg", 10, 20, "./data//v.json"), (3, "opg_2mwyphx_075.png", 10, 20, "data/v.json"),
            (4, "opg_2mwyphx_074.png", 10, 21, "data/v.json"), (5, "opg_2wmyphx_074.png", 10, 20, "/mnt/work/data/v.json "), (6, "opg_2mwyphx_074.png", 10, None, "data/v.json"),
            (7, None, 10, 20, "data/v.json"), (8, "opg_2mwyphx_074.png", 10, 20, None), (9, "opg_2mwyphx_074.png", 10, 20, "data/unknown.json"), (1, "opg_2mwyphx_074.png", 10, 20, "data/t.json"),
            (10, "image_01.png", 5, 5, "data\\t.json"), (11, "image_1.png", 5, 5, "data/v.json"), (12, "image_1.png", 5, 5, "data/v.json"), (1, "opg_2mwyphx_074.png", 10, 20, "data/v.json"),
        ],
        "id long, file_name string, width int, height int, source_file string",
    )
    files = spark.createDataFrame([("data/t.json", "train"), ("data/v.json", "validation")], "source_file string, split string")
    names = overlap.split_names(images, files)
    assert {(r["t_id"], r["e_id"]) for r in overlap.overlaps(names).collect()} == {(1, 2), (1, 5), (10, 11), (10, 12)}
    assert {r["e_id"] for r in overlap.leaked(names).collect()} == {2, 5, 11, 12}
    assert overlap.overlaps(names.where("false")).count() == 0


def test_slips_in_short_names(spark):
    train = ["image_0012.png", "img13.png", "pan_7.png", "a.png", "0012.png", "scan_1.png"]
    evaluated = ["iamge_12.png", "imgg13.png", "imag_0012.png", "img12.png", "pann_8.png", "b.png", "0013.png", "pan_07.jpg", "sacn_1.png", "scna_2.png"]
    rows = [(i, n, 10, 20, f"data/{'t' if n in train else 'v'}.json") for i, n in enumerate([*train, *evaluated])]
    images = spark.createDataFrame(rows, "id long, file_name string, width int, height int, source_file string")
    files = spark.createDataFrame([("data/t.json", "train"), ("data/v.json", "validation")], "source_file string, split string")
    names = overlap.split_names(images, files)
    by_id = {r[0]: r[1] for r in rows}
    got = {(by_id[r["t_id"]], by_id[r["e_id"]]) for r in overlap.overlaps(names).collect()}
    assert got == {("image_0012.png", "iamge_12.png"), ("image_0012.png", "imag_0012.png"), ("img13.png", "imgg13.png"), ("pan_7.png", "pan_07.jpg"), ("scan_1.png", "sacn_1.png")}
    assert {by_id[r["e_id"]] for r in overlap.leaked(names).collect()} == {e for _, e in got}


def test_copies_are_no_pairs(spark):
    """A name with many copies on both sides is one class and one link."""
    rows = [(i, f"opg_abcdefg_{7:0{3 + i % 3}d}.png", 10, 20, f"data/{'t' if i % 2 else 'v'}.json") for i in range(40)] + [(99, "opg_abcdefg_007.png", 11, 20, "data/v.json")]
    images = spark.createDataFrame(rows, "id long, file_name string, width int, height int, source_file string")
    files = spark.createDataFrame([("data/t.json", "train"), ("data/v.json", "validation")], "source_file string, split string")
    linked, own = overlap.related(overlap.split_names(images, files))
    assert linked.count() == 1 and own.count() == 41 and own.select("name_id").distinct().count() == 2
