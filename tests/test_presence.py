import datetime as dt
import random

from pyspark.sql import functions as F

from radiolake.functions.paths import place
from radiolake.operators.presence import Reference, as_of_presence, orphans

T0 = dt.datetime(2026, 1, 1)


def day(n):
    return None if n is None else T0 + dt.timedelta(hours=n)


def brute(refs, targets):
    out = {}
    for rid, key, t in refs:
        if key is None:
            continue
        rows = [(s, e) for k, s, e in targets if k == key]
        if not rows:
            out[rid] = "missing"
        elif t is None or any(s is not None and s <= t and (e is None or e > t) for s, e in rows):
            out[rid] = None
        else:
            out[rid] = "deleted" if any(s is not None and s <= t for s, e in rows) else "late"
    return out


def check(spark, refs, targets, **kw):
    r = spark.createDataFrame([(i, k, day(t)) for i, k, t in refs], "rid int, key int, t timestamp")
    g = spark.createDataFrame([(k, day(s), day(e)) for k, s, e in targets], "k int, s timestamp, e timestamp")
    got = {x["rid"]: x["reason"] for x in as_of_presence(r, "key", "t", g, "k", "s", "e", **kw).collect()}
    assert got == brute(refs, targets)


def test_random_against_brute_force(spark):
    rnd = random.Random(7)
    maybe = lambda hi: None if rnd.random() < 0.15 else rnd.randrange(hi)
    refs = [(i, maybe(6), maybe(200)) for i in range(400)]
    targets = [(maybe(6), maybe(200), None if rnd.random() < 0.4 else rnd.randrange(260)) for _ in range(60)]
    check(spark, refs, targets)
    check(spark, refs, targets, bucket=3_600_000_000)


def test_edges(spark):
    check(spark, [(1, 5, 10), (2, 5, 20), (3, 5, 9), (4, 6, 10), (5, None, 10), (6, 5, None)], [(5, 10, 20)])
    check(spark, [(1, 5, 10)], [])
    check(spark, [], [(5, 10, 20)])
    check(spark, [(1, 5, 30), (2, 5, 30)], [(5, 10, 20), (5, 10, 20), (5, 25, None)])
    check(spark, [(1, 5, 30)], [(5, None, None)])


def test_one_instant_for_all(spark):
    """References of one key that fall on one instant, or on none, are asked once."""
    check(spark, [(i, 1, 5 if i % 2 else None) for i in range(300)] + [(300, 2, None), (301, 2, 5)], [(1, 0, 5), (1, 6, None)])


def test_found_rows_come_through_the_cascade(spark):
    from radiolake.plans.data_quality import p2_found

    plan = p2_found(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "orphan in images_df" in plan


def test_hot_key(spark):
    check(spark, [(i, 1 if i % 3 else i, i % 900) for i in range(1500)], [(1, i, i + 1) for i in range(0, 900, 3)])


def test_cascade(spark):
    t = T0
    files = spark.createDataFrame([("a", t, None)], "path string, c timestamp, d timestamp")
    images = spark.createDataFrame([(1, "a", t, None, 0), (2, "b", t, None, 0)], "id long, p string, l timestamp, d timestamp, extra int")
    notes = spark.createDataFrame([(10, 1, t), (11, 2, t), (12, 3, t), (13, None, t), (None, 3, t), (11, 2, t)], "id long, image long, t timestamp")
    graph = [
        Reference("notes", "id", F.col("image"), "t", "images", "id", F.col("id"), "l", "d"),
        Reference("images", "id", F.col("p"), "l", "files", None, F.col("path"), "c", "d"),
    ]
    got = {(r["table_name"], r["record_id"], r["kind"], r["reason"]) for r in orphans({"notes": notes, "images": images, "files": files}, graph).collect()}
    assert got == {("images", 2, "direct", "missing"), ("notes", 12, "direct", "missing"), ("notes", 11, "inherited", "orphan in images")}


def test_cycle_reaches_its_fixpoint(spark):
    t = T0
    rows = [(1, 99), (2, 1), (3, 2), (4, 3), (5, 5)]
    tree = spark.createDataFrame([(i, p, t, None) for i, p in rows], "id long, parent long, t timestamp, d timestamp")
    graph = [Reference("tree", "id", F.col("parent"), "t", "tree", "id", F.col("id"), "t", "d")]
    got = {(r["record_id"], r["kind"]) for r in orphans({"tree": tree}, graph).collect()}
    assert got == {(1, "direct"), (2, "inherited"), (3, "inherited"), (4, "inherited")}


def test_places(spark):
    cases = {
        "/srv/a/b.png": "/srv/a/b.png", "/srv//a/./b.png": "/srv/a/b.png", "/srv/x/../a/b.png ": "/srv/a/b.png", "\\srv\\a\\b.png": "/srv/a/b.png",
        "file:///srv/a%20c/b.png": "/srv/a c/b.png", "/srv/a%20c/b.png": "/srv/a%20c/b.png", "/../a": "/a", "../a": "../a", "a/../../b": "../b",
        "": None, "  \n": None, "/srv/A": "/srv/A", "file:///srv/a+b": "/srv/a+b", "file:///bad%zz": "/bad%zz", "/": "/",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "p string")
    got = {r["p"]: r["q"] for r in df.select("p", place(F.col("p")).alias("q")).collect()}
    assert got == {**cases, None: None}
