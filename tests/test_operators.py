import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiolake.functions.geometry import Box, iou
from radiolake.operators import limits, metrics, scoring, splits, stats, traces
from radiolake.operators.ranking import running_total
from radiolake.operators.registry import default_registry

CALL = "struct<tool_name string, tool_args map<string,string>, tool_ok boolean, tool_error string>"
FINDING = "struct<quadrant int, tooth_position int, diagnosis string>"
NAMES = ["caries", " Caries ", "deep caries", "", None]


def random_findings(rnd, most=5):
    if rnd.random() < 0.1:
        return None
    return [None if rnd.random() < 0.1 else (rnd.choice([1, 2, None]), rnd.choice([1, 2, 3]), rnd.choice(NAMES)) for _ in range(rnd.randrange(most))]


def brute_accuracy(preds, gts):
    p, g = [x for x in preds or [] if x], [x for x in gts or [] if x]
    if not g:
        return float(not p)
    if not p:
        return 0.0

    def score(a, b):
        s = 0.25 * (a[0] is not None and a[0] == b[0]) + 0.25 * (a[1] is not None and a[1] == b[1])
        x, y = (a[2] or "").strip().lower(), (b[2] or "").strip().lower()
        return s + 0.5 * (x != "" and x == y)

    pairs = sorted(((-score(a, b), i, j) for i, a in enumerate(p) for j, b in enumerate(g)))
    total, up, ug = 0.0, set(), set()
    for s, i, j in pairs:
        if i not in up and j not in ug:
            up.add(i)
            ug.add(j)
            total -= s
    pr, rc = total / len(p), total / len(g)
    return 2 * pr * rc / (pr + rc) if pr + rc else 0.0


def test_accuracy_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, random_findings(rnd), random_findings(rnd)) for i in range(400)]
    df = spark.createDataFrame(rows, f"i int, p array<{FINDING}>, g array<{FINDING}>")
    got = {r[0]: r[1] for r in df.select("i", scoring.accuracy_score(F.col("p"), F.col("g"))).collect()}
    for i, p, g in rows:
        assert abs(got[i] - brute_accuracy(p, g)) < 1e-9, (p, g)


def test_matched_example(spark):
    df = spark.createDataFrame([([(1, 6, "caries"), (2, 4, "x")], [(1, 6, "caries"), (2, 5, "x"), (3, 1, "y")])], f"p array<{FINDING}>, g array<{FINDING}>")
    assert tuple(df.select(scoring.matched_total(F.col("p"), F.col("g")), F.round(scoring.accuracy_score(F.col("p"), F.col("g")), 6)).first()) == (1.75, 0.7)


def brute_efficiency(calls):
    if not calls:
        return 1.0
    teeth = {int(a["tooth"]) for t, a, ok in calls if t == "locate_tooth" and ok and a.get("tooth", "").isdigit()}
    budget, cost, last = min(50, max(1, len(teeth)) * 6), 0.0, None
    for t, a, _ in calls:
        key = (t, tuple(sorted(a.items())))
        if t not in ("locate_tooth", "nudge_crop"):
            cost += (0.2 if t == "fdi_label" else 1.0) * (5 if key == last else 1)
        last = key
    return 1.0 if cost <= budget else 1 / (1 + (cost - budget) / max(1, budget))


def test_efficiency_against_brute_force(spark):
    rnd = random.Random(8)
    tools = ["locate_tooth", "nudge_crop", "fdi_label", "zoom_crop", "denoise"]
    rows = []
    for i in range(300):
        calls = [(rnd.choice(tools), {"tooth": rnd.choice(["11", "12", "x"]), "b": "1"} if rnd.random() < 0.7 else {}, rnd.random() < 0.8) for _ in range(rnd.choice([0, 3, 12, 30]))]
        rows.append((i, calls))
    df = spark.createDataFrame([(i, [(t, a, ok, None) for t, a, ok in c]) for i, c in rows], f"i int, c array<{CALL}>")
    got = {r[0]: r[1] for r in df.select("i", scoring.efficiency_score(F.col("c"))).collect()}
    for i, c in rows:
        assert abs(got[i] - brute_efficiency(c)) < 1e-9


def test_calls_skip_nulls(spark):
    df = spark.createDataFrame([([(0, None), None, (1, [("a", None, True, None), None])],), (None,)], f"t array<struct<turn int, tool_calls_this_turn array<{CALL}>>>")
    c = scoring.calls(F.col("t"))
    assert [tuple(r) for r in df.select(F.size(c), scoring.validity_score(c), scoring.efficiency_score(c)).collect()] == [(1, 1.0, 1.0), (0, 1.0, 1.0)]


def brute_detections(preds, gts):
    def over(a, b):
        w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return w / (a[2] * a[3] + b[2] * b[3] - w)

    used, tp, fp = set(), 0, 0
    for q, p, box, _ in sorted(preds, key=lambda x: -x[3]):
        best = max(((over(box, g[2]), -j) for j, g in enumerate(gts) if j not in used), default=None)
        if best and best[0] >= 0.5 and (q, p) == gts[-best[1]][:2]:
            used.add(-best[1])
            tp += 1
        else:
            fp += 1
    return tp, fp, len(gts) - tp


def test_detections_against_brute_force(spark):
    rnd = random.Random(4)
    make = lambda: (rnd.randrange(1, 3), rnd.randrange(1, 3), [float(rnd.randrange(0, 12)), float(rnd.randrange(0, 6)), 10.0, 10.0], rnd.random())
    rows = [(i, [make() for _ in range(rnd.randrange(5))], [make() for _ in range(rnd.randrange(5))]) for i in range(200)]
    t = "array<struct<quadrant int, tooth_position int, bbox array<double>, score double>>"
    df = spark.createDataFrame(rows, f"i int, p {t}, g {t}")
    box = lambda a: Box(*[a["bbox"][k] for k in range(4)])
    got = {r["i"]: tuple(r["d"]) for r in df.select("i", scoring.detections(F.col("p"), F.col("g"), "score", lambda a, b: iou(box(a), box(b))).alias("d")).collect()}
    for i, p, g in rows:
        assert got[i] == brute_detections(p, g)


def test_legacy_scores(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 4, 5, 10)], "n int")
    assert np.allclose([r[0] for r in df.select(scoring.call_count_score(F.col("n"))).collect()], [-0.2, 0.1, 0.4, -0.1, -2.6])
    df = spark.createDataFrame([("a",), ("z",), (None,)], "t string")
    assert [r[0] for r in df.select(scoring.tool_name_score(F.col("t"), ["a"])).collect()] == [0.2, -0.5, -0.5]


@pytest.mark.parametrize("k", [1, 10, 12, 14, 20])
def test_slices(spark, k):
    ids = spark.createDataFrame([(i,) for i in range(100, 778)] + [(100,), (None,)], "x long")
    parts = {s: {r[0]: r[1] for r in splits.parts(ids, "x", k, s).collect()} for s in (42, 99)}
    assert all(set(p) == set(range(100, 778)) for p in parts.values())
    sizes = Counter(parts[42].values())
    assert len(sizes) == k and max(sizes.values()) - min(sizes.values()) <= 1
    assert k == 1 or parts[42] != parts[99]
    assert parts[42] == {r[0]: r[1] for r in splits.parts(ids.repartition(5), "x", k, 42).collect()}


def test_slice_errors(spark):
    ids = spark.range(5)
    for k, i in ((0, 1), (3, 0), (3, 4)):
        with pytest.raises(ValueError):
            splits.one_part(ids, "id", k, i, 1)
    assert splits.held_out(spark.range(55), "id", 0.1, 1).count() == 5
    assert splits.parts(spark.range(0), "id", 3, 1).count() == 0


def test_running_total_of_a_hot_group(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), "id", (F.col("id") % 5).alias("_b"))
    rows = running_total(df, ["g"], ["id"], F.lit(1), "n", buckets=16).collect()
    by = {}
    for r in rows:
        by.setdefault(r["g"], []).append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and "_b" in rows[0].asDict()


def test_histogram_and_describe(spark):
    v = [0.0, 1.0, 2.0, 10.0]
    df = spark.createDataFrame([(x,) for x in [*v, None]], "v double")
    assert {r["bin"]: r["n"] for r in stats.histogram(df, F.col("v"), 5).collect()} == {0: 2, 1: 1, 4: 1}
    d = stats.describe(df, F.col("v")).first()
    assert d["n"] == 4 and abs(d["std"] - np.std(v, ddof=1)) < 1e-6 and abs(d["q25"] - np.percentile(v, 25)) < 1e-6
    assert stats.diagnosis_column(["a", "category_id"]) == "category_id" and stats.diagnosis_column([]) is None


def test_quantiles_against_numpy(spark):
    """Brackets far narrower than the data, ties, nulls, a constant, and a column without values."""
    rng = np.random.default_rng(4)
    rows = [(float(rng.normal()), float(rng.integers(0, 3)), 7.0, None) for _ in range(5000)] + [(None, None, None, None)] * 20
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(8)
    probs = [0.0, 0.01, 0.25, 0.5, 0.975, 1.0]
    got = {(r["name"], r["p"]): r["value"] for r in stats.quantiles(df, {c: F.col(c) for c in "abcd"}, probs, accuracy=200).collect()}
    want = {(c, p): float(np.quantile([r[i] for r in rows if r[i] is not None], p)) for i, c in enumerate("abc") for p in probs}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert stats.quantiles(df.limit(0), {"a": F.col("a")}, probs).count() == 0
    assert stats.describe(df.where("a is null"), F.col("a")).first()["n"] == 0


def test_lists_of_a_hot_key(spark):
    df = spark.createDataFrame([(1, i) for i in range(57)] + [(2, 5), (None, 1)], "k int, i long").repartition(7)
    rows = stats.bounded_lists(df, ["k"], ["i"], F.col("i"), "v", 10).collect()
    assert {(r["k"], r["part"]): list(r["v"]) for r in rows} == {(1, p): list(range(57))[p * 10 : p * 10 + 10] for p in range(6)} | {(2, 0): [5], (None, 0): [1]}


def test_resampling_of_any_metric(spark):
    df = spark.createDataFrame([(i, float(i % 2), 1.0) for i in range(50)] + [(None, 1.0, 1.0), (99, None, 1.0)], "i long, a double, b double")
    one = metrics.bootstrap(df, "i", {"a": F.col("a"), "b": F.col("b")}, lambda s: s["a"] / s["b"], 300, 1).first()
    assert tuple(one) == tuple(metrics.bootstrap_mean(df, "i", F.col("a"), 300, 1).first()) and one["n"] == 50
    empty = metrics.bootstrap_mean(df.limit(0), "i", F.col("a"), 300, 1).first()
    assert (empty["n"], empty["point"]) == (0, None)


def test_key_pool(spark):
    df = spark.createDataFrame([(i, i * 1_000_000) for i in range(40)], "i long, t long").repartition(3)
    rows = limits.round_robin(df, "t", ["i"], keys=3, per_minute=10, per_day=5).collect()
    assert {(r["key"], r["calls"], r["over_cap"], r["waited"]) for r in rows} == {(0, 14, 10, 13), (1, 13, 9, 12), (2, 13, 9, 12)}


def test_hints_and_hooks(spark):
    gt = "g array<struct<quadrant int, tooth_position int, bbox array<double>>>"
    df = spark.createDataFrame([([(1, 6, None), (1, 6, [1.0]), (1, 6, [2.0]), None],), ([],), (None,)], gt)
    assert [r[0] for r in df.select(scoring.box_hint(F.col("g"), F.lit(16))).collect()] == [[1.0], None, None]
    assert df.select(scoring.box_hint(F.col("g"), F.lit(6))).first()[0] is None
    got = traces.run_agent(spark.createDataFrame([(1, 5), (2, 6)], "k long, x long"), "k", lambda b: b["x"] * 2, "long")
    assert sorted(map(tuple, got.collect())) == [(1, 10), (2, 12)]
    judged = spark.createDataFrame([(True,), (None,), (False,), (True,)], "grounded boolean")
    assert tuple(traces.grounding_rate(judged).first()) == (4, 2, 0.5) and tuple(traces.grounding_rate(judged.limit(0)).first()) == (0, 0, 0.0)
    e = traces.examples(spark.createDataFrame([(1, None, ["a", None, "b"]), (2, 7, None)], "k int, image long, x array<string>"), "k", "image", "x", lambda x: x)
    assert [(r["i"], r["target"], "unknown" in r["prompt"]) for r in e.collect()] == [(0, "a", True), (2, "b", True)]
    assert np.allclose([r[0] for r in spark.range(3, 7).select(scoring.overrun_penalty(F.col("id"))).collect()], [0, 0, -0.1, -0.2])


def test_calibration_edges(spark):
    rows = [(0.0, 1), (0.1, 0), (0.3, 1), (1.0, 1), (0.95, 0), (None, 1)]
    df = spark.createDataFrame(rows, "c double, ok int")
    r = metrics.calibration_error(df, F.col("c"), F.col("ok")).first()
    want = (abs(0.1 - 0) * 1 + abs(0.3 - 1) * 1 + abs((1.0 + 0.95) / 2 - 0.5) * 2) / 5
    assert r["n"] == 5 and abs(r["ece"] - want) < 1e-6
    assert metrics.calibration_error(df.limit(3), F.col("c"), F.col("ok")).first()["ece"] is None
    assert metrics.calibration_error(df.where("false"), F.col("c"), F.col("ok")).first()["ece"] == 0.0


def test_class_measures(spark):
    y, z = ["a", "a", "b", "c", "a"], ["a", "b", "b", "d", "a"]
    df = spark.createDataFrame(list(zip(y, z)), "y string, z string")
    got = {r["label"]: r for r in metrics.per_class(df, "y", "z").collect()}
    assert set(got) == {"a", "b", "c", "d"} and got["a"]["f1"] == 0.8 and got["d"]["recall"] is None and got["c"]["f1"] == 0
    m = metrics.macro(metrics.per_class(df, "y", "z")).first()
    assert m["balanced_accuracy"] == round((2 / 3 + 1 + 0) / 3, 4)


def test_bootstrap_against_resampling(spark):
    rng = np.random.default_rng(0)
    x = rng.random(800) < 0.3
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, v double")
    r = metrics.bootstrap_mean(df, "i", F.col("v"), 400, 1).first()
    means = [x[rng.integers(0, 800, 800)].mean() for _ in range(2000)]
    assert r["low"] <= r["point"] <= r["high"]
    assert abs(r["low"] - np.percentile(means, 2.5)) < 0.008 and abs(r["high"] - np.percentile(means, 97.5)) < 0.008


def test_audit_of_limits(spark):
    rnd = random.Random(1)
    rows = sorted((rnd.randrange(3), rnd.randrange(2), rnd.randrange(3 * 86_400) * 1_000_000, i) for i in range(600))
    df = spark.createDataFrame(rows, "provider int, role int, t long, id int")
    got = {(r["provider"], r["day"]): tuple(r)[2:] for r in limits.audit(df, "provider", "role", "t", ["id"], 60, 1, 600, 55, 60).collect()}
    want = {}
    for p in range(3):
        mine = sorted((t, i, role) for q, role, t, i in rows if q == p)
        number = Counter()
        for k, (t, _, role) in enumerate(mine):
            day = t // 86_400_000_000
            number[day] += 1
            recent = sum(1 for u, _, s in mine if s == role and t - 600_000_000 <= u <= t)
            w = want.setdefault((p, day), [0, 0, 0, 0, 0])
            w[0] += 1
            w[1] += k > 0 and t - mine[k - 1][0] < 60_000_000
            w[2] += recent > 1
            w[3] += number[day] > 55
            w[4] = max(w[4], recent)
    assert got == {k: tuple(v) for k, v in want.items()}


def test_trace_log(spark):
    log = spark.createDataFrame([(1, "unverified"), (2, "Generation Failed"), (3, "generation_failed"), (3, "un-verified"), (4, None), (None, "unverified")], "image_id long, status string")
    seen = spark.createDataFrame([(1,), (1,), (9,), (None,)], "image_id long")
    assert {r[0] for r in traces.pending(log, seen).collect()} == {3}
    assert {r[0] for r in traces.eligible(spark.range(6), log).collect()} == {0, 2, 4, 5}
    s = traces.status_counts(log, seen).first()
    assert (s["generated"], s["verified"], s["pending"], s["verified_share"]) == (2, 2, 1, 0.5)
    assert [r[0] for r in traces.promoted(log, seen, F.lit(True)).select("image_id").collect()] == [3]


def test_error_streak(spark):
    df = spark.createDataFrame([(1, i, e) for i, e in enumerate([1, 1, 0, 1, 1, 1, None, 1])], "k int, i int, e int")
    got = [(r["streak"], r["verdict"]) for r in traces.error_streak(df, "k", "i", F.col("e") == 1).orderBy("i").collect()]
    assert got == [(1, "go on"), (2, "recover"), (0, "go on"), (1, "go on"), (2, "recover"), (3, "fatal"), (0, "go on"), (1, "go on")]


def test_registry(spark):
    r = default_registry()
    assert "fdi_label" in r.names() and "nudge_crop" in r.describe() and r.get("none") is None
    assert spark.range(1).select(r.execute("fdi_label", F.lit(3), F.lit(6))).first()[0] == "36"
    with pytest.raises(KeyError):
        r.execute("none")
    df = spark.createDataFrame([("fdi_label",), ("none",), (None,)], "t string")
    assert [x[0] for x in df.select(r.dispatch(F.col("t"), {"fdi_label": (F.lit(1), F.lit(8))})).collect()] == ["18", None, None]


def test_advantage_of_a_group(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (None, 1.0)], "g int, r double")
    got = sorted(((x["g"] or 0), x["advantage"]) for x in metrics.with_advantage(df, "r", "g").collect())
    assert got == [(0, 0.0), (1, -0.9999), (1, 0.9999), (2, 0.0)]


def test_advantage_is_rounded_once(spark):
    # 0.2854998932: to six places first it would be 0.2855, and then 0.286.
    df = spark.createDataFrame([(1, 0.775), (1, 1.0), (1, 0.3)], "g int, r double")
    r = [0.775, 1.0, 0.3]
    mean, std = np.mean(r), np.std(r)
    got = sorted(x["advantage"] for x in metrics.with_advantage(df, "r", "g", 3).collect())
    assert got == sorted(round((x - mean) / (std + 1e-4), 3) for x in r)
