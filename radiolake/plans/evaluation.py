"""Queries over traces and their truths: scores, metrics, failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics, scoring, splits
from ..operators.ranking import mixed_sql
from .base import ANNOTS, FIRST, IMAGES, NAMED, SCORED, SEED, annots, first_pairs, images, named_annots, scored

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SAME_Q, _SAME_T = "pr.quadrant IS NOT DISTINCT FROM tr.quadrant", "pr.tooth_position IS NOT DISTINCT FROM tr.tooth_position"
_D = "lower(trim({}.diagnosis))"
_SAME_D = f"coalesce({_D.format('pr')}, 'none') = coalesce({_D.format('tr')}, 'none')"


@query(f"WITH {FIRST} SELECT record_id, CASE WHEN {_SAME_Q} AND {_SAME_T} AND {_SAME_D} THEN 1.0 WHEN {_SAME_Q} AND {_SAME_T} THEN 0.5 WHEN {_SAME_Q} THEN 0.25 ELSE 0.0 END::DOUBLE AS score FROM f")
def pair_accuracy_single(spark: SparkSession, sf: str) -> DataFrame:
    return first_pairs(spark, sf).select("record_id", scoring.tiered_accuracy(F.col("pr"), F.col("tr")).alias("score"))


def component_scores() -> dict[str, Column]:
    calls = scoring.calls(F.col("turns"))
    return {
        "accuracy": scoring.accuracy_score(F.col("preds"), F.col("gt")),
        "format": scoring.format_score(F.col("format_ok"), F.col("preds")),
        "validity": scoring.validity_score(calls),
        "efficiency": scoring.efficiency_score(calls),
    }


_CALLS = """c AS (
    SELECT record_id, ti, generate_subscripts(calls, 1) AS ci, unnest(calls) AS call FROM (
        SELECT record_id, generate_subscripts(turns, 1) AS ti, unnest(turns).tool_calls_this_turn AS calls FROM t WHERE turns IS NOT NULL)),
    k AS (SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY ti, ci) AS n, call.tool_name AS tool, coalesce(call.tool_ok, false) AS ok, call.tool_args AS args,
        coalesce(call.tool_name, '') || '|' || CAST(list_sort(map_entries(coalesce(call.tool_args, MAP {}))) AS VARCHAR) AS key FROM c WHERE call IS NOT NULL),
    r AS (SELECT *, key = lag(key) OVER (PARTITION BY record_id ORDER BY n) AS again FROM k),
    e AS (SELECT record_id, count(*) AS calls, count(*) FILTER (WHERE ok) AS good,
        coalesce(sum(CASE WHEN tool IN ('locate_tooth', 'nudge_crop') THEN 0.0 WHEN tool = 'fdi_label' THEN 0.2 ELSE 1.0 END::DOUBLE * CASE WHEN again THEN 5.0 ELSE 1.0 END::DOUBLE), 0) AS billable,
        count(DISTINCT CASE WHEN tool = 'locate_tooth' AND ok THEN TRY_CAST(args['tooth'] AS INTEGER) END) AS teeth FROM r GROUP BY record_id)"""
_EFF = "CASE WHEN e.calls IS NULL OR billable <= least(50, greatest(teeth, 1) * 6) THEN 1.0 ELSE 1.0 / (1.0 + (billable - least(50, greatest(teeth, 1) * 6)) / greatest(least(50, greatest(teeth, 1) * 6), 1)) END"


@query(f"""WITH {SCORED}, {_CALLS} SELECT t.record_id, CASE WHEN format_ok AND coalesce(len(preds), 0) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS format_score,
    round(CASE WHEN e.calls IS NULL THEN 1.0 ELSE good / e.calls END, 6)::DOUBLE AS validity_score, round({_EFF}, 6)::DOUBLE AS efficiency_score FROM t LEFT JOIN e USING (record_id)""")
def reward_components(spark: SparkSession, sf: str) -> DataFrame:
    s = component_scores()
    return scored(spark, sf).select("record_id", *[F.round(s[n], 6).alias(f"{n}_score") for n in ("format", "validity", "efficiency")])


@query(f"""WITH {SCORED}, {_CALLS} SELECT record_id, count(*) AS calls, count(*) FILTER (WHERE again) AS repeats FROM r GROUP BY record_id""")
def repeat_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that repeat the one before them exactly, as a fold over each record's calls."""
    calls = scoring.calls(F.col("turns"))
    keys = F.transform(calls, scoring.call_key)
    again = F.size(F.filter(F.transform(keys, lambda k, i: (i > 0) & (k == F.get(keys, i - 1))), lambda x: x))
    return scored(spark, sf).select("record_id", F.size(calls).cast("long").alias("calls"), again.cast("long").alias("repeats")).where("calls > 0")


_PAIRS = f"""p AS (SELECT record_id, generate_subscripts(x, 1) AS i, unnest(x) AS p FROM (SELECT record_id, list_filter(preds, lambda x: x IS NOT NULL) AS x FROM t)),
    g AS (SELECT record_id, generate_subscripts(x, 1) AS j, unnest(x) AS g FROM (SELECT record_id, list_filter(gt, lambda x: x IS NOT NULL) AS x FROM t)),
    s AS (SELECT record_id, i, j, coalesce((p.quadrant = g.quadrant)::INT, 0) * 0.25::DOUBLE + coalesce((p.tooth_position = g.tooth_position)::INT, 0) * 0.25::DOUBLE
        + CASE WHEN {_D.format('p')} <> '' AND {_D.format('p')} = {_D.format('g')} THEN 0.5 ELSE 0 END::DOUBLE AS s FROM p JOIN g USING (record_id)),
    o AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY s DESC, i, j) AS n FROM s),
    m AS (SELECT record_id, 0::BIGINT AS n, 0::BIGINT AS ps, 0::BIGINT AS gs, 0.0::DOUBLE AS total FROM (SELECT DISTINCT record_id FROM o)
        UNION ALL SELECT m.record_id, o.n, CASE WHEN free THEN m.ps | (1::BIGINT << o.i) ELSE m.ps END, CASE WHEN free THEN m.gs | (1::BIGINT << o.j) ELSE m.gs END, m.total + CASE WHEN free THEN o.s ELSE 0 END
        FROM m JOIN (SELECT * FROM o) o ON o.record_id = m.record_id AND o.n = m.n + 1, LATERAL (SELECT (m.ps >> o.i) & 1 = 0 AND (m.gs >> o.j) & 1 = 0 AS free) f),
    z AS (SELECT record_id, max(total) AS total FROM m GROUP BY record_id),
    c AS (SELECT record_id, coalesce(len(list_filter(preds, lambda x: x IS NOT NULL)), 0) AS np, coalesce(len(list_filter(gt, lambda x: x IS NOT NULL)), 0) AS ng FROM t)"""
_ACC = "CASE WHEN ng = 0 THEN CASE WHEN np = 0 THEN 1.0 ELSE 0.0 END WHEN np = 0 THEN 0.0 ELSE 2 * total / (np + ng) END"


@query(f"WITH RECURSIVE {SCORED}, {_PAIRS} SELECT record_id, round({_ACC}, 6)::DOUBLE AS accuracy_score FROM c LEFT JOIN z USING (record_id)")
def reward_accuracy_multi(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("record_id", F.round(component_scores()["accuracy"], 6).alias("accuracy_score"))


# The weights as published; the SQL doesn't take them from the code under test.
_TOTAL = "1.0 * ac + 0.2 * f + 0.2 * v + 0.1 * ef"
_GRID_SQL = "(VALUES (1.0, 0.2, 0.2, 0.1), (1.0, 0.0, 0.0, 0.0), (1.0, 0.1, 0.4, 0.1), (1.0, 0.4, 0.1, 0.1), (0.7, 0.2, 0.2, 0.1)) w(a, f, v, e)"


@query(f"""WITH RECURSIVE {SCORED}, {_PAIRS}, {_CALLS.replace('c AS (', 'cc AS (', 1).replace('FROM c WHERE', 'FROM cc WHERE')},
    q AS (SELECT t.record_id, t.image_id, CASE WHEN format_ok AND coalesce(len(preds), 0) > 0 THEN 1.0 ELSE 0.0 END AS f, CASE WHEN e.calls IS NULL THEN 1.0 ELSE good / e.calls END AS v, {_EFF} AS ef, {_ACC} AS ac
        FROM t JOIN c USING (record_id) LEFT JOIN z USING (record_id) LEFT JOIN e USING (record_id))
    SELECT record_id, round({_TOTAL}, 5)::DOUBLE AS reward FROM q""")
def composite_reward(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select("record_id", F.round(scoring.composite(component_scores()), 5).alias("reward"))


def _rewards(spark: SparkSession, sf: str) -> DataFrame:
    s = component_scores()
    return scored(spark, sf).select("record_id", "image_id", *[s[n].alias(n) for n in s])


@query(SQL["composite_reward"].split("SELECT record_id, round(")[0] + f"""SELECT w.a::DOUBLE AS w_accuracy, w.f::DOUBLE AS w_format, w.v::DOUBLE AS w_validity, w.e::DOUBLE AS w_efficiency, count(*) AS n,
    round(avg(w.a::DOUBLE * q.ac + w.f::DOUBLE * q.f + w.v::DOUBLE * q.v + w.e::DOUBLE * q.ef), 5) AS mean_reward FROM q, {_GRID_SQL} GROUP BY ALL""")
def weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Mean reward by weight vector: components once, then a handful of sums a row."""
    sums = F.array(*[F.struct(*[F.lit(w).alias(f"w_{n}") for n, w in zip(scoring.WEIGHTS, ws)], scoring.composite({n: F.col(n) for n in scoring.WEIGHTS}, dict(zip(scoring.WEIGHTS, ws))).alias("r")) for ws in scoring.GRID])
    each = _rewards(spark, sf).select(F.explode(sums).alias("x")).select("x.*")
    return each.groupBy(*[f"w_{n}" for n in scoring.WEIGHTS]).agg(F.count("*").alias("n"), F.round(F.avg("r"), 5).alias("mean_reward"))


@query(SQL["composite_reward"].split("SELECT record_id, round(")[0] + f"""SELECT record_id, round(((r - avg(r) OVER (PARTITION BY image_id)) / (stddev_pop(r) OVER (PARTITION BY image_id) + 1e-4)), 3)::DOUBLE + 0.0 AS advantage
    FROM (SELECT record_id, image_id, round({_TOTAL}, 5)::DOUBLE AS r FROM q)""")
def group_advantage(spark: SparkSession, sf: str) -> DataFrame:
    r = scored(spark, sf).select("record_id", "image_id", F.round(scoring.composite(component_scores()), 5).alias("reward"))
    return metrics.with_advantage(r, "reward", "image_id", 3).select("record_id", (F.col("advantage") + F.lit(0.0)).alias("advantage"))


@query()
def detector_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Hits, false alarms and misses of predicted boxes (each truth's box moved by a
    hash-drawn share of its size) against the truths, with precision, recall and F1."""
    from ..functions.geometry import Box, iou

    box = lambda a: Box(*[F.get(a["bbox"], i) for i in range(4)])
    t = scored(spark, sf)
    gts = F.filter("gt", lambda g: g.isNotNull() & (F.coalesce(F.size(g["bbox"]), F.lit(0)) == 4))
    preds = F.transform(F.col("gts"), lambda g, j: F.struct(g["quadrant"].alias("quadrant"), F.when((F.col("record_id") + j) % 5 == 0, g["tooth_position"] % 8 + 1).otherwise(g["tooth_position"]).alias("tooth_position"), F.array(g["bbox"][0] + g["bbox"][2] * ((F.col("record_id") + j) % 4) / 8, g["bbox"][1], g["bbox"][2], g["bbox"][3]).alias("bbox"), (((F.col("record_id") * 31 + j * 17) % 100) / 100.0).alias("score")))
    d = t.select("record_id", gts.alias("gts")).where("size(gts) > 0").withColumn("preds", preds).select(scoring.detections(F.col("preds"), F.col("gts"), "score", lambda p, g: iou(box(p), box(g))).alias("d"))
    total = d.agg(*[F.sum(f"d.{n}").alias(n) for n in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)), 6)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return total.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(f"""WITH {SCORED} SELECT record_id, round(CASE WHEN tool_calls = 0 THEN -0.2 WHEN tool_calls <= 4 THEN tool_calls * 0.1 ELSE 0.4 - (tool_calls - 4) * 0.5 END, 6)::DOUBLE AS call_score,
    round(-0.1 * greatest(tool_calls - 4, 0), 6)::DOUBLE + 0.0 AS overrun FROM t""")
def legacy_rewards(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("tool_calls")
    return scored(spark, sf).select("record_id", F.round(scoring.call_count_score(n), 6).alias("call_score"), (F.round(scoring.overrun_penalty(n), 6) + F.lit(0.0)).alias("overrun"))


@query(f"""WITH {SCORED}, {_CALLS} SELECT record_id, n, tool, CASE WHEN tool IN ('locate_tooth', 'zoom_crop', 'nudge_crop', 'window_level', 'denoise', 'enhance_contrast', 'contralateral_compare', 'fdi_label') THEN 0.2 ELSE -0.5 END::DOUBLE AS score FROM k""")
def tool_name_rewards(spark: SparkSession, sf: str) -> DataFrame:
    """Every call by its tool: known or not."""
    calls = scored(spark, sf).select("record_id", F.posexplode(scoring.calls(F.col("turns"))).alias("i", "c"))
    tool = F.col("c.tool_name")
    return calls.select("record_id", (F.col("i") + 1).cast("bigint").alias("n"), tool.alias("tool"), scoring.tool_name_score(tool, scoring.TOOLS).alias("score"))


_Q = "coalesce(pr.quadrant = tr.quadrant, false)"
_T = "coalesce(pr.tooth_position = tr.tooth_position, false)"
_DD = f"coalesce({_D.format('pr')} = {_D.format('tr')}, false)"


@query(f"""WITH {FIRST} SELECT count(*) AS n, round(avg(({_Q} AND {_T})::INT), 6) AS fdi, round(avg({_Q}::INT), 6) AS quadrant, round(avg({_T}::INT), 6) AS position,
    round(avg(({_Q} AND {_T} AND {_DD})::INT), 6) AS exact, round(avg(format_ok::INT), 6) AS format, round(avg(tool_calls), 6) AS mean_tool_calls FROM f""")
def eval_rates(spark: SparkSession, sf: str) -> DataFrame:
    pr, tr = F.col("pr"), F.col("tr")
    q, t = pr["quadrant"] == tr["quadrant"], pr["tooth_position"] == tr["tooth_position"]
    d = scoring.clean(pr["diagnosis"]) == scoring.clean(tr["diagnosis"])
    return first_pairs(spark, sf).agg(F.count("*").alias("n"), metrics.share(q & t).alias("fdi"), metrics.share(q).alias("quadrant"), metrics.share(t).alias("position"), metrics.share(q & t & d).alias("exact"), metrics.share(F.col("format_ok")).alias("format"), F.round(F.avg("tool_calls"), 6).alias("mean_tool_calls"))


_CLASSES = f"""l AS (SELECT coalesce({_D.format('tr')}, 'none') AS y, coalesce(nullif({_D.format('pr')}, ''), 'none') AS z FROM f),
    k AS (SELECT label, count(*) FILTER (WHERE y = z AND side = 0) AS tp, count(*) FILTER (WHERE y <> z AND side = 1) AS fp, count(*) FILTER (WHERE y <> z AND side = 0) AS fn
        FROM (SELECT y AS label, y, z, 0 AS side FROM l UNION ALL SELECT z, y, z, 1 FROM l) GROUP BY label),
    v AS (SELECT label, tp, fp, fn, round(2.0 * tp / (2 * tp + fp + fn), 6)::DOUBLE AS f1, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6)::DOUBLE AS recall FROM k)"""


def _classes(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda c: F.coalesce(F.nullif(scoring.clean(F.col(f"{c}.diagnosis")), F.lit("")), F.lit("none"))
    return metrics.per_class(first_pairs(spark, sf).select(F.coalesce(scoring.clean(F.col("tr.diagnosis")), F.lit("none")).alias("y"), named("pr").alias("z")), "y", "z")


@query(f"WITH {FIRST}, {_CLASSES} SELECT * FROM v")
def per_class_f1(spark: SparkSession, sf: str) -> DataFrame:
    return _classes(spark, sf)


@query(f"WITH {FIRST}, {_CLASSES} SELECT round(avg(f1), 4) AS macro_f1, round(avg(recall), 4) AS balanced_accuracy FROM v")
def macro_f1_balanced_acc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro(_classes(spark, sf))


_EDGES = " + ".join(f"CASE WHEN c > {i / 10} THEN 1 ELSE 0 END" for i in range(11))


@query(f"""WITH {FIRST}, c AS (SELECT pr.confidence AS c, {_DD}::INT::DOUBLE AS ok FROM f WHERE pr.confidence IS NOT NULL), b AS (SELECT {_EDGES} AS b, count(*) AS k, avg(c) AS conf, avg(ok) AS acc FROM c GROUP BY 1)
    SELECT CAST(sum(k) AS BIGINT) AS n, round(sum(CASE WHEN b BETWEEN 1 AND 10 THEN abs(conf - acc) * k ELSE 0 END) / sum(k), 6) AS ece FROM b""")
def ece(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.coalesce(scoring.clean(F.col("pr.diagnosis")) == scoring.clean(F.col("tr.diagnosis")), F.lit(False)).cast("double")
    return metrics.calibration_error(first_pairs(spark, sf), F.col("pr.confidence"), ok)


_HELD = f"""{IMAGES}, {NAMED}, r AS ({splits.ranked_sql('i', 'id', SEED)}), h AS (SELECT id FROM r WHERE rank < floor(n * 0.1)),
    tr AS (SELECT * FROM n WHERE image_id NOT IN (SELECT id FROM h) OR image_id IS NULL),
    mq AS (SELECT q FROM tr GROUP BY q ORDER BY count(*) DESC, q LIMIT 1), mp AS (SELECT p FROM tr GROUP BY p ORDER BY count(*) DESC, p LIMIT 1), md AS (SELECT diagnosis AS d FROM tr WHERE diagnosis IS NOT NULL GROUP BY d ORDER BY count(*) DESC, d LIMIT 1),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY id, c1 NULLS FIRST, c2 NULLS FIRST, c3 NULLS FIRST) AS rn FROM n WHERE image_id IN (SELECT id FROM h)) WHERE rn = 1),
    x AS (SELECT t.q = mq.q AS sq, t.p = mp.p AS sp, lower(coalesce(t.diagnosis, 'Caries')) AS y, lower(md.d) AS z, mq.q AS quadrant, mp.p AS position, md.d AS diagnosis FROM t, mq, mp, md)"""


@query(f"""WITH {_HELD}, k AS (SELECT y, count(*) AS c, avg((y = z)::INT) AS recall FROM x GROUP BY y), s AS (SELECT count(*) AS n, count(*) FILTER (WHERE y = z) AS tp, any_value(z) AS z FROM x),
    labels AS (SELECT y AS l FROM x UNION SELECT z FROM x)
    SELECT any_value(quadrant) AS quadrant, any_value(position) AS position, any_value(diagnosis) AS diagnosis, count(*) AS n, round(avg(sq::INT), 6) AS quadrant_rate, round(avg((sq AND sp)::INT), 6) AS fdi_rate, round(avg((sq AND sp AND y = z)::INT), 6) AS exact_rate,
        round((SELECT avg(recall) FROM k), 4) AS balanced_accuracy, round((SELECT 2.0 * tp / (n + tp) FROM s) / (SELECT count(*) FROM labels), 4) AS macro_f1, round(1 - avg((sq AND sp AND y = z)::INT), 6) AS ece FROM x""")
def majority_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The first finding of each held-out image against the training pool's commonest
    quadrant, position and diagnosis, told with confidence 1: rates, balanced accuracy,
    macro F1 over the labels of either side, and calibration error. An empty pool gives
    way to all annotations; without findings there is no row."""
    n = named_annots(spark, sf)
    held = splits.held_out(images(spark, sf), "id", 0.1, SEED).select(F.col("id").alias("image_id"))
    guess = lambda of: of.agg(F.count("*").alias("k"), F.mode("q", True).alias("q"), F.mode("p", True).alias("p"), F.mode("diagnosis", True).alias("d")).select(F.struct("*").alias("g")).scalar()
    w = W.partitionBy("image_id").orderBy("id", "c1", "c2", "c3")
    first = n.join(held, "image_id", "left_semi").withColumn("rn", F.row_number().over(w)).where("rn = 1")
    pooled, any_ = guess(n.join(held, "image_id", "left_anti")), guess(n)
    t = first.withColumn("g", F.when(pooled["k"] > 0, pooled).otherwise(any_))
    q = F.col("q") == F.col("g.q")
    at = q & (F.col("p") == F.col("g.p"))
    true, told = F.lower(F.coalesce("diagnosis", F.lit("Caries"))), F.lower("g.d")
    x = t.select(F.col("g"), q.alias("sq"), at.alias("at"), true.alias("y"), told.alias("z"), (at & (true == told)).alias("exact"))
    classes = metrics.macro(metrics.per_class(x, "y", "z")).select(F.struct("*").alias("c")).scalar()
    rates = x.groupBy(F.col("g.q").alias("quadrant"), F.col("g.p").alias("position"), F.col("g.d").alias("diagnosis")).agg(
        F.count("*").alias("n"), metrics.share(F.col("sq")).alias("quadrant_rate"), metrics.share(F.col("at")).alias("fdi_rate"), metrics.share(F.col("exact")).alias("exact_rate"), F.round(1 - F.avg(F.coalesce("exact", F.lit(False)).cast("int")), 6).alias("ece")
    )
    return rates.withColumn("c", classes).select("quadrant", "position", "diagnosis", "n", "quadrant_rate", "fdi_rate", "exact_rate", "c.balanced_accuracy", "c.macro_f1", "ece")


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Mean tiered score per image of two runs: the records of even and of odd ids."""
    s = first_pairs(spark, sf).where("image_id is not null").select("image_id", (F.col("record_id") % 2).alias("run"), scoring.tiered_accuracy(F.col("pr"), F.col("tr")).alias("s"))
    per = s.groupBy("image_id", "run").agg(F.avg("s").alias("m"))
    a, b = (per.where(F.col("run") == r).select("image_id", F.col("m").alias(n)) for r, n in ((0, "a"), (1, "b")))
    return a.join(b, "image_id")


_RUNS = f"""s AS (SELECT image_id, record_id % 2 AS run, avg(CASE WHEN {_SAME_Q} AND {_SAME_T} AND {_SAME_D} THEN 1.0 WHEN {_SAME_Q} AND {_SAME_T} THEN 0.5 WHEN {_SAME_Q} THEN 0.25 ELSE 0.0 END::DOUBLE) AS m FROM f WHERE image_id IS NOT NULL GROUP BY 1, 2),
    d AS (SELECT image_id, x.m AS a, y.m AS b FROM s x JOIN s y USING (image_id) WHERE x.run = 0 AND y.run = 1)"""


@query(f"WITH {FIRST}, {_RUNS} SELECT count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) + 0.0 AS mean_difference FROM d")
def paired_diff(spark: SparkSession, sf: str) -> DataFrame:
    return _runs(spark, sf).agg(F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), (F.round(F.avg(F.col("a") - F.col("b")), 6) + F.lit(0.0)).alias("mean_difference"))


def _draws_sql(relation: str, key: str, replicates: int, seed: int, parts: dict[str, str]) -> str:
    """CTEs v (rows) and m (sums per replicate) of a resampling."""
    u = f"({mixed_sql(f'(i * {max(1000, replicates)} + b)', seed)} / 2147483647.0)"
    values = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in parts.items())
    return f"""v AS (SELECT CAST({key} AS BIGINT) AS i, {values} FROM {relation} WHERE {key} IS NOT NULL AND {' AND '.join(f'({e}) IS NOT NULL' for e in parts.values())}),
    w AS (SELECT v.*, b, {metrics.resampling_weight_sql(u)} AS w FROM v, range(1, {replicates + 1}) x(b)), m AS (SELECT b, sum(w)::DOUBLE AS n, {', '.join(f'sum(w * {n}) AS {n}' for n in parts)} FROM w GROUP BY b HAVING sum(w) > 0)"""


def _interval_sql(metric: str, parts: list[str]) -> str:
    return f"SELECT (SELECT count(*) FROM v) AS n, (SELECT round({metric}, 6) FROM (SELECT count(*)::DOUBLE AS n, {', '.join(f'sum({p}) AS {p}' for p in parts)} FROM v)) AS point, (SELECT round(quantile_cont({metric}, 0.025), 6) FROM m) AS low, (SELECT round(quantile_cont({metric}, 0.975), 6) FROM m) AS high"


_BY_IMAGE = "dd AS (SELECT image_id, a - b AS x FROM d)"


@query(f"WITH {FIRST}, {_RUNS}, {_BY_IMAGE}, {_draws_sql('dd', 'image_id', 2000, 0, {'x': 'x'})} SELECT *, low > 0 OR high < 0 AS excludes_zero FROM ({_interval_sql('x / n', ['x'])})")
def paired_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Mean difference of two runs on the images of both, 2000 resamples, and whether
    the interval leaves out 0."""
    got = metrics.bootstrap_mean(_runs(spark, sf), "image_id", F.col("a") - F.col("b"), 2000, 0)
    return got.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


@query(f"WITH {FIRST}, e AS (SELECT record_id, ({_Q} AND {_T} AND {_DD})::INT AS x FROM f), {_draws_sql('e', 'record_id', 1000, 42, {'x': 'x'})} {_interval_sql('x / n', ['x'])}")
def metric_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Share of exact answers, 1000 resamples."""
    pr, tr = F.col("pr"), F.col("tr")
    exact = F.coalesce((pr["quadrant"] == tr["quadrant"]) & (pr["tooth_position"] == tr["tooth_position"]) & (scoring.clean(pr["diagnosis"]) == scoring.clean(tr["diagnosis"])), F.lit(False))
    return metrics.bootstrap_mean(first_pairs(spark, sf), "record_id", exact.cast("double"), 1000, 42)


_KINDS = ["impacted tooth", "caries", "periapical lesion", "deep caries"]
_F1_PARTS = {f"{k}{i}": e for i, d in enumerate(_KINDS) for k, e in ((f"tp", f"(y = '{d}' AND z = '{d}')::INT"), ("fp", f"(y <> '{d}' AND z = '{d}')::INT"), ("fn", f"(y = '{d}' AND z <> '{d}')::INT"))}
_F1_SQL = "(" + " + ".join(f"coalesce(2 * tp{i} / nullif(2 * tp{i} + fp{i} + fn{i}, 0), 0)" for i in range(len(_KINDS))) + f") / {len(_KINDS)}"


@query(f"""WITH {FIRST}, e AS (SELECT record_id, coalesce({_D.format('tr')}, 'none') AS y, coalesce({_D.format('pr')}, 'none') AS z FROM f), {_draws_sql('e', 'record_id', 1000, 42, _F1_PARTS)} {_interval_sql(_F1_SQL, list(_F1_PARTS))}""")
def macro_f1_bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Another metric in the same resampling: macro F1 over the known diagnoses."""
    f = first_pairs(spark, sf).select("record_id", F.coalesce(scoring.clean(F.col("tr.diagnosis")), F.lit("none")).alias("y"), F.coalesce(scoring.clean(F.col("pr.diagnosis")), F.lit("none")).alias("z"))
    parts = {}
    for i, d in enumerate(_KINDS):
        y, z = F.col("y") == d, F.col("z") == d
        parts |= {f"tp{i}": (y & z).cast("int"), f"fp{i}": (~y & z).cast("int"), f"fn{i}": (y & ~z).cast("int")}
    f1 = lambda s: sum((F.coalesce(F.try_divide(2 * s[f"tp{i}"], 2 * s[f"tp{i}"] + s[f"fp{i}"] + s[f"fn{i}"]), F.lit(0.0)) for i in range(len(_KINDS))), F.lit(0.0)) / len(_KINDS)
    return metrics.bootstrap(f, "record_id", parts, f1, 1000, 42)


_FAIL = f"""CASE WHEN NOT format_ok THEN 'format_failure' WHEN {_Q} AND {_T} AND coalesce(lower(pr.diagnosis) = lower(tr.diagnosis), false) THEN 'correct' WHEN {_Q} AND {_T} THEN 'wrong_diagnosis_right_location'
    WHEN coalesce(lower(pr.diagnosis) = lower(tr.diagnosis), false) THEN 'right_diagnosis_wrong_location' ELSE 'wrong_location_and_diagnosis' END"""


@query(f"WITH {FIRST} SELECT {_FAIL} AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS fraction FROM f GROUP BY 1")
def failure_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    f = first_pairs(spark, sf).select(scoring.failure(F.col("format_ok"), F.col("pr"), F.col("tr")).alias("category"))
    per = f.groupBy("category").agg(F.count("*").alias("n"))
    return per.select("category", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("fraction"))  # five rows


@query(f"""WITH {FIRST}, {_CALLS}, x AS (SELECT f.*, coalesce(e.good < e.calls, false) AS bad FROM f LEFT JOIN e USING (record_id)),
    y AS (SELECT CASE WHEN NOT format_ok AND (pr IS NULL OR pr.diagnosis IS NULL) THEN 'format_failure' WHEN pr IS NULL THEN 'early_termination' END AS alone, bad,
        CASE WHEN NOT ({_Q} AND {_T}) THEN 'fdi_localization_error' WHEN NOT ({_DD} AND {_D.format('tr')} <> '') THEN 'pathology_misclassification' ELSE 'success' END AS outcome FROM x),
    z AS (SELECT alone AS category FROM y WHERE alone IS NOT NULL UNION ALL SELECT outcome FROM y WHERE alone IS NULL UNION ALL SELECT 'tool_error' FROM y WHERE alone IS NULL AND bad)
    SELECT category, count(*) AS n FROM z GROUP BY category""")
def failure_multi(spark: SparkSession, sf: str) -> DataFrame:
    bad = F.exists(scoring.calls(F.col("turns")), lambda c: ~F.coalesce(c["tool_ok"], F.lit(False)))
    groups = scoring.failure_groups(F.col("format_ok"), F.col("pr"), F.col("tr"), bad)
    return first_pairs(spark, sf).select(F.explode(groups).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""WITH {FIRST}, {ANNOTS} SELECT DISTINCT image_id FROM f WHERE image_id IN (SELECT image_id FROM a)""")
def evaluated_and_annotated(spark: SparkSession, sf: str) -> DataFrame:
    return first_pairs(spark, sf).select("image_id").intersect(annots(spark, sf).select("image_id")).where("image_id is not null")


@query(f"WITH {FIRST}, {_CLASSES.split(', k AS')[0].rstrip().rstrip(',').split(chr(10) + '    k AS')[0].rstrip(',')} SELECT y AS label FROM l UNION SELECT z FROM l")
def label_union(spark: SparkSession, sf: str) -> DataFrame:
    return _classes(spark, sf).select("label")
