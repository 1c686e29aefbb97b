"""Scores of nested trajectories, as expressions without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_INTS = "array<int>"
# Tools that cost nothing, and their like that cost a fifth.
FREE_TOOLS = ("locate_tooth", "nudge_crop")
CHEAP_TOOLS = ("fdi_label",)
# All tools.
TOOLS = ["locate_tooth", "zoom_crop", "nudge_crop", "window_level", "denoise", "enhance_contrast", "contralateral_compare", "fdi_label"]
# The default weights, and the weight vectors of the sweep in the same order.
WEIGHTS = {"accuracy": 1.0, "format": 0.2, "validity": 0.2, "efficiency": 0.1}
GRID = [(1.0, 0.2, 0.2, 0.1), (1.0, 0.0, 0.0, 0.0), (1.0, 0.1, 0.4, 0.1), (1.0, 0.4, 0.1, 0.1), (0.7, 0.2, 0.2, 0.1)]


def clean(c: Column) -> Column:
    return F.lower(F.trim(c))


def calls(turns: Column) -> Column:
    """All tool calls of a trajectory in order; null turns and calls fall away."""
    per_turn = F.transform(F.filter(turns, lambda t: t.isNotNull()), lambda t: F.filter(F.coalesce(t["tool_calls_this_turn"], F.array()), lambda c: c.isNotNull()))
    return F.coalesce(F.flatten(per_turn), F.array())


def format_score(format_ok: Column, answer: Column) -> Column:
    return F.when(F.coalesce(format_ok, F.lit(False)) & (F.coalesce(F.size(answer), F.lit(0)) > 0), 1.0).otherwise(0.0)


def validity_score(c: Column) -> Column:
    """Share of calls that went well; 1 without calls."""
    good = F.size(F.filter(c, lambda x: F.coalesce(x["tool_ok"], F.lit(False))))
    return F.when(F.size(c) > 0, good / F.size(c)).otherwise(1.0)


def call_key(c: Column) -> Column:
    """A call's tool and its arguments in the order of their names."""
    return F.concat_ws("|", F.coalesce(c["tool_name"], F.lit("")), F.to_json(F.array_sort(F.map_entries(F.coalesce(c["tool_args"], F.create_map().cast("map<string,string>"))))))


def billable(c: Column) -> Column:
    """Cost of the calls: free and cheap tools count less, an exact repeat of the call
    before counts five times. Free calls cost nothing but are remembered."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        key = call_key(x)
        cost = F.when(x["tool_name"].isin(*FREE_TOOLS), 0.0).when(x["tool_name"].isin(*CHEAP_TOOLS), 0.2).otherwise(1.0)
        again = F.when(F.coalesce(acc["last"] == key, F.lit(False)), 5.0).otherwise(1.0)
        return F.struct(key.alias("last"), (acc["sum"] + cost * again).alias("sum"))

    return F.aggregate(c, start, step, lambda acc: acc["sum"])


def located(c: Column) -> Column:
    """Distinct teeth that a call located."""
    hits = F.filter(c, lambda x: (x["tool_name"] == "locate_tooth") & F.coalesce(x["tool_ok"], F.lit(False)))
    return F.array_distinct(F.filter(F.transform(hits, lambda x: x["tool_args"]["tooth"].try_cast("int")), lambda t: t.isNotNull()))


def efficiency_score(c: Column, most: int = 50, per_finding: int = 6) -> Column:
    budget = F.least(F.lit(most), F.greatest(F.size(located(c)), F.lit(1)) * per_finding)
    over = billable(c) - budget
    return F.when(F.size(c) == 0, 1.0).when(over <= 0, 1.0).otherwise(1.0 / (1.0 + over / F.greatest(budget, F.lit(1))))


def pair_score(p: Column, g: Column) -> Column:
    """A quarter each for quadrant and position, half for the diagnosis."""
    same = lambda n: F.when(F.coalesce(p[n] == g[n], F.lit(False)), 0.25).otherwise(0.0)
    named = F.coalesce((clean(p["diagnosis"]) != "") & (clean(p["diagnosis"]) == clean(g["diagnosis"])), F.lit(False))
    return same("quadrant") + same("tooth_position") + F.when(named, 0.5).otherwise(0.0)


def matched_total(preds: Column, gts: Column) -> Column:
    """Greedy one-to-one matching, best pair first, ties by position."""
    pairs = F.flatten(F.transform(preds, lambda p, i: F.transform(gts, lambda g, j: F.struct((-pair_score(p, g)).alias("s"), i.alias("i"), j.alias("j")))))
    start = F.struct(F.array().cast(NO_INTS).alias("p"), F.array().cast(NO_INTS).alias("g"), F.lit(0.0).alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.array_contains(acc["p"], x["i"]) | F.array_contains(acc["g"], x["j"])
        return F.when(taken, acc).otherwise(F.struct(F.concat(acc["p"], F.array(x["i"])).alias("p"), F.concat(acc["g"], F.array(x["j"])).alias("g"), (acc["sum"] - x["s"]).alias("sum")))

    return F.aggregate(F.array_sort(pairs), start, step, lambda acc: acc["sum"])


def present(findings: Column) -> Column:
    return F.filter(F.coalesce(findings, F.array()), lambda f: f.isNotNull())


def accuracy_score(preds: Column, gts: Column) -> Column:
    """Harmonic mean of matched share of predictions and of truths; with no truths 1
    if there are no predictions either, else 0."""
    p, g = present(preds), present(gts)
    # F1 of sum / n and sum / m is 2 sum / (n + m).
    return F.when(F.size(g) == 0, F.when(F.size(p) == 0, 1.0).otherwise(0.0)).when(F.size(p) == 0, 0.0).otherwise(2 * matched_total(p, g) / (F.size(p) + F.size(g)))


def composite(scores: dict[str, Column], weights: dict[str, float | Column] | None = None) -> Column:
    weights = weights or WEIGHTS
    total = F.lit(0.0)
    for n, w in weights.items():
        total = total + scores[n] * (F.lit(w) if isinstance(w, float) else w)
    return total


def tiered_accuracy(p: Column, g: Column) -> Column:
    """1, 0.5, 0.25 or 0 for all, the tooth, the quadrant or nothing right."""
    q, t = p["quadrant"].eqNullSafe(g["quadrant"]), p["tooth_position"].eqNullSafe(g["tooth_position"])
    d = F.coalesce(clean(p["diagnosis"]), F.lit("none")) == F.coalesce(clean(g["diagnosis"]), F.lit("none"))
    return F.when(q & t & d, 1.0).when(q & t, 0.5).when(q, 0.25).otherwise(0.0)


def call_count_score(n: Column) -> Column:
    return F.when(n == 0, -0.2).when(n <= 4, n * 0.1).otherwise(0.4 - (n - 4) * 0.5)


def overrun_penalty(n: Column, budget: int = 4, each: float = 0.1) -> Column:
    """Minus a share for each call beyond the budget; 0 within it."""
    return -F.greatest(n - budget, F.lit(0)) * each + F.lit(0.0)


def tool_name_score(tool: Column, known: list[str]) -> Column:
    return F.when(F.coalesce(tool.isin(known), F.lit(False)), 0.2).otherwise(-0.5)


def failure(format_ok: Column, p: Column, g: Column) -> Column:
    place = F.coalesce((p["quadrant"] == g["quadrant"]) & (p["tooth_position"] == g["tooth_position"]), F.lit(False))
    diag = F.coalesce(F.lower(p["diagnosis"]) == F.lower(g["diagnosis"]), F.lit(False))
    return (
        F.when(~F.coalesce(format_ok, F.lit(False)), "format_failure")
        .when(place & diag, "correct")
        .when(place, "wrong_diagnosis_right_location")
        .when(diag, "right_diagnosis_wrong_location")
        .otherwise("wrong_location_and_diagnosis")
    )


def failure_groups(format_ok: Column, p: Column, g: Column, tool_failed: Column) -> Column:
    """The groups of one trajectory; a failed tool comes beside the diagnostic group."""
    answered = p.isNotNull() & F.coalesce(p["diagnosis"].isNotNull(), F.lit(False))
    place = F.coalesce((p["quadrant"] == g["quadrant"]) & (p["tooth_position"] == g["tooth_position"]), F.lit(False))
    diag = F.coalesce((clean(g["diagnosis"]) != "") & (clean(p["diagnosis"]) == clean(g["diagnosis"])), F.lit(False))
    outcome = F.when(~place, "fdi_localization_error").when(~diag, "pathology_misclassification").otherwise("success")
    alone = F.when(~F.coalesce(format_ok, F.lit(False)) & ~answered, F.array(F.lit("format_failure"))).when(p.isNull(), F.array(F.lit("early_termination")))
    return F.coalesce(alone, F.when(tool_failed, F.array(F.lit("tool_error"), outcome)).otherwise(F.array(outcome)))


def detections(preds: Column, gts: Column, score: str, overlap, cutoff: float = 0.5) -> Column:
    """struct(tp, fp, fn): predictions by falling score, each held against its best
    truth not yet matched. It is a hit if the overlap reaches the cutoff and quadrant
    and position agree; a miss takes no truth and tries no second."""
    ordered = F.transform(F.array_sort(F.transform(preds, lambda p, i: F.struct((-p[score]).alias("s"), i.alias("i"), p.alias("p")))), lambda x: x["p"])
    start = F.struct(F.array().cast(NO_INTS).alias("used"), F.lit(0).alias("tp"), F.lit(0).alias("fp"))

    def step(acc: Column, p: Column) -> Column:
        free = F.filter(F.transform(gts, lambda g, j: F.struct((-overlap(p, g)).alias("o"), j.alias("j"), ((p["quadrant"] == g["quadrant"]) & (p["tooth_position"] == g["tooth_position"])).alias("same"))), lambda x: ~F.array_contains(acc["used"], x["j"]))
        best = F.array_min(free)
        hit = F.coalesce((best["o"] <= -cutoff) & best["same"], F.lit(False))
        return F.when(hit, F.struct(F.concat(acc["used"], F.array(best["j"])).alias("used"), (acc["tp"] + 1).alias("tp"), acc["fp"].alias("fp"))).otherwise(F.struct(acc["used"].alias("used"), acc["tp"].alias("tp"), (acc["fp"] + 1).alias("fp")))

    return F.aggregate(ordered, start, step, lambda acc: F.struct(acc["tp"].alias("tp"), acc["fp"].alias("fp"), (F.size(gts) - acc["tp"]).alias("fn")))


def box_hint(gts: Column, tooth: Column) -> Column:
    """The box of the first true finding at a tooth (two-digit number) that has one."""
    there = F.filter(gts, lambda f: (f["quadrant"] == F.floor(tooth / 10)) & (f["tooth_position"] == tooth % 10) & f["bbox"].isNotNull())
    return F.when(tooth.between(10, 99), F.get(there, 0)["bbox"])
