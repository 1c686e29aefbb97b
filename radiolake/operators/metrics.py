"""Evaluation metrics as aggregations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(c: Column) -> Column:
    return F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)


def per_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """label, tp, fp, fn, f1 and recall over the labels of either column."""
    hit = F.coalesce(F.col(true) == F.col(pred), F.lit(False))
    sides = df.select(F.explode(F.array(F.struct(F.col(true).alias("label"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"), (~hit).cast("int").alias("fn")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("tp"), (~hit).cast("int").alias("fp"), F.lit(0).alias("fn")))).alias("s"))
    counts = sides.select("s.*").where("label is not null").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.select("label", "tp", "fp", "fn", F.round(f1, 6).alias("f1"), F.when(F.col("tp") + F.col("fn") > 0, F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 6)).alias("recall"))


def macro(classes: DataFrame) -> DataFrame:
    """macro_f1 over all labels, balanced_accuracy over the labels that truly occur."""
    return classes.agg(F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.avg("recall"), 4).alias("balanced_accuracy"))


def calibration_error(df: DataFrame, confidence: Column, correct: Column, bins: int = 10, least: int = 5) -> DataFrame:
    """n and ece over bins open below and closed above: a confidence of 0 is in no bin
    but counts in n. Null below the least number of rows, 0 for none."""
    c = df.select(confidence.cast("double").alias("c"), correct.cast("double").alias("ok")).where("c is not null and ok is not null")
    # Edges as i / bins, compared one by one: products of floats would miss them.
    at = sum((F.when(F.col("c") > i / bins, 1).otherwise(0) for i in range(bins + 1)), F.lit(0))
    per_bin = c.groupBy(at.alias("b")).agg(F.count("*").alias("k"), F.avg("c").alias("conf"), F.avg("ok").alias("acc"))
    inside = (F.col("b") >= 1) & (F.col("b") <= bins)
    gap = F.sum(F.when(inside, F.abs(F.col("conf") - F.col("acc")) * F.col("k")).otherwise(0.0))
    n = F.coalesce(F.sum("k"), F.lit(0))
    return per_bin.agg(n.alias("n"), F.when(n == 0, 0.0).when(n >= least, F.round(gap / n, 6)).alias("ece"))


#: Chances of a Poisson(1) variable to be at most 0, 1, ... 7.
POISSON = [0.367879441171, 0.735758882343, 0.919698602929, 0.981011843124, 0.996340153173, 0.999405815182, 0.999916758850, 0.999989750803]


def resampling_weight_sql(u: str) -> str:
    return "(" + " + ".join(f"CASE WHEN {u} > {p} THEN 1 ELSE 0 END" for p in POISSON) + ")"


#: Rows whose draws for all replicates are made at a time: bounds a task's memory.
DRAWN_ROWS = 512


def _draws(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """How often each row (axis 1) is drawn in each resample (axis 0): Poisson(1), from a
    hash of row and replicate that SQL engines compute alike."""
    stride = max(1000, replicates)  # a shorter one would give neighbouring ids each other's draws
    at = ids[None, :] * stride + np.arange(1, replicates + 1)[:, None]
    h = (at * 48271 + (seed * 69621 + 12345)) % 2147483647
    u = (h * h + at) % 2147483647 * 48271 % 2147483647 / 2147483647
    return np.searchsorted(np.array(POISSON), u, side="left").astype(np.float64)


def bootstrap(df: DataFrame, row_id: str, parts: dict[str, Column], metric: Callable[[dict[str, Column]], Column], replicates: int, seed: int, share: float = 0.95) -> DataFrame:
    """n, point, low, high: a metric with its percentile interval.

    metric is any function of sums over the rows: it is given the sum of each part and
    of the rows themselves ('n') and gives a Column. Every task draws its rows' weights
    for all replicates, multiplies them with the parts as matrices and gives one row of
    sums per replicate, so nothing else is shuffled. Rows with a null id or part are
    left out. A resample without rows has no value; without rows the result is n = 0.
    """
    names = list(parts)
    sums = ["n", *names]
    v = df.select(F.col(row_id).cast("bigint").alias("__id"), *[c.cast("double").alias(f"_{n}") for n, c in parts.items()]).dropna()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, len(sums)))
        for b in batches:
            ids, x = b["__id"].to_numpy(), np.c_[np.ones(len(b)), b[[f"_{n}" for n in names]].to_numpy()]
            for k in range(0, len(b), DRAWN_ROWS):
                total += _draws(ids[k : k + DRAWN_ROWS], replicates, seed) @ x[k : k + DRAWN_ROWS]
        yield pd.DataFrame(total, columns=[f"_{n}" for n in sums]).assign(__rep=np.arange(replicates))

    drawn = v.mapInPandas(run, ", ".join(f"_{n} double" for n in sums) + ", __rep long").groupBy("__rep").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    value = metric({n: F.col(f"_{n}") for n in sums})
    low = (1 - share) / 2
    ends = drawn.where("_n > 0").agg(F.struct(F.round(F.percentile(value, low), 6).alias("low"), F.round(F.percentile(value, 1 - low), 6).alias("high")).alias("e")).scalar()  # as many values as replicates
    point = v.agg(F.count("*").cast("double").alias("_n"), *[F.sum(f"_{n}").alias(f"_{n}") for n in names])
    return point.select(F.col("_n").cast("bigint").alias("n"), F.when(F.col("_n") > 0, F.round(value, 6)).alias("point"), ends.alias("e")).select("n", "point", "e.low", "e.high")


def bootstrap_mean(df: DataFrame, row_id: str, value: Column, replicates: int, seed: int) -> DataFrame:
    """n, point, low, high: the mean with its 95 % percentile interval."""
    return bootstrap(df, row_id, {"v": value}, lambda s: s["v"] / s["n"], replicates, seed)


def with_advantage(df: DataFrame, reward: str, group: str, places: int = 6) -> DataFrame:
    """df plus advantage, to be rounded here only: rounding it again would move values just
    below a half. Groups are aggregated map-side and joined back, so a hot group costs no
    single task (adaptive execution splits its join side)."""
    g = df.groupBy(group).agg(F.avg(reward).alias("_mean"), F.stddev_pop(reward).alias("_std")).withColumnRenamed(group, "_g")
    joined = df.join(g, F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn("advantage", F.round((F.col(reward) - F.col("_mean")) / (F.col("_std") + 1e-4), places)).drop("_g", "_mean", "_std")
