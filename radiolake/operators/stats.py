"""Descriptive statistics of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import id_ranges, running_total


def value_counts(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))


#: Accuracy of the sketch that brackets a quantile before it is counted out.
SKETCH = 10_000


def quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], accuracy: int = SKETCH) -> DataFrame:
    """name, p, value: exact quantiles (interpolated between neighbours) of each value.

    A sketch first brackets each quantile by ranks 2 / accuracy away. The second pass
    counts what lies below the bracket and the values within it, map-side, so the one
    sort that ranks them holds about 4 / accuracy of the rows, and spills. Nulls are
    left out; a value without rows has no row in the result.
    """
    cols = list(values)
    v = df.select(*[c.cast("double").alias(n) for n, c in values.items()])
    off = 2 / accuracy
    ends = lambda n, p: F.struct(
        F.lit(n).alias("name"), F.lit(p).alias("p"), F.count(n).alias("n"),
        (F.min(n) if p <= off else F.percentile_approx(n, p - off, accuracy)).alias("lo"), (F.max(n) if p >= 1 - off else F.percentile_approx(n, p + off, accuracy)).alias("hi"),
    )
    bracket = v.agg(*[ends(n, p).alias(f"b{i}_{j}") for i, n in enumerate(cols) for j, p in enumerate(probs)])
    one = bracket.select(F.struct("*").alias("s")).scalar()
    marks = [
        F.struct(F.lit(n).alias("name"), F.lit(p).alias("p"), b["n"].alias("n"), F.when(F.col(n) >= b["lo"], F.col(n)).alias("v"), (F.col(n).isNotNull() & (F.col(n) <= b["hi"])).alias("in"))
        for i, n in enumerate(cols)
        for j, p in enumerate(probs)
        for b in (F.col("_s")[f"b{i}_{j}"],)
    ]
    counted = v.select("*", one.alias("_s")).select(F.inline(F.array(*marks))).where("in").groupBy("name", "p", "n", "v").agg(F.count("*").alias("k"))
    order = W.partitionBy("name", "p").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("k").over(order)
    at = F.col("p") * (F.col("n") - 1)
    covers = lambda i: (F.col("upto") > i) & (F.col("upto") - F.col("k") <= i)
    ranked = counted.withColumn("upto", upto)
    low, high = F.max(F.when(covers(F.floor(at)), F.col("v"))), F.max(F.when(covers(F.ceil(at)), F.col("v")))
    part = F.max(at - F.floor(at))
    return ranked.groupBy("name", "p").agg((low + (high - low) * part).alias("value"))


def describe(df: DataFrame, c: Column) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (interpolated) and greatest."""
    q = quantiles(df, {"v": c}, [0.25, 0.5, 0.75]).agg(*[F.round(F.max(F.when(F.col("p") == p, F.col("value"))), 6).alias(n) for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]).select(F.struct("*").alias("q")).scalar()
    whole = df.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_samp(c), 6).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"))
    return whole.withColumn("_q", q).select("n", "mean", "std", "least", *[F.col("_q")[n].alias(n) for n in ("q25", "q50", "q75")], "greatest")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts with a column per value (spaces as underscores); nulls are left out."""
    counted = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    cells = [F.count_if(F.col(column) == v).alias(v.lower().replace(" ", "_")) for v in values]
    return counted.groupBy(row).agg(*cells)


def histogram(df: DataFrame, c: Column, bins: int) -> DataFrame:
    """bin, n over equal bins from the least to the greatest value, the last one closed."""
    v = df.select(c.cast("double").alias("v")).where("v is not null")
    ends = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).select(F.struct("*").alias("e")).scalar()
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("v") - F.col("e.lo")) / width), F.lit(bins - 1))).cast("int")
    return v.withColumn("e", ends).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def bounded_lists(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, most: int) -> DataFrame:
    """keys, part, name: the values of each key as lists in the given order, at most
    `most` to a list; longer ones go on in the next part. Keys with few rows, which is
    what one list is for, have part 0 only. A hot key is numbered by ranges of its
    first order column, so none of its tasks holds all of it."""
    numbered = running_total(df.withColumn("_v", value), keys, order, F.lit(1), "_at", bucket=id_ranges(df, order[0]))
    parts = numbered.withColumn("part", F.floor(F.col("_at") / most)).groupBy(*keys, "part")
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias(name))


def diagnosis_column(columns: list[str]) -> str | None:
    return next((c for c in ("category_id_3", "category_id") if c in columns), None)
