"""Running totals and ranks over groups of any size.

A window over one group runs in one task. Here a group is cut into hash buckets:
the buckets' totals are added up first (at most `buckets` rows a group), then each
bucket is summed on its own from its offset. The order is (bucket, order columns),
a deterministic pseudorandom one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 65_536


def mixed(c: Column, seed: int) -> Column:
    """The integer mixer that Spark and SQL engines compute alike (ids below 10^13)."""
    i = c.cast("bigint")
    h = (i * F.lit(48271).cast("bigint") + F.lit(seed * 69621 + 12345).cast("bigint")) % 2147483647
    h = (h * h + i) % 2147483647
    return (h * 48271) % 2147483647


def mixed_sql(i: str, seed: int) -> str:
    """The same as SQL over a BIGINT expression."""
    h = f"((({i}) * CAST(48271 AS BIGINT) + {seed * 69621 + 12345}) % 2147483647)"
    return f"(((({h} * {h} + ({i})) % 2147483647) * 48271) % 2147483647)"


def running_total(df: DataFrame, groups: list[str], order: list[str], weight: Column, out: str, buckets: int = BUCKETS, seed: int = 0, bucket: Column | None = None, whole: str | None = None) -> DataFrame:
    """df plus out: the total of weight over the rows of the group before this one, and,
    if named, whole: the total over all rows of the group.

    order must be unique within a group, else ties are broken arbitrarily. bucket, if
    given, must not fall as order rises; the order is then that of the columns alone. Rows with
    a null group form a group of their own. An empty df gives an empty result.
    """
    b = df.withColumn("__rt_b", bucket if bucket is not None else F.pmod(F.xxhash64(F.lit(seed), *order), F.lit(buckets))).withColumn("__rt_w", weight)
    per = b.groupBy(*groups, "__rt_b").agg(F.sum("__rt_w").alias("__rt_sum"))
    before = W.partitionBy(*groups).orderBy("__rt_b").rowsBetween(W.unboundedPreceding, -1)
    per = per.withColumn("__rt_off", F.coalesce(F.sum("__rt_sum").over(before), F.lit(0))).withColumn("__rt_all", F.sum("__rt_sum").over(W.partitionBy(*groups))).drop("__rt_sum")
    names = [f"__rt_g{i}" for i in range(len(groups))]
    per = per.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], F.col("__rt_b").alias("__rt_pb"), "__rt_off", "__rt_all")
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names)], F.col("__rt_b") == F.col("__rt_pb"))
    within = W.partitionBy(*groups, "__rt_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    joined = b.join(per, same)
    total = F.col("__rt_off") + F.coalesce(F.sum("__rt_w").over(within), F.lit(0))
    out_ = joined.withColumn(out, total)
    return (out_.withColumn(whole, F.col("__rt_all")) if whole else out_).drop("__rt_b", "__rt_w", "__rt_pb", "__rt_off", "__rt_all", *names)


def id_ranges(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """The range bucket of an integer column: as many ranges of equal width as fit
    between its least and greatest value, at most `buckets`. Of distinct ids none can
    hold more than its width. The width is a scalar subquery."""
    width = df.agg(F.greatest(F.lit(1), F.ceil((F.max(column) - F.min(column) + 1) / buckets)).cast("bigint").alias("w")).scalar()
    return F.floor(F.col(column) / width)
