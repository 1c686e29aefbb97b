"""Rate limits audited over logs of calls. Reports what would have waited, by the
observed times; it doesn't move later calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import running_total


def rolling_count(df: DataFrame, keys: list[str], micros: str, span_s: int, out: str) -> DataFrame:
    """df plus out: rows of the keys within the span up to and including this row's time.

    Keys are cut into time buckets as long as the span; each row also goes, as
    context, to the next bucket. So a key with a third of all rows is spread over
    its buckets, at the cost of at most two copies a row.
    """
    span = span_s * 1_000_000
    b = df.withColumn("__rc_b", F.floor(F.col(micros) / span))
    both = b.withColumn("__rc_own", F.lit(True)).unionByName(b.withColumn("__rc_b", F.col("__rc_b") + 1).withColumn("__rc_own", F.lit(False)))
    w = W.partitionBy(*keys, "__rc_b").orderBy(micros).rangeBetween(-span, 0)
    return both.withColumn(out, F.count("*").over(w)).where("__rc_own").drop("__rc_b", "__rc_own")


def since_last(df: DataFrame, keys: list[str], micros: str, tie: list[str], out: str, bucket_s: int = 3600) -> DataFrame:
    """df plus out: microseconds since the key's row before, null for the first.

    Within a time bucket by lag, across buckets by the last time of the buckets before.
    """
    b = df.withColumn("__sl_b", F.floor(F.col(micros) / (bucket_s * 1_000_000)))
    last = b.groupBy(*keys, "__sl_b").agg(F.max(micros).alias("__sl_t"))
    last = last.withColumn("__sl_before", F.lag("__sl_t").over(W.partitionBy(*keys).orderBy("__sl_b"))).drop("__sl_t")
    w = W.partitionBy(*keys, "__sl_b").orderBy(micros, *tie)
    return b.join(last, [*keys, "__sl_b"]).withColumn(out, F.col(micros) - F.coalesce(F.lag(micros).over(w), F.col("__sl_before"))).drop("__sl_b", "__sl_before")


def daily_number(df: DataFrame, keys: list[str], day: str, micros: str, tie: list[str], out: str) -> DataFrame:
    """df plus out: the number of the row among its key's rows of the day, from 1."""
    minute = F.floor(F.col(micros) / 60_000_000)
    return running_total(df, [*keys, day], [micros, *tie], F.lit(1), out, bucket=minute).withColumn(out, F.col(out) + 1)


def audit(df: DataFrame, provider: str, role: str, micros: str, tie: list[str], cooldown_s: int, per_span: int, span_s: int, per_day: int, hard_cap: int) -> DataFrame:
    """Per provider and day: calls, and how many a cooldown, the rolling limit of the
    role and the daily cap (the lower of both) would have held back."""
    day = F.floor(F.col(micros) / 86_400_000_000).cast("int")
    c = df.withColumn("day", day)
    c = since_last(c, [provider], micros, tie, "gap")
    c = rolling_count(c, [provider, role], micros, span_s, "recent")
    c = daily_number(c, [provider], "day", micros, tie, "number")
    return c.groupBy(provider, "day").agg(
        F.count("*").alias("calls"),
        F.count_if(F.col("gap") < cooldown_s * 1_000_000).alias("in_cooldown"),
        F.count_if(F.col("recent") > per_span).alias("over_rolling"),
        F.count_if(F.col("number") > min(per_day, hard_cap)).alias("over_daily"),
        F.max("recent").alias("most_recent"),
    )


def round_robin(df: DataFrame, micros: str, tie: list[str], keys: int, per_minute: int, per_day: int, margin: float = 0.95) -> DataFrame:
    """Per key and day: calls, and how many came too soon after the key's call before or
    above its daily cap, if calls are dealt to the keys in turn. Rates are cut by the
    margin, to 1 at least. The global number of a call is counted by minutes."""
    rate, cap = max(1, int(per_minute * margin)), max(1, int(per_day * margin))
    dealt = running_total(df, [], [micros, *tie], F.lit(1), "_nr", bucket=F.floor(F.col(micros) / 60_000_000)).withColumn("key", F.col("_nr") % keys)
    c = dealt.withColumn("day", F.floor(F.col(micros) / 86_400_000_000).cast("int"))
    c = since_last(c, ["key"], micros, tie, "gap")
    c = daily_number(c, ["key"], "day", micros, tie, "number")
    return c.groupBy("key", "day").agg(F.count("*").alias("calls"), F.count_if(F.col("number") > cap).alias("over_cap"), F.count_if(F.col("gap") < 60_000_000 // rate).alias("waited"))


def calls_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
