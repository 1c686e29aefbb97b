"""The best representative of each duplicate group, built field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Texts that only say that there is no value, after trimming and lower-casing.
NO_VALUE = ["", "-", "--", "?", "??", "n/a", "n.a.", "na", "nan", "nil", "none", "null", "undefined", "unknown", "missing", "not available", "<na>"]
# The two states of a trace record, letters only, in order of preference.
STATES = ["unverified", "generationfailed"]


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def has_value(c: Column) -> Column:
    """False for null, blank and texts that only say there is none; never null."""
    return F.coalesce(~F.lower(trimmed(c)).isin(NO_VALUE), F.lit(False))


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]", "")


def has_diagnosis(c: Column) -> Column:
    """True if an entry of the array of structs has a real diagnosis; never null."""
    return F.coalesce(F.exists(c, lambda x: has_value(x["diagnosis"])), F.lit(False))


def field_winners(df: DataFrame, group: str, record: str, fields: dict[str, tuple[Column, Column]], order: list[Column]) -> DataFrame:
    """group, field_name, record, value: the record that supplies each surviving field.

    fields: name -> (is it a real value, the value as text). order ranks the records
    of a group, best first, and must end with the record id, so that ties are
    decided; exact repeats of a record are one. Only groups with at least two
    different records count; rows with a null group or record are left out. A field
    without real value gives no row.

    The top-1 window is planned as a group limit before the shuffle, so of a hot
    group each task sends one row a field and not the group.
    """
    keys = [F.col(group).alias("_group"), F.col(record).alias("_record")]
    ranked = df.where(F.col(group).isNotNull() & F.col(record).isNotNull())
    offers = F.array(*[F.struct(F.lit(n).alias("field_name"), real.alias("real"), value.alias("value")) for n, (real, value) in fields.items()])
    ranks = [o.alias(f"_o{i}") for i, o in enumerate(order)]
    exploded = ranked.select(*keys, *ranks, F.explode(F.filter(offers, lambda x: x["real"])).alias("_x"))
    best = W.partitionBy("_group", "_field").orderBy(*[F.col(f"_o{i}").asc_nulls_last() for i in range(len(order))])
    top = exploded.select("_group", "_record", F.col("_x.field_name").alias("_field"), F.col("_x.value").alias("_value"), *[f"_o{i}" for i in range(len(order))]).withColumn("_rn", F.row_number().over(best)).where("_rn = 1")
    several = ranked.groupBy(F.col(group).alias("_group")).agg(F.min(record).alias("_lo"), F.max(record).alias("_hi")).where("_lo < _hi").select("_group")
    return top.join(several, "_group", "left_semi").select(F.col("_group").alias(group), F.col("_field").alias("field_name"), F.col("_record").alias(record), F.col("_value").alias("value"))


def survivors(winners: DataFrame, group: str, record: str, fields: list[str]) -> DataFrame:
    """One row per group: each field's surviving value and the record it came from."""
    picks = []
    for f in fields:
        mine = F.col("field_name") == f
        picks += [F.max(F.when(mine, F.col("value"))).alias(f), F.max(F.when(mine, F.col(record))).alias(f"{f}_{record}")]
    return winners.groupBy(group).agg(*picks)
