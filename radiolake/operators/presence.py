"""References checked against what was there at the time, and orphans handed down.

as_of_presence answers, for a reference (key, t), whether any row of the key was
present at t. It is a sweep, not a join of references with target rows: a key with a
third of both still costs one pass, as each key is split by minutes and every minute
starts from the carried state of the ones before.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..runtime import cut_lineage

NEVER = 2**62
MINUTE = 60_000_000


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def as_of_presence(refs: DataFrame, key: str, at: str, targets: DataFrame, target_key: str, start: str, end: str, bucket: int = MINUTE) -> DataFrame:
    """refs plus reason: null (good), 'missing', 'deleted' or 'late'.

    A target row is present at t if start <= t and end is null or > t. Rows of refs
    with a null key are no references and are left out. A null start never comes; a
    null t is only held against existence, so it gives 'missing' or good.
    Empty targets make every reference 'missing'.

    Each (key, t) is asked once, however many references share it, and the answers are
    joined back. Within a bucket of time there are then at most as many questions as
    microseconds, and of a key's buckets as many as its time has minutes: neither
    grows with the number of references.
    """
    t_of = F.coalesce(micros(F.col(at)), F.lit(NEVER))
    rows = refs.where(F.col(key).isNotNull()).withColumn("__k", F.col(key)).withColumn("__t", t_of)
    r = rows.select(F.col("__k").alias("k"), F.col("__t").alias("t")).distinct().withColumn("b", F.floor(F.col("t") / bucket))
    g = targets.where(F.col(target_key).isNotNull()).select(
        F.col(target_key).alias("k"), F.coalesce(micros(F.col(start)), F.lit(NEVER)).alias("t"), F.coalesce(micros(F.col(end)), F.lit(NEVER + 1)).alias("e")
    )
    g = g.groupBy("k", "t").agg(F.max("e").alias("e")).withColumn("b", F.floor(F.col("t") / bucket))
    asked = r.groupBy("k", "b").agg(F.lit(True).alias("asked"))
    spans = (
        g.select("k", "b", "e", F.lit(False).alias("asked"))
        .unionByName(asked.select("k", "b", F.lit(None).cast("long").alias("e"), "asked"))
        .groupBy("k", "b")
        .agg(F.max("e").alias("e"), F.max("asked").alias("asked"))
    )
    whole = W.partitionBy("k")
    before = whole.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    carry = spans.withColumn("carry", F.max("e").over(before)).withColumn("known", F.max(F.col("e").isNotNull()).over(whole)).where("asked")
    none = F.lit(None)
    events = (
        g.select("k", "b", "t", F.lit(0).alias("kind"), "e", none.cast("boolean").alias("known"))
        .unionByName(carry.select("k", "b", F.lit(-NEVER).alias("t"), F.lit(0).alias("kind"), F.col("carry").alias("e"), "known"))
        .unionByName(r.select("k", "b", "t", F.lit(1).alias("kind"), none.cast("long").alias("e"), none.cast("boolean").alias("known")))
    )
    so_far = W.partitionBy("k", "b").orderBy("t", "kind").rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumn("top", F.max("e").over(so_far)).withColumn("known", F.max("known").over(so_far)).where("kind = 1")
    reason = (
        F.when(~F.coalesce("known", F.lit(False)), "missing")
        .when(F.col("t") == NEVER, F.lit(None))
        .when(F.col("top").isNull(), "late")
        .when(F.col("top") <= F.col("t"), "deleted")
    )
    bad = seen.select(F.col("k").alias("__k"), F.col("t").alias("__t"), reason.alias("reason")).where("reason is not null")
    return rows.join(bad, ["__k", "__t"], "left").select(*[F.col(f"`{c}`") for c in refs.columns], "reason")


@dataclass(frozen=True, eq=False)
class Reference:
    """An edge of the foreign-key graph. key and parent_key are Columns over the
    child's and the parent's rows; period groups the report."""

    child: str
    child_id: str
    key: Column
    at: str
    parent: str
    parent_id: str | None
    parent_key: Column
    start: str
    end: str


def orphans(tables: dict[str, DataFrame], graph: list[Reference]) -> DataFrame:
    """table_name, record_id, period (month), kind ('direct' or 'inherited'), reason.

    Direct orphans come from as_of_presence on every edge. They then cascade: a child
    of an orphaned record, direct or inherited, is an inherited orphan, by semi-joins
    down the graph until no record is new. On an acyclic graph the longest path bounds
    the rounds, so the plan stays lazy; on a cyclic one each round is materialised
    and the loop ends at the fixpoint. What a record is, is decided when all rounds are
    in: one that is a direct orphan is never reported as inherited as well. The rows of
    a record differ in month and reason only, so a record is a small group. Null keys and
    ids give no row.
    """
    keyed = {}
    direct = []
    month = F.date_trunc("month", F.col("at").cast("timestamp")).cast("date").alias("period")
    for e in graph:
        child = tables[e.child].select(F.col(e.child_id).alias("record_id"), e.key.alias("k"), F.col(e.at).alias("at"))
        keyed[e] = child
        parent = tables[e.parent].select(e.parent_key.alias("k"), F.col(e.start).alias("start"), F.col(e.end).alias("end"))
        found = as_of_presence(child, "k", "at", parent, "k", "start", "end").where("reason is not null and record_id is not null")
        direct.append(found.select(F.lit(e.child).alias("table_name"), "record_id", month, F.lit("direct").alias("kind"), "reason"))
    reached = reduce(DataFrame.unionByName, direct).distinct()
    frontier = reached
    depth = _longest_path(graph)
    rounds = 0
    while depth is None or rounds < depth - 1:
        steps = []
        for e in graph:
            if e.parent_id is None:
                continue
            bad = frontier.where(F.col("table_name") == e.parent).select(F.col("record_id").alias("k")).distinct()
            hit = keyed[e].where("record_id is not null").join(bad, "k", "left_semi")
            steps.append(hit.select(F.lit(e.child).alias("table_name"), "record_id", month, F.lit("inherited").alias("kind"), F.lit(f"orphan in {e.parent}").alias("reason")))
        if not steps:
            break
        new = reduce(DataFrame.unionByName, steps).distinct()
        rounds += 1
        if depth is None:
            new = cut_lineage(new.join(reached.select("table_name", "record_id").distinct(), ["table_name", "record_id"], "left_anti"))
            if new.isEmpty():
                break
        reached = reached.unionByName(new)
        frontier = new
    told = F.collect_set(F.struct("kind", "period", "reason"))
    of_record = reached.groupBy("table_name", "record_id").agg(told.alias("x"), F.bool_or(F.col("kind") == "direct").alias("direct"))
    rows = of_record.select("table_name", "record_id", "direct", F.explode("x").alias("x")).where("not direct or x.kind = 'direct'")
    return rows.select("table_name", "record_id", "x.period", "x.kind", "x.reason")


def _longest_path(graph: list[Reference]) -> int | None:
    """Edges on the longest path, or None if the graph has a cycle."""
    below: dict[str, list[str]] = {}
    for e in graph:
        below.setdefault(e.parent, []).append(e.child)

    def walk(node: str, path: tuple[str, ...]) -> int | None:
        if node in path:
            return None
        ends = [walk(c, (*path, node)) for c in below.get(node, [])]
        return None if None in ends else 1 + max(ends, default=-1)

    lengths = [walk(n, ()) for n in below]
    return None if None in lengths else max(lengths, default=0)
