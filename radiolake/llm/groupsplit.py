"""Splits that keep related records together.

Linked ids are joined by a distributed union-find: every task joins the links it
reads into local forests; forests are then merged level by level over fewer and
fewer tasks. Nodes that no forest has as a root are parked with their parent, so
only roots go on. Groups are then dealt to the splits largest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import running_total
from ..runtime import cut_lineage

#: Links that one task joins at a time: bounds its memory, not the result.
TASK_LINKS = 500_000


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links a, b with the priorities pa, pb -> node, root, p (the root's priority)."""
    up: dict[int, int] = {}
    prio: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while up[top] != top:
            top = up[top]
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def flush() -> pd.DataFrame:
        rows = [(x, r, prio[r]) for x in up if (r := find(x)) != x]
        up.clear()
        prio.clear()
        return pd.DataFrame(rows, columns=["node", "root", "p"])

    held = 0
    for batch in batches:
        for a, b, pa, pb in zip(batch["a"].tolist(), batch["b"].tolist(), batch["pa"].tolist(), batch["pb"].tolist()):
            up.setdefault(a, a)
            up.setdefault(b, b)
            prio[a], prio[b] = pa, pb
            ra, rb = find(a), find(b)
            if ra != rb:
                if (prio[ra], ra) > (prio[rb], rb):
                    ra, rb = rb, ra
                up[rb] = ra
        held += len(batch)
        if held >= TASK_LINKS:
            yield flush()
            held = 0
    yield flush()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (the smallest id of the linked ids) for every id that a link joins.

    Links with a null end and links of an id with itself join nothing. Without links
    the result is empty.
    """
    spark = links.sparkSession
    schema = "node long, root long, p long"
    edges = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    parked: list[DataFrame] = []
    level = 0
    while True:
        # Random priorities, others at each level: a root is the lowest of its forest.
        chance = lambda c, n=level: F.xxhash64(F.lit(n), c)
        forest = cut_lineage(edges.select("a", "b", chance(F.col("a")).alias("pa"), chance(F.col("b")).alias("pb")).mapInPandas(_forest, schema))
        roots = forest.select(F.col("root").alias("node")).distinct()
        parent = forest.groupBy("node").agg(F.min(F.struct("p", "root"))["root"].alias("m"))
        parked.append(parent.join(roots, "node", "left_anti"))
        between = forest.join(parent, "node").where("root <> m").select(F.col("root").alias("a"), F.col("m").alias("b"))
        still = parent.join(roots, "node", "left_semi").select(F.col("node").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(between.unionByName(still).distinct())
        left = edges.count()
        if not left:
            break
        edges = edges.repartition(max(1, min(-(-left // TASK_LINKS), spark.sparkContext.defaultParallelism * 4)))
        level += 1
    label = parked[-1].select("node", F.col("m").alias("label"))
    for rows in reversed(parked[:-1]):
        above = label.select(F.col("node").alias("m"), "label")
        label = rows.join(above, "m", "left").select("node", F.coalesce("label", "m").alias("label")).unionByName(label)
    tops = label.select(F.col("label").alias("node"), "label")
    members = cut_lineage(label.unionByName(tops).distinct())
    least = members.groupBy("label").agg(F.min("node").alias("component"))
    return members.join(least, "label").select("node", "component")


def deal(sizes: list[tuple[int, int]], weights: list[int]) -> list[tuple[int, list[int]]]:
    """(size, how many of its groups each split gets) for (size, groups) pairs.

    The greedy rule, largest group first to the split furthest below its target
    (ties: the first split). Equal groups are interchangeable, so a whole size is
    dealt at once: a split's shortfall falls by one step a group, and the n groups
    go to the n largest of these falling values.
    """
    total = sum(s * n for s, n in sizes)
    whole = sum(weights)
    short = [w * total for w in weights]  # in units of 1 / whole records
    out = []
    for size, n in sorted(sizes, reverse=True):
        step = size * whole

        def taken(level: int) -> list[int]:
            """Values >= level of each split."""
            return [max(0, (s - level) // step + 1) for s in short]

        lo, hi = min(short) - step * (n + 1), max(short) + 1
        while hi - lo > 1:  # the highest level with at least n values
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if sum(taken(mid)) >= n else (lo, mid)
        got = taken(lo + 1)
        for i, s in enumerate(short):
            if sum(got) < n and s - got[i] * step == lo:
                got[i] += 1
        short = [s - g * step for s, g in zip(short, got)]
        out.append((size, got))
    return out


def assign_splits(records: DataFrame, entity: str, links: DataFrame | None, a: str, b: str, shares: dict[str, int], lone: list[Column]) -> DataFrame:
    """records (one row each) plus group_id and split; linked entities share a split.

    A record without entity is a group of its own, told apart by the columns lone.
    group_id is null then. Only the histogram of group sizes comes to the driver:
    of N records at most sqrt(2 N) sizes can differ.
    """
    joined = components(links, a, b).select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    r = records.join(joined, F.col(entity) == F.col("_node"), "left")
    r = r.withColumn("group_id", F.coalesce("_component", entity)).drop("_node", "_component")
    r = r.withColumn("_g", F.when(F.col("group_id").isNotNull(), F.concat(F.lit("e"), F.col("group_id").cast("string"))).otherwise(F.concat_ws("|", F.lit("r"), *lone)))
    groups = cut_lineage(r.groupBy("_g").agg(F.count("*").alias("_size")))
    sizes = [(x["_size"], x["n"]) for x in groups.groupBy("_size").agg(F.count("*").alias("n")).collect()]
    names = list(shares)
    dealt = deal(sizes, [shares[n] for n in names])
    rows = []
    for size, counts in dealt:
        upto = 0
        ends = []
        for c in counts:
            upto += c
            ends.append(upto)
        rows.append((size, ends))
    schema = T.StructType([T.StructField("_size", T.LongType()), T.StructField("_ends", T.ArrayType(T.LongType()))])
    ends = F.broadcast(records.sparkSession.createDataFrame(rows, schema))  # at most sqrt(2 N) rows
    ranked = running_total(groups, ["_size"], ["_g"], F.lit(1), "_rank").join(ends, "_size")
    pick = F.coalesce(*[F.when(F.col("_rank") < F.col("_ends")[i], F.lit(n)) for i, n in enumerate(names)])
    return r.join(ranked.select("_g", pick.alias("split")), "_g").drop("_g")
