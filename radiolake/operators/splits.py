"""Deterministic partitions of ids: slices, folds and held-out shares.

Ids are ranked by a hash that SQL engines compute alike, so a partition depends on
(ids, seed, k) only. The rank is global but needs no global sort in one task: hashes
are cut into ranges, whose counts are added up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import BUCKETS, mixed, mixed_sql, running_total


def ranked(ids: DataFrame, column: str, seed: int) -> DataFrame:
    """Each distinct non-null id with its rank (from 0) and the number n of ids."""
    one = ids.select(F.col(column).cast("bigint").alias("id")).where("id is not null").distinct().withColumn("h", mixed(F.col("id"), seed))
    r = running_total(one, [], ["h", "id"], F.lit(1), "rank", bucket=F.floor(F.col("h") / (2147483647 // BUCKETS + 1)), whole="n")
    return r.select("id", "rank", "n")


def ranked_sql(relation: str, column: str, seed: int) -> str:
    one = f"SELECT DISTINCT CAST({column} AS BIGINT) AS id FROM {relation} WHERE {column} IS NOT NULL"
    return f"SELECT id, row_number() OVER (ORDER BY {mixed_sql('id', seed)}, id) - 1 AS rank, count(*) OVER () AS n FROM ({one})"


def part_of(rank: Column, n: Column, k: int) -> Column:
    """The part of a rank: k parts whose sizes differ by one at most, larger ones first."""
    if k < 1:
        raise ValueError("the number of parts must be positive")
    b, m = F.floor(n / k), n % k
    late = m + F.floor((rank - m * (b + 1)) / F.greatest(b, F.lit(1)))
    return F.when(rank < m * (b + 1), F.floor(rank / (b + 1))).otherwise(late).cast("int")


def part_of_sql(k: int) -> str:
    return f"CAST(CASE WHEN rank < (n % {k}) * (n // {k} + 1) THEN rank // (n // {k} + 1) ELSE (n % {k}) + (rank - (n % {k}) * (n // {k} + 1)) // greatest(n // {k}, 1) END AS INTEGER)"


def parts(ids: DataFrame, column: str, k: int, seed: int) -> DataFrame:
    return ranked(ids, column, seed).select("id", part_of(F.col("rank"), F.col("n"), k).alias("part"))


def one_part(ids: DataFrame, column: str, k: int, index: int, seed: int) -> DataFrame:
    """Ids of the index-th of k slices, counted from 1."""
    if not 1 <= index <= k:
        raise ValueError("the slice index must lie between 1 and the number of slices")
    return parts(ids, column, k, seed).where(F.col("part") == index - 1).select("id")


def held_out(ids: DataFrame, column: str, share: float, seed: int) -> DataFrame:
    """A fixed pseudorandom share of the ids, rounded down."""
    return ranked(ids, column, seed).where(F.col("rank") < F.floor(F.col("n") * share)).select("id")
