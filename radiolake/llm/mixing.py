"""Sources mixed to target shares of all tokens.

Each source's tokens are packed end to end into fixed-length blocks. Output shards
draw how many of their slots each source gets (multinomial, each shard on its own); a
source's slots, numbered on, are mapped through pseudorandom index permutations, one per pass over
its blocks, and joined with the blocks by index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ranking import running_total
from ..runtime import cut_lineage

BLOCK = 256
SHARD_BLOCKS = 4096


def pack(tokens: DataFrame, key: str, source: str, ids: str, block: int = BLOCK) -> DataFrame:
    """source, block_index, doc pieces of each block: (at, key, first, ids), unordered.

    Documents are laid end to end in a pseudorandom order within their source; only
    the last block of a source may be shorter. Rows without tokens or source take no
    part.
    """
    n = F.size(ids)
    t = tokens.where(F.col(source).isNotNull() & (n > 0))
    t = running_total(t, [source], [key], n.cast("bigint"), "_off")
    first, last = F.floor(F.col("_off") / block), F.floor((F.col("_off") + n - 1) / block)
    pieces = t.select(source, key, ids, "_off", F.explode(F.sequence(first, last)).alias("block_index"))
    start = F.greatest(F.col("block_index") * block - F.col("_off"), F.lit(0)).cast("int")
    length = F.least(F.lit(block) - (F.col("_off") + start - F.col("block_index") * block), F.size(ids) - start).cast("int")
    return pieces.select(source, "block_index", (F.col("_off") + start - F.col("block_index") * block).cast("int").alias("at"), key, start.alias("first"), F.slice(ids, start + 1, length).alias("piece"))


def blocks(pieces: DataFrame, key: str, source: str) -> DataFrame:
    """One row per block: its documents' pieces in order and its tokens. A block has at
    most as many pieces as tokens, so the groups are bounded by the block length."""
    parts = F.array_sort(F.collect_list(F.struct("at", key, "first", "piece")))
    out = pieces.groupBy(source, "block_index").agg(parts.alias("_p"))
    return out.select(source, "block_index", F.transform("_p", lambda x: x[key]).alias("documents"), F.flatten(F.transform("_p", lambda x: x["piece"])).alias("ids"))


def plan(available: dict[str, tuple[int, int]], targets: dict[str, tuple[float, int]], size: int | None = None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(sources, their shares, the slots of each): how often a source's blocks are used in all.

    available: source -> (tokens, blocks). The mix has `size` tokens, but is no larger
    than it can be with every source at its share: the least of tokens * max_repeats /
    share over the sources that occur, whose shares are scaled to 1. So the scarcest
    source bounds the mix, and what others have beyond their share falls away.
    """
    names = sorted(s for s in targets if s in available and available[s][0] > 0 and targets[s][0] > 0 and targets[s][1] > 0)
    if not names:
        return [], np.zeros(0), np.zeros(0, np.int64)
    share = np.array([targets[s][0] for s in names])
    share = share / share.sum()
    tokens = np.array([available[s][0] for s in names], float)
    count = np.array([available[s][1] for s in names], np.int64)
    repeats = np.array([targets[s][1] for s in names], np.int64)
    most = (tokens * repeats / share).min()
    goal = most if size is None else min(size, most)
    wanted = np.minimum(np.maximum(1, np.rint(goal * share / (tokens / count)).astype(np.int64)), count * repeats)
    return names, wanted / wanted.sum(), wanted


def draw(spark: SparkSession, shares: np.ndarray, slots: int, seed: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """shard, j, n, start, drawn: how many of a shard's slots fall to the j-th source, a
    multinomial draw of its own, and how many fell to it in the shards before and in all.
    Shards draw in parallel; only their counts are added up."""
    shards = -(-slots // shard_blocks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["id"].to_numpy()
            got = np.array([np.random.default_rng([seed, i]).multinomial(min(shard_blocks, slots - i * shard_blocks), shares) for i in ids.tolist()]).reshape(len(ids), len(shares))
            yield pd.DataFrame({"shard": np.repeat(ids, len(shares)), "j": np.tile(np.arange(len(shares)), len(ids)), "n": got.reshape(-1)})

    drawn = spark.range(shards).mapInPandas(run, "shard long, j int, n long")
    return running_total(drawn, ["j"], ["shard"], F.col("n"), "start", bucket=F.floor(F.col("shard") / 1024), whole="drawn")


def settled(j: np.ndarray, i: np.ndarray, drawn: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, number) of drawn slots so that every source has just the slots it is to have.

    A source drawn too often gives its last slots to those drawn too rarely, in order;
    drawn and wanted have the same total, so that none is left.
    """
    over = np.maximum(drawn - wanted, 0)
    under = np.maximum(wanted - drawn, 0)
    far = i >= wanted[j]
    e = (np.cumsum(over) - over)[j] + i - wanted[j]
    to = np.minimum(np.searchsorted(np.cumsum(under), e, side="right"), len(wanted) - 1)
    number = drawn[to] + e - (np.cumsum(under) - under)[to]
    return np.where(far, to, j), np.where(far, number, i)


def permuted(index: np.ndarray, size: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """A permutation of 0 .. size - 1 for each salt: four Feistel rounds over the next
    even number of bits, walked on until the value is below size again."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(size, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    salt = salt.astype(np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> half, x & mask
        for r in range(4):
            f = (b + salt * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ ((f ^ (f >> np.uint64(32))) & mask)
        return a << half | b

    with np.errstate(over="ignore"):
        x = once(index.astype(np.uint64))
        limit = size.astype(np.uint64)
        while (far := x >= limit).any():
            x = np.where(far, once(x), x)
    return x.astype(np.int64)


def mix(tokens: DataFrame, key: str, source: str, ids: str, targets: DataFrame, block: int = BLOCK, seed: int = 17, size: int | None = None, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """shard, slot, source, block_index, pass, documents, ids: the mixed corpus.

    targets: source, target_share, max_repeats, one row a source; they come to the driver,
    with a row for each source's totals. Sources that targets doesn't name, and targets
    without any tokens, are left out; the shares of the others are scaled to 1. No
    block, and so no token, is used more than max_repeats times. size is the wanted
    number of tokens, see plan. Shards draw by the targets; the few slots by which all
    draws together miss a source's slots go to other sources at the end, so that the
    shares are exact to a block. Without usable sources the result is empty.
    """
    spark = tokens.sparkSession
    wanted = {r[0]: (float(r[1] or 0), int(r[2] or 0)) for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share"), F.max("max_repeats")).collect()}
    # The tokens are made once: the offsets and the blocks both read them.
    named = cut_lineage(tokens.where(F.col(source).isin(list(wanted))))
    packed = cut_lineage(blocks(pack(named, key, source, ids, block), key, source))
    have = {r[0]: (r[1], r[2]) for r in packed.groupBy(source).agg(F.sum(F.size("ids")), F.count("*")).collect()}
    names, shares_, slots = plan(have, wanted, size)
    counts = np.array([have[s][1] for s in names], np.int64)
    drawn = draw(spark, shares_ if names else np.ones(1), int(slots.sum()), seed, shard_blocks)
    total = np.zeros(len(names), np.int64)
    for r in drawn.select("j", "drawn").distinct().collect():  # a row for each source
        total[r["j"]] = r["drawn"]
    each = drawn.where("n > 0").select("shard", "j", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("i"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            j, i = settled(b["j"].to_numpy(), b["i"].to_numpy(), total, slots)
            n = counts[j]
            turn = i // n
            at = permuted(i % n, n, j * 1_000_003 + turn + seed * 7919)
            yield pd.DataFrame({"shard": b["shard"], "source": np.array(names, dtype=object)[j], "i": i, "block_index": at, "pass": turn})

    placed = each.mapInPandas(place, "shard long, source string, i long, block_index long, pass long")
    joined = placed.join(packed.withColumnRenamed(source, "source"), ["source", "block_index"])
    return joined.select(F.col("shard").cast("int").alias("shard"), F.xxhash64(F.lit(seed), "source", "i").alias("slot"), "source", "block_index", "pass", "documents", "ids")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, reached_share, blocks, most_uses for every target."""
    got = mixed.groupBy("source", "block_index").agg(F.count("*").alias("uses"), F.sum(F.size("ids")).alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("uses").alias("blocks"), F.max("uses").alias("most_uses"))
    t = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share")).join(got, "source", "left")
    whole = F.sum("tokens").over(W.partitionBy())  # a row for each source
    return t.select("source", "target_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.round(F.coalesce(F.col("tokens") / whole, F.lit(0.0)), 6).alias("reached_share"), F.coalesce("blocks", F.lit(0)).alias("blocks"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))


def kept(reached: DataFrame, targets: DataFrame, slack: float = 0.01, block: int = BLOCK) -> DataFrame:
    """source, share_kept, repeats_kept: whether each target with tokens has its share, scaled
    over those that have any, to within slack and a block or two, and no block too often."""
    most = targets.where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("most"))
    due = F.col("target_share") / F.sum(F.when(F.col("tokens") > 0, F.col("target_share"))).over(W.partitionBy())  # a row for each source
    whole = F.sum("tokens").over(W.partitionBy())
    return reached.join(most, "source").select("source", ((F.col("tokens") == 0) | (F.abs(F.col("tokens") - due * whole) <= slack * whole + 2 * block)).alias("share_kept"), (F.col("most_uses") <= F.col("most")).alias("repeats_kept"))
