"""The trace log: what is to be done, guarded, promoted, counted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_CALLS = 4
LEAST_TOOLS = 3


def normal_status(c: Column) -> Column:
    """unverified or generation_failed in any spelling; null for anything else."""
    letters = F.regexp_replace(F.lower(c), r"[^a-z]", "")
    return F.when(letters == "unverified", "unverified").when(letters == "generationfailed", "generation_failed")


def pending(log: DataFrame, verified: DataFrame, key: str = "image_id") -> DataFrame:
    """Keys with an unverified trace that aren't verified yet."""
    open_ = log.where((normal_status(F.col("status")) == "unverified") & F.col(key).isNotNull()).select(key).distinct()
    return open_.join(verified.select(key), key, "left_anti")


def eligible(images: DataFrame, log: DataFrame, key: str = "image_id") -> DataFrame:
    """Images without a successful trace: failed ones are run again."""
    done = log.where(normal_status(F.col("status")) == "unverified").select(F.col(key).alias("id"))
    return images.join(done, "id", "left_anti")


def status_counts(log: DataFrame, verified: DataFrame, key: str = "image_id") -> DataFrame:
    """Distinct keys generated, failed only, verified, pending, and the verified share."""
    state = log.where(F.col(key).isNotNull()).groupBy(key).agg(F.max((normal_status(F.col("status")) == "unverified").cast("int")).alias("ok"))
    v = verified.where(F.col(key).isNotNull()).select(key).distinct().withColumn("v", F.lit(1))
    j = state.join(v, key, "full_outer")
    generated, good = F.count_if(F.col("ok") == 1), F.count_if(F.col("v") == 1)
    return j.agg(
        generated.alias("generated"),
        F.count_if(F.coalesce("ok", F.lit(0)) == 0).alias("without_trace"),
        good.alias("verified"),
        F.count_if((F.col("ok") == 1) & F.col("v").isNull()).alias("pending"),
        F.round(F.count_if((F.col("ok") == 1) & (F.col("v") == 1)) / F.greatest(generated, F.lit(1)), 6).alias("verified_share"),
    )


def promoted(batch: DataFrame, verified: DataFrame, verdict: Column, key: str = "image_id") -> DataFrame:
    """Rows of a batch to append to the verified log: unverified, of a good verdict, one
    per key, and not there yet."""
    good = batch.where((normal_status(F.col("status")) == "unverified") & F.coalesce(verdict, F.lit(False)) & F.col(key).isNotNull())
    return good.dropDuplicates([key]).join(verified.select(key), key, "left_anti")


def guarded_calls(calls: Column) -> Column:
    """Why a list of tool calls is refused, null if it isn't."""
    named = F.forall(calls, lambda c: F.coalesce(c["tool_name"] != "", F.lit(False)))
    n = F.coalesce(F.size(calls), F.lit(0))
    return F.when(n == 0, "missing or empty list").when(n > MAX_CALLS, "too many calls").when(~F.coalesce(named, F.lit(False)), "call without a tool")


def final_gate(calls: Column, located: Column, findings: Column) -> Column:
    """Why a final answer is refused, null if it isn't: no call, too few tools, or a
    finding at a tooth that was never located."""
    tools = F.size(F.array_distinct(F.transform(calls, lambda c: c["tool_name"])))
    told = F.transform(F.filter(findings, lambda f: f["quadrant"].isNotNull() & f["tooth_position"].isNotNull()), lambda f: f["quadrant"] * 10 + f["tooth_position"])
    lost = F.size(F.array_except(F.coalesce(told, F.array().cast("array<int>")), located))
    return F.when(F.size(calls) == 0, "no tool call").when(tools < LEAST_TOOLS, "too few tools").when(lost > 0, "finding not located")


def error_streak(df: DataFrame, key: str, order: str, error: Column) -> DataFrame:
    """df plus streak (errors in a row so far, 0 after a good turn) and verdict: 'recover'
    at two, 'fatal' from three on. One key's turns are few, as a run ends by then."""
    w = W.partitionBy(key).orderBy(order)
    d = df.withColumn("_e", F.coalesce(error, F.lit(False)).cast("int")).withColumn("_island", F.sum(1 - F.col("_e")).over(w))
    streak = F.sum("_e").over(W.partitionBy(key, "_island").orderBy(order))
    d = d.withColumn("streak", streak)
    return d.withColumn("verdict", F.when(F.col("streak") >= 3, "fatal").when(F.col("streak") == 2, "recover").otherwise("go on")).drop("_e", "_island")


def examples(df: DataFrame, key: str, image: str, items: str, target: Callable[[Column], Column]) -> DataFrame:
    """key, i, prompt, target: one training example for each item of a record's list. Null
    lists and items give none; an unknown image is told as such."""
    # Fixed value: the prompt's wording.
    prompt = F.concat(F.lit("Analyze this panoramic X-ray (image_id="), F.coalesce(F.col(image).cast("string"), F.lit("unknown")), F.lit(")."))
    return df.select(key, prompt.alias("prompt"), F.posexplode(items).alias("i", "x")).where("x is not null").select(key, "i", "prompt", target(F.col("x")).alias("target"))


def grounding_rate(judged: DataFrame, grounded: str = "grounded") -> DataFrame:
    """n, grounded and their rate (0 for none) of a judge's verdicts; null counts as no."""
    good = F.count_if(F.coalesce(F.col(grounded), F.lit(False)))
    return judged.agg(F.count("*").alias("n"), good.alias(grounded), F.round(good / F.greatest(F.count("*"), F.lit(1)), 6).alias("rate"))


def run_agent(todo: DataFrame, key: str, answer: Callable[[pd.DataFrame], pd.Series], kind: str) -> DataFrame:
    """key, answer: a function of whole Arrow batches handed in from outside (a model, a
    client), the only step that isn't the engine's own. Rows are independent, so a lost
    executor costs its own batches only."""
    schema = f"`{key}` {todo.schema[key].dataType.simpleString()}, answer {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "answer": answer(b)})

    return todo.mapInPandas(run, schema)
