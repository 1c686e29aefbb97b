"""Closed-form budgets and estimates (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def turn_budget(findings: Column, least: int, most: int, buffer: int) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), findings + buffer))


def open_turn_budget(findings: Column, most: int, extra: int = 3) -> Column:
    return F.greatest(F.lit(most), findings + extra)


def call_budget(images: Column, votes: int, per_day: int) -> tuple[Column, Column]:
    """(calls, days) for two calls per vote and image."""
    calls = images * (2 * votes)
    return calls, F.ceil(calls / per_day)


def memory(group: Column, length: Column, four_bit: bool = True) -> Column:
    """Rule of thumb for a training step's memory as a struct: its parts (weights, adapters,
    activations per sequence, cached image features, runtime), their sum, and whether
    that fits two usual cards."""
    # Gigabytes of each part, and of the cards less a reserve.
    parts = {"base_weights_gb": 4.5 if four_bit else 15.0, "lora_and_opt_gb": 0.3, "vision_cache_gb": 1.0, "cuda_context_gb": 1.2}
    peak = length / 2048 * 0.6 * group
    total = sum(map(F.lit, parts.values()), F.lit(0.0)) + peak
    return F.struct(
        *[F.lit(v).alias(k) for k, v in parts.items()],
        F.round(peak, 2).alias("peak_activations_gb"), F.round(total, 2).alias("estimated_peak_gb"), (total <= 23.0).alias("fits_in_24gb"), (total <= 15.0).alias("fits_in_16gb"),
    )


def analytic_memory(group: Column, length: Column, billions: float = 3.0, bits: int = 4, adapters: float = 0.01) -> Column:
    """The other estimate, from the number of parameters, as a struct of its parts."""
    gb = float(1 << 30)
    base, extra = billions * 1e9 * bits / 8 / gb, billions * 1e9 * adapters
    group, length = group.cast("double"), length.cast("double")
    activations, reference = group * length * 4096 * 8 / gb, length * 4096 * 2 / gb
    total = F.lit(base + extra * 2 / gb + extra * 16 / gb) + activations + reference + 1.2
    shown = {"base_model_gb": F.lit(base), "lora_weights_gb": F.lit(extra * 2 / gb), "lora_optimizer_gb": F.lit(extra * 16 / gb), "activations_gb": activations, "cuda_overhead_gb": F.lit(1.2), "total_gb": total}
    return F.struct(*[F.round(c, 2).alias(n) for n, c in shown.items()])


def token_estimate(text_length: Column, images: Column, per_image: int = 600) -> Column:
    return F.floor(text_length / 4) + images * per_image


def trimmed(messages: Column, limit: int, keep: int, mark: str, image: str = "<Image>") -> Column:
    """messages with the contents of all but the last `keep` image messages replaced by a
    mark, if the token estimate is above the limit. The first message is left alone."""
    shows = lambda m: F.coalesce(F.contains(m["content"], F.lit(image)), F.lit(False))
    size = F.aggregate(messages, F.lit(0).cast("bigint"), lambda acc, m: acc + F.coalesce(token_estimate(F.length(m["content"]), shows(m).cast("int")), F.lit(0)))
    places = F.filter(F.transform(messages, lambda m, i: F.when(shows(m) & (i > 0), i)), lambda i: i.isNotNull())
    old = F.slice(places, 1, F.greatest(F.size(places) - keep, F.lit(0)))
    cut = F.transform(messages, lambda m, i: F.when(F.array_contains(old, i), F.struct(m["role"].alias("role"), F.lit(mark).alias("content"))).otherwise(m))
    return F.when(size > limit, cut).otherwise(messages)
