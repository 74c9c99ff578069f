"""Tier names, label codes and class probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier names in label order.
TIERS = ["Low", "Medium", "High"]


def encode_tier(tier: Column, other: int | None = None) -> Column:
    """Low, Medium, High as 0, 1, 2; any other text, and null, gives ``other``."""
    code = F.when(tier == TIERS[0], 0)
    for number, name in enumerate(TIERS[1:], start=1):
        code = code.when(tier == name, number)
    return code.otherwise(F.lit(other).cast("int"))


def decode_tier(code: Column) -> Column:
    """0, 1, 2 as tier names; another number or text is shown as it is."""
    number = code.try_cast("double")
    name = F.when(number == 0, TIERS[0])
    for value, tier in enumerate(TIERS[1:], start=1):
        name = name.when(number == value, tier)
    return name.otherwise(F.coalesce(number.cast("string"), code.cast("string")))


def softmax(scores: Column) -> Column:
    """exp(score) / sum of exp over an array of scores; a zero sum gives zeros."""
    exps = F.transform(scores, lambda s: F.exp(s))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, e: acc + e)
    return F.transform(exps, lambda e: F.when(total != 0, e / total).otherwise(F.lit(0.0)))
