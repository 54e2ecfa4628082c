"""Ranges of an ordered key: cuts by percentiles, and the range a value falls in."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts_of(df: DataFrame, key: str, parts: int, accuracy: int = 200_000) -> list:
    """At most parts - 1 values that split df into about equal ranges of an integral key. Only they reach the driver."""
    if parts < 2:
        return []
    found = df.agg(F.percentile_approx(F.col(key).cast("bigint"), [k / parts for k in range(1, parts)], accuracy).alias("c")).first()["c"]
    return sorted(set(found or []))


def block_of(key: Column, cuts: list[int]) -> Column:
    """How many cuts are smaller than key, found in two steps of about the square root of their number; null for null."""
    if not cuts:
        return F.when(key.isNotNull(), 0)
    step = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    fine = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    coarse = F.from_json(F.lit(json.dumps([g[-1] for g in groups[:-1]])), "array<bigint>")
    group = F.size(F.filter(coarse, lambda c: c < key))
    return F.when(key.isNotNull(), group * step + F.size(F.filter(fine[group], lambda c: c < key)))
