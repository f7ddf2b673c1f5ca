"""Holding a result against its baseline. What a level asserts it always computes."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F

from ..errors import CorrectnessMismatch
from .workloads import TECHNICAL, checksum

LEVELS = ("none", "basic", "full")


def comparable_columns(a: DataFrame, b: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> list[str]:
    """The keys, then the other shared columns by name, technical ones left out."""
    shared = (set(a.columns) & set(b.columns)) - set(TECHNICAL) - set(more)
    return [*(k for k in keys if k in shared), *sorted(shared - set(keys))]


def basic(baseline: dict[str, Any], candidate: dict[str, Any]) -> dict[str, bool]:
    return {f"{k}_match_baseline": baseline.get(k) == candidate.get(k) for k in ("rows", "result_rows")}


def group_count_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose counts differ, or that one side lacks: keys, count_a, count_b. Null keys are equal."""
    left = a.select(*(F.col(k).alias(f"a_{k}") for k in keys), F.col("count").alias("count_a"))
    right = b.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.col("count").alias("count_b"))
    same = [left[f"a_{k}"].eqNullSafe(right[f"b_{k}"]) for k in keys]
    both = left.join(right, same, "full_outer").where(~F.coalesce("count_a", F.lit(0)).eqNullSafe(F.coalesce("count_b", F.lit(0))))
    return both.select(*(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in keys), "count_a", "count_b")


def checksums_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> bool:
    columns = comparable_columns(a, b, keys, more)
    one = lambda df: df.agg(F.count("*").alias("n"), checksum(columns).alias("c")).first()
    return tuple(one(a)) == tuple(one(b))


def verify_groups(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> dict[str, Any]:
    n = group_count_difference(a, b, keys).count()
    return {"group_count_diff": n, "exact_group_counts_match": n == 0, "checksum_matches_baseline": checksums_equal(a, b, keys)}


def verify_join(a: DataFrame, b: DataFrame, keys: Sequence[str], more: Sequence[str] = ()) -> dict[str, Any]:
    return {"checksum_matches_baseline": checksums_equal(a, b, keys, more)}


def require(correctness: dict[str, Any], what: str) -> None:
    """Raises if anything that was compared differs."""
    wrong = [k for k, v in correctness.items() if v is False]
    if wrong:
        raise CorrectnessMismatch(f"{what}: {', '.join(wrong)}")
