"""Integer and skew arithmetic, on the driver and as expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

MIB = 1 << 20
MAX_U64 = (1 << 64) - 1


def div_ceil(a: int, b: int) -> int:
    return -(-a // b)


def mb_to_bytes(mb: int) -> int:
    return min(mb * MIB, MAX_U64)


def rows_per_partition(rows: int, partitions: int) -> int:
    """Rows of each of so many partitions, rounded up; 1 at least."""
    return max(1, div_ceil(rows, max(1, partitions)))


def salt_count(frequency: int, target_rows: int) -> int:
    return max(1, div_ceil(frequency, max(1, target_rows)))


def salt_load(frequency: int, salts: int, salt: int) -> int:
    """Rows that round-robin gives to one of the salts."""
    return frequency // salts + (salt < frequency % salts)


def whole_quotient(a: Column, b: Column) -> Column:
    """a div b for non-negative longs (exact below 2**53)."""
    return ((a - a % b) / b).cast("long")


def salt_count_column(frequency: Column, target_rows: int) -> Column:
    t = max(1, target_rows)
    return F.greatest(F.lit(1).cast("long"), whole_quotient(frequency + F.lit(t - 1), F.lit(t).cast("long")))


def salt_load_column(frequency: Column, salts: Column, salt: Column) -> Column:
    return whole_quotient(frequency, salts) + F.when(salt < frequency % salts, F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))


def percentile_index(n: int, p: float) -> int:
    """Index into n sorted values: no interpolation, rounded up."""
    return math.ceil((n - 1) * p)


def imbalance(sizes: Sequence[int]) -> float:
    """Largest over mean size; 0 for nothing."""
    return max(sizes) / (sum(sizes) / len(sizes)) if sizes and sum(sizes) else 0.0


def skew(sizes: Sequence[int]) -> dict[str, float]:
    """Skew of a list of partition sizes (bounded by the number of partitions)."""
    if not sizes:
        return {"max_partition_size": 0, "mean_partition_size": 0.0, "median_partition_size": 0.0, "p95_partition_size": 0.0, "partition_size_variance": 0.0, "coefficient_of_variation": 0.0, "max_mean_imbalance_ratio": 0.0}
    ordered, n = sorted(sizes), len(sizes)
    mean = sum(sizes) / n
    variance = sum((x - mean) ** 2 for x in sizes) / n
    return {
        "max_partition_size": ordered[-1],
        "mean_partition_size": mean,
        "median_partition_size": float(ordered[percentile_index(n, 0.5)]),
        "p95_partition_size": float(ordered[percentile_index(n, 0.95)]),
        "partition_size_variance": variance,
        "coefficient_of_variation": math.sqrt(variance) / mean if mean else 0.0,
        "max_mean_imbalance_ratio": ordered[-1] / mean if mean else 0.0,
    }


def skew_frame(sizes: DataFrame, column: str = "rows") -> DataFrame:
    """The same over a table of sizes, one row a partition or key, as one row.

    Sizes are first counted by value: distinct sizes are at most the square root of twice their sum,
    whatever the number of rows, so they fit one list.
    """
    tally = sizes.groupBy(F.col(column).cast("long").alias("s")).agg(F.count("*").alias("n"))
    total = F.sum((F.col("s").cast("decimal(38,0)") * F.col("n")).cast("decimal(38,0)")).cast("double")
    one = tally.agg(F.array_sort(F.collect_list(F.struct("s", "n"))).alias("l"), F.coalesce(F.sum("n"), F.lit(0)).alias("many"), total.alias("total"), F.max("s").alias("most"))
    one = one.withColumn("mean", F.when(F.col("many") > 0, F.col("total") / F.col("many")))
    none = F.lit(None).cast("long")

    def at(p: float) -> Column:
        rank = F.ceil((F.col("many") - 1) * F.lit(p))
        start = F.struct(F.lit(0).cast("long").alias("seen"), none.alias("value"))
        step = lambda a, x: F.struct((a["seen"] + x["n"]).alias("seen"), F.coalesce(a["value"], F.when(a["seen"] + x["n"] > rank, x["s"])).alias("value"))
        return F.aggregate("l", start, step, lambda a: a["value"].cast("double"))

    squares = F.aggregate("l", F.lit(0.0), lambda a, x: a + x["n"] * (x["s"] - F.col("mean")) * (x["s"] - F.col("mean")))
    one = one.withColumn("variance", F.when(F.col("many") > 0, squares / F.col("many")))
    return one.select(
        F.coalesce("most", F.lit(0).cast("long")).alias("max_partition_size"),
        F.coalesce("mean", F.lit(0.0)).alias("mean_partition_size"),
        F.coalesce(at(0.5), F.lit(0.0)).alias("median_partition_size"),
        F.coalesce(at(0.95), F.lit(0.0)).alias("p95_partition_size"),
        F.coalesce("variance", F.lit(0.0)).alias("partition_size_variance"),
        F.coalesce(F.when(F.col("mean") > 0, F.sqrt("variance") / F.col("mean")), F.lit(0.0)).alias("coefficient_of_variation"),
        F.coalesce(F.when(F.col("mean") > 0, F.col("most") / F.col("mean")), F.lit(0.0)).alias("max_mean_imbalance_ratio"),
    )
