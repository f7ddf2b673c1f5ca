"""Skewed datasets as lazy DataFrames: counts are exact, rows are made where they are written.

Every generator first allots rows to keys (a few numbers) and turns row numbers into keys by
expressions, so that no key list as long as the data exists anywhere. The order of rows is mixed
by a keyed bijection of the row number rather than by sorting.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.hashing import partition_id_column, stable_payload_value, stable_value

SCENARIOS = ("uniform", "single_heavy", "multi_heavy", "custom_heavy", "zipf", "group_by", "join_pair")


def allot(total: int, weights: Sequence[float]) -> list[int]:
    """total in shares of weights: largest remainders first, then by position."""
    whole = sum(weights)
    if whole <= 0:
        raise ValueError("weights must sum to more than zero")
    exact = [total * w / whole for w in weights]
    out = [math.floor(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (-(exact[i] - out[i]), i))[: total - sum(out)]:
        out[i] += 1
    return out


def parse_custom_heavy(text: str) -> list[tuple[str, float]]:
    """KEY:FRACTION,...: unique keys, fractions above 0 that sum to 1 at most."""
    out = []
    for part in text.split(","):
        key, colon, fraction = part.strip().rpartition(":")
        if not colon or not key:
            raise ValueError(f"expected KEY:FRACTION, got {part!r}")
        out.append((key, float(fraction)))
    check_fractions(out)
    return out


def check_fractions(heavy: Sequence[tuple[str, float]]) -> None:
    if len({k for k, _ in heavy}) != len(heavy):
        raise ValueError("heavy keys must be unique")
    if any(f <= 0 for _, f in heavy) or sum(f for _, f in heavy) > 1 + 1e-9:
        raise ValueError("heavy fractions must be above zero and sum to one at most")


def _mixed(rows: int, seed: int) -> tuple[int, int]:
    """Multiplier (prime to rows) and offset of a bijection of 0 .. rows - 1."""
    if rows < 2:
        return 1, 0
    a = (2654435761 ^ seed * 40503) % rows | 1
    while math.gcd(a, rows) != 1:
        a += 2
    return a % rows or 1, seed * 97 % rows


def _positions(spark: SparkSession, rows: int, seed: int) -> DataFrame:
    """row_id, and `at`: its place among the allotted rows."""
    a, b = _mixed(rows, seed)
    at = F.pmod(F.col("id").cast("decimal(20,0)") * a + b, F.lit(max(1, rows)).cast("decimal(20,0)")).cast("long")
    return spark.range(rows).select(F.col("id").alias("row_id"), at.alias("at"))


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 8, "0"))


def zipf_counts(rows: int, keys: int, exponent: float) -> list[int]:
    return allot(rows, [1 / (i + 1) ** exponent for i in range(keys)])


def _from_counts(spark: SparkSession, rows: int, seed: int, names: Sequence[str], counts: Sequence[int], tail: Column | None = None) -> DataFrame:
    """Rows dealt to names by counts (few: a sorted array of ends and a search in it); the rest get tail(`at` beyond)."""
    ends, total = [], 0
    for n in counts:
        total += n
        ends.append(total)
    base = _positions(spark, rows, seed)
    edges = spark.createDataFrame([(i, n, e - c, e) for i, (n, c, e) in enumerate(zip(names, counts, ends, strict=True)) if c], "i int, name string, low long, high long")
    if len(names) <= 1000:
        key = None
        for n, e in zip(names, ends, strict=True):
            key = F.when(F.col("at") < e, F.lit(n)) if key is None else key.when(F.col("at") < e, F.lit(n))
        rest = tail if tail is not None else F.lit(None).cast("string")
        return base.withColumn("key", rest if key is None else key.otherwise(rest))
    step = max(1, rows // 4096)  # range join by buckets of positions
    spans = edges.withColumn("b", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step))))
    own = base.withColumn("b", F.floor(F.col("at") / step)).join(F.broadcast(spans), "b", "left").where("at >= low and at < high or low is null")
    return own.select("row_id", "at", F.col("name").alias("key"))


def uniform(spark: SparkSession, rows: int, keys: int, seed: int = 42, prefix: str = "key_") -> DataFrame:
    """Each key as often as any other, give or take one."""
    base = _positions(spark, rows, seed)
    return base.select("row_id", _named(prefix, F.col("at") % keys).alias("key"))


def uniform_random(spark: SparkSession, rows: int, keys: int, seed: int = 42, prefix: str = "user_") -> DataFrame:
    return spark.range(rows).select(F.col("id").alias("row_id"), _named(prefix, F.floor(F.rand(seed) * keys)).alias("key"))


def heavy(spark: SparkSession, rows: int, keys: int, heavy_keys: Sequence[tuple[str, float]], tail: str = "uniform", exponent: float = 1.2, seed: int = 42, prefix: str = "key_") -> DataFrame:
    """Stated shares of the rows for stated keys, the rest over `keys` tail keys, evenly or by Zipf."""
    check_fractions(heavy_keys)
    counts = [round(rows * f) for _, f in heavy_keys]
    if sum(counts) > rows:
        counts[-1] -= sum(counts) - rows
    rest, names = rows - sum(counts), [k for k, _ in heavy_keys]
    if tail == "zipf":
        return _from_counts(spark, rows, seed, [*names, *(f"{prefix}{i:08d}" for i in range(keys))], [*counts, *zipf_counts(rest, keys, exponent)]).select("row_id", "key")
    if tail != "uniform":
        raise ValueError(f"unknown tail: {tail}")
    return _from_counts(spark, rows, seed, names, counts, _named(prefix, (F.col("at") - sum(counts)) % keys)).select("row_id", "key")


def single_heavy(spark: SparkSession, rows: int, keys: int, fraction: float = 0.5, tail: str = "uniform", key: str = "heavy_00000000", **more: Any) -> DataFrame:
    return heavy(spark, rows, keys, [(key, fraction)], tail, **more)


def multi_heavy(spark: SparkSession, rows: int, keys: int, count: int = 5, total: float = 0.6, weights: Sequence[float] | None = None, tail: str = "uniform", **more: Any) -> DataFrame:
    """`total` of the rows over `count` keys in shares of weights (equal without)."""
    weights = list(weights or [1.0] * count)
    if len(weights) != count or any(w <= 0 for w in weights):
        raise ValueError("one weight above zero for each heavy key")
    return heavy(spark, rows, keys, [(f"heavy_{i:08d}", total * w / sum(weights)) for i, w in enumerate(weights)], tail, **more)


def custom_heavy(spark: SparkSession, rows: int, keys: int, spec: str, **more: Any) -> DataFrame:
    return heavy(spark, rows, keys, parse_custom_heavy(spec), **more)


def zipf(spark: SparkSession, rows: int, keys: int, exponent: float = 1.2, seed: int = 42, prefix: str = "key_") -> DataFrame:
    return _from_counts(spark, rows, seed, [f"{prefix}{i:08d}" for i in range(keys)], zipf_counts(rows, keys, exponent)).select("row_id", "key")


def group_by_scenario(spark: SparkSession, rows: int, keys: int, distribution: str = "single_heavy", **more: Any) -> DataFrame:
    make = {"uniform": uniform, "single_heavy": lambda *a, **b: single_heavy(*a, key="group_heavy_00000000", **b), "multi_heavy": multi_heavy, "zipf": zipf}
    return make[distribution](spark, rows, keys, **more)


def join_pair(spark: SparkSession, rows: int, keys: int, fraction: float = 0.5, tail: str = "uniform", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two sides that share a heavy key; the right one has a quarter of the rows and a little more skew."""
    key = "join_heavy_00000000"
    return single_heavy(spark, rows, keys, fraction, tail, key, seed=seed), single_heavy(spark, max(1, rows // 4), keys, min(0.95, fraction + 0.10), tail, key, seed=seed + 101)


def dimension(frame: DataFrame, key: str) -> DataFrame:
    """Each key once, numbered in key order across ordered partitions."""
    from pyspark.sql import Window as W

    own = frame.select(key).where(F.col(key).isNotNull()).distinct()
    parts = own.repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("p", F.spark_partition_id())
    local = parts.withColumn("i", F.row_number().over(W.partitionBy("p").orderBy(key)))
    offsets = local.groupBy("p").agg(F.max("i").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(offsets.select("p", "before")), "p").select(key, _named("dim_", F.col("i") - 1 + F.col("before")).alias("dimension_value"))


def collision_keys(spark: SparkSession, count: int, partitions: int, seed: int = 42, column: str = "user_id", partition: int = 0, prefix: str = "collision_") -> DataFrame:
    """Keys whose layout hash falls on one partition: found among so many numbers that enough are expected."""
    found, span = None, max(1000, count * partitions * 2)
    while found is None or found.count() < count:
        found = spark.range(span).select(_named(prefix, F.col("id")).alias(column), "id")
        head = f"{len(column)}:{column}#utf8:"
        text = F.concat(F.lit(head), F.octet_length(column).cast("string"), F.lit(":"), F.col(column))
        found = found.where(partition_id_column(text, seed, partitions) == partition)
        span *= 2
    return found.orderBy("id").limit(count).select(column)


def join_right_side(spark: SparkSession, scenario: str, rows: int = 10_000, heavy_key: str = "heavy_00000000", prefix: str = "key_") -> DataFrame:
    """Right sides of join scenarios: small (unique keys), shared (half the rows on the heavy key), one_sided (no heavy key)."""
    rows = min(rows, 10_000)
    key = _named(prefix, F.col("id"))
    if scenario == "shared":
        key = F.when(F.col("id") < rows // 2, F.lit(heavy_key)).otherwise(key)
    elif scenario not in ("small", "one_sided"):
        raise ValueError(f"unknown right side: {scenario}")
    return spark.range(rows).select(key.alias("key"), F.col("id").alias("row_id"))


@dataclass(frozen=True)
class Columns:
    """What build_rows adds."""

    keys: tuple[str, ...] = ("user_id",)
    metrics: tuple[str, ...] = ("value",)
    categories: tuple[str, ...] = ()
    payloads: int = 0
    payload_bytes: int = 0
    timestamp: bool = False
    base_ms: int = 1_704_067_200_000  # 2024-01-01


def expand_key(key: Column, names: Sequence[str]) -> list[Column]:
    """Composite keys: the last column is the key, the others are buckets of its hash."""
    others = [_named(f"{n}_", F.pmod(F.xxhash64(key, F.lit(i)), F.lit(1024))).alias(n) for i, n in enumerate(names[:-1])]
    return [*others, key.alias(names[-1])]


def build_rows(frame: DataFrame, columns: Columns = Columns(), seed: int = 42) -> DataFrame:
    """(row_id, key) with metrics, categories, payloads and time, all from the row number."""
    row, key = F.col("row_id"), F.col("key")
    out = [*expand_key(key, columns.keys), row]
    out += [F.pmod(F.xxhash64(row, F.lit(f"{seed}:{m}")), F.lit(1_000_000)).alias(m) for m in columns.metrics]
    out += [F.concat(F.lit(f"{c}_"), F.lpad(F.pmod(F.xxhash64(row, F.lit(f"{seed}:{c}")), F.lit(128)).cast("string"), 3, "0")).alias(c) for c in columns.categories]
    out += [stable_payload_value(key, row, seed, i).alias(f"payload_{i}") for i in range(columns.payloads)]
    if columns.payload_bytes:
        out.append(F.substring(F.repeat(F.sha2(F.concat_ws(":", row.cast("string"), F.lit(seed)).cast("binary"), 256), columns.payload_bytes // 64 + 1), 1, columns.payload_bytes).alias("payload"))
    if columns.timestamp:
        out.append(F.timestamp_millis(F.lit(columns.base_ms) + row * 1000).alias("event_time"))
    return frame.select(*out)


def older_rows(frame: DataFrame, seed: int = 42, payloads: int = 8) -> DataFrame:
    """user_id, row_id, value, payload_0..: the research generators' rows."""
    row, key = F.col("row_id"), F.col("key")
    return frame.select(key.alias("user_id"), row, stable_value(key, row, seed).alias("value"), *(stable_payload_value(key, row, seed, i).alias(f"payload_{i}") for i in range(payloads)))


def key_skew(frame: DataFrame, key: str) -> DataFrame:
    """One row: rows, distinct keys, max and mean frequency, their ratio, population CV, and the 20 most frequent keys."""
    counts = frame.groupBy(key).agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), key).limit(20).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).cast("string").alias("key")))).alias("t"))
    one = counts.agg(F.sum("n").alias("rows"), F.count("*").alias("distinct_keys"), F.max("n").alias("max_frequency"), F.avg("n").alias("mean_frequency"), (F.max("n") / F.avg("n")).alias("max_mean_ratio"), (F.stddev_pop("n") / F.avg("n")).alias("coefficient_of_variation"))
    return one.crossJoin(F.broadcast(top.select(F.transform("t", lambda x: F.struct(x["key"].alias("key"), (-x["m"]).alias("count"))).alias("top_keys"))))  # one row by one row


def top_keys(frame: DataFrame, key: str, n: int = 20) -> DataFrame:
    return frame.groupBy(key).agg(F.count("*").alias("count")).orderBy(F.desc("count"), key).limit(n)


#: Scenario of a suite: (left generator, right side); fixed names.
SUITE = {
    "uniform_no_skew": ("uniform", None),
    "single_heavy": ("single_heavy", None),
    "multi_heavy": ("multi_heavy", None),
    "zipf": ("zipf", None),
    "normal_key_hash_skew": ("collision", None),
    "small_right_join": ("single_heavy", "small"),
    "shared_heavy_join": ("single_heavy", "shared"),
    "one_sided_heavy_join": ("single_heavy", "one_sided"),
}


def suite_scenario(spark: SparkSession, name: str, rows: int, keys: int, fraction: float = 0.5, partitions: int = 16, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """(left, right or None) of a suite scenario."""
    left, right = SUITE[name]
    if left == "collision":
        few = max(1, min(keys, rows, 200))
        pool = collision_keys(spark, few, partitions, seed, "key").withColumn("i", F.monotonically_increasing_id())
        from pyspark.sql import Window as W

        pool = pool.select("key", (F.row_number().over(W.orderBy("key")) - 1).alias("i"))  # `few` rows
        frame = spark.range(rows).select(F.col("id").alias("row_id"), (F.col("id") % few).alias("i")).join(F.broadcast(pool), "i").select("row_id", "key")
    elif left == "uniform":
        frame = uniform(spark, rows, keys, seed)
    elif left == "zipf":
        frame = zipf(spark, rows, keys, 1.2, seed)
    elif left == "multi_heavy":
        frame = multi_heavy(spark, rows, keys, total=fraction, seed=seed)
    else:
        frame = single_heavy(spark, rows, keys, fraction, seed=seed)
    return frame, join_right_side(spark, right) if right else None
