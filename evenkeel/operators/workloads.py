"""The downstream workloads: scan, filter, group-by and join, plain and with help from a plan.

All return DataFrames (aggregates of one row where the workload is an aggregate). Broadcasts are
asked for only behind a check of the plan's or the data's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.hashing import partition_id_column
from ..functions.keys import encode_key, keys_frame
from ..plans.planner import Plan

TECHNICAL = ("rp_partition", "ap_partition", "_rp_partition_id", "_rp_salt", "_rp_is_heavy_key", "_ap_partition_id", "_ap_salt", "_ap_is_heavy_key")
WIDE = "decimal(38,0)"
#: Replicated rows of the heavy right side up to which it is broadcast.
BROADCAST_ROWS = 100_000


# --- columns --------------------------------------------------------------------------------------


def unique_in_order(names: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(names))


def _numbered(names: Iterable[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def work_columns(names: Iterable[str]) -> list[str]:
    """`value` first, then payload_0, payload_1, ... by number."""
    names = list(names)
    return [n for n in names if n == "value"] + _numbered(names, r"payload_(\d+)")


def numeric_work_columns(frame: DataFrame) -> list[str]:
    numeric = {f.name for f in frame.schema.fields if isinstance(f.dataType, T.NumericType)}
    return [c for c in work_columns(frame.columns) if c in numeric]


def grouped_work_columns(names: Iterable[str]) -> list[str]:
    names = list(names)
    return [n for n in names if n == "value_sum"] + _numbered(names, r"payload_(\d+)_sum")


def wide_sum(column: str, name: str | None = None) -> Column:
    return F.coalesce(F.sum(F.col(column).cast(WIDE)), F.lit(0).cast(WIDE)).alias(name or f"{column}_sum")


def without_technical(frame: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    return frame.drop(*(c for c in frame.columns if c in {*TECHNICAL, *more}))


# --- scan and filter --------------------------------------------------------------------------------


def scan(frame: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """rows, and the sum of each work column."""
    columns = numeric_work_columns(frame) if columns is None else list(columns)
    return frame.agg(F.count("*").alias("rows"), *map(wide_sum, columns))


def key_sample(frame: DataFrame, key: str, of: int = 10) -> DataFrame:
    """About one key in `of`, by the engine's own hash."""
    return frame.where(F.pmod(F.xxhash64(F.col(key)), F.lit(of)) == 0)


def key_sample_fnv(frame: DataFrame, keys: Sequence[str], seed: int = 42, of: int = 10) -> DataFrame:
    """The same by the layout's hash, which does not depend on the engine."""
    return frame.where(partition_id_column(encode_key(frame, keys), seed, of) == 0)


def filtered(frame: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    return scan(key_sample(frame, key), columns)


# --- group by -----------------------------------------------------------------------------------------


def group_by(frame: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """count and sums by key. Spark combines on the map side, so a heavy key costs one row a task."""
    columns = numeric_work_columns(frame) if columns is None else list(columns)
    return frame.groupBy(*keys).agg(F.count("*").alias("count"), *map(wide_sum, columns))


def two_stage_group_by(frame: DataFrame, partial: Sequence[str], final: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """The same by way of partial groups (partition, salt, key). One exchange more than group_by; kept
    for aggregates that do not combine on the map side, and for comparison."""
    columns = numeric_work_columns(frame) if columns is None else list(columns)
    parts = group_by(frame, unique_in_order([*partial, *final]), columns)
    return parts.groupBy(*final).agg(F.sum("count").alias("count"), *(F.sum(f"{c}_sum").cast(WIDE).alias(f"{c}_sum") for c in columns))


def group_totals(groups: DataFrame) -> DataFrame:
    """result_rows, rows, max_group_count, and the total of each sum."""
    sums = grouped_work_columns(groups.columns)
    return groups.agg(F.count("*").alias("result_rows"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows"), F.coalesce(F.max("count"), F.lit(0)).alias("max_group_count"), *(wide_sum(c, f"{c}_total") for c in sums))


def resolve_columns(names: Sequence[str], plan: dict[str, Any] | None) -> tuple[str | None, str | None]:
    """(partition, salt) columns of a prepared dataset: the plan's, else the usual names; None where absent."""
    t = (plan or {}).get("technical_columns") or {}
    pick = lambda wanted: next((c for c in wanted if c and c in names), None)
    return pick([t.get("partition_column"), "rp_partition", "ap_partition"]), pick([t.get("salt_column"), "_rp_salt", "_ap_salt"])


def partial_keys(names: Sequence[str], plan: dict[str, Any] | None, keys: Sequence[str]) -> tuple[list[str], str | None]:
    """(partial group keys, why they are less than planned or None)."""
    partition, salt = resolve_columns(names, plan)
    wanted = list(((plan or {}).get("recommended_downstream_plan") or {}).get("partial_group_keys") or [])
    missing = [c for c in wanted if c not in names]
    if wanted and not [c for c in missing if c != salt and "salt" not in c]:
        own = [c for c in wanted if c in names]
        if salt and salt not in own:
            own.insert(1 if partition in own else 0, salt)
        return unique_in_order([*own, *keys]), "missing_salt_column" if missing and not salt else None
    own = [c for c in (partition, salt) if c]
    return unique_in_order([*own, *keys]), None if len(own) == 2 else "missing_partition_column" if not partition else "missing_salt_column"


# --- joins ----------------------------------------------------------------------------------------------


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def broadcast_join(left: DataFrame, right: DataFrame, keys: Sequence[str], right_mb: int | None, threshold_mb: int) -> DataFrame:
    """With the right side broadcast where its size is known and within the threshold; a plain join else."""
    return left.join(F.broadcast(right) if right_mb is not None and right_mb <= threshold_mb else right, list(keys), "inner")


def heavy_join(left: DataFrame, right: DataFrame, keys: Sequence[str], heavy: DataFrame, salts: DataFrame | None, salt: str | None, replicas: int | None = None) -> DataFrame:
    """Inner join that treats the keys in `heavy` (typed key columns) apart.

    Rows of heavy keys that carry a salt meet the right side's rows of that key replicated once a
    salt (salts: key columns and salt_count); rows of heavy keys without a salt, and all other rows,
    join as usual. Any number of key columns; the right side may repeat keys and keeps its columns.
    replicas: how many rows the replicated right side has, if known; broadcast up to a bound.
    """
    keys = list(keys)
    flags = heavy.select(*(F.col(k).alias(f"__h_{k}") for k in keys)).distinct()
    same = lambda df: [df[k].eqNullSafe(flags[f"__h_{k}"]) for k in keys]
    split = lambda df, how: df.join(flags, same(df), how)
    left_normal, left_heavy = split(left, "left_anti"), split(left, "left_semi")
    right_normal, right_heavy = split(right, "left_anti"), split(right, "left_semi")
    out = left_normal.join(right_normal, keys, "inner")
    if salt is None or salt not in left.columns:
        return out.unionByName(left_heavy.join(right_heavy, keys, "inner"))
    counts = (salts if salts is not None else heavy.withColumn("salt_count", F.lit(1))).select(*(F.col(k).alias(f"__s_{k}") for k in keys), F.col("salt_count").cast("int").alias("__count"))
    spread = right_heavy.join(counts, [right_heavy[k].eqNullSafe(counts[f"__s_{k}"]) for k in keys], "left")
    copies = spread.withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce("__count", F.lit(1)) - 1))).drop("__count", *(f"__s_{k}" for k in keys))
    if replicas is not None and replicas <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    salted = left_heavy.where(F.col(salt).isNotNull()).withColumn(salt, F.col(salt).cast("int"))
    plain = left_heavy.where(F.col(salt).isNull())
    names = out.columns
    return out.unionByName(salted.join(copies, [*keys, salt], "inner").select(*names)).unionByName(plain.join(right_heavy, keys, "inner").select(*names))


def replicated_rows(right: DataFrame, keys: Sequence[str], salts: DataFrame) -> DataFrame:
    """One row: rows that salting adds to the right side."""
    joined = right.join(salts.select(*keys, "salt_count"), list(keys), "inner")
    return joined.agg(F.coalesce(F.sum(F.col("salt_count") - 1), F.lit(0)).cast("long").alias("right_replication_rows"))


def plan_heavy_keys(left: DataFrame, plan: dict[str, Any], keys: Sequence[str], shared_only: bool) -> tuple[DataFrame, DataFrame]:
    """(heavy keys, salt counts) of a plan document, as typed key columns of left."""
    spark, join = left.sparkSession, plan["join_plan"]
    sides = ["shared"] if shared_only else ["left", "right"]
    listed = {k["encoded"]: k["parts"] for s in sides for k in join[f"{s}_heavy_key_values"]}
    heavy = keys_frame(spark, list(listed.values()), left.schema, keys)
    own = [h for h in plan["heavy_keys"] if h["key"] in listed]
    rows = [(*r, h["salt_count"]) for r, h in zip(map(tuple, keys_frame(spark, [h["structured_key"]["parts"] for h in own], left.schema, keys).collect()), own, strict=True)]
    schema = T.StructType([*(T.StructField(k, left.schema[k].dataType) for k in keys), T.StructField("salt_count", T.IntegerType())])
    return heavy, spark.createDataFrame(rows, schema)


def heavy_predicate(frame: DataFrame, keys: Sequence[str], heavy: DataFrame) -> DataFrame:
    """frame with a boolean `is_heavy`, never null: a join, not a tree of ORs."""
    flags = heavy.select(*(F.col(k).alias(f"__h_{k}") for k in keys), F.lit(True).alias("__hit")).distinct()
    joined = frame.join(flags, [frame[k].eqNullSafe(flags[f"__h_{k}"]) for k in keys], "left")
    return joined.withColumn("is_heavy", F.coalesce("__hit", F.lit(False))).drop("__hit", *(f"__h_{k}" for k in keys))


JOIN_STRATEGIES = ("broadcast_join", "salted_heavy_key_join", "heavy_key_isolation_join", "physical_repartitioning", "generic_join_repartitioning")


def skip_reason(plan: dict[str, Any] | None, manifest: dict[str, Any] | None, keys: Sequence[str], names: Sequence[str]) -> str | None:
    """Why a method-aware join does not run; the first reason that applies. Composite keys are supported."""
    if not plan:
        return "partition_plan_missing"
    if manifest and manifest.get("input_reused"):
        return "input_reused"
    own = plan.get("recommended_downstream_plan") or {}
    if plan.get("job_type") != "join" or own.get("job_type") != "join":
        return "partition_plan_job_type_not_join"
    if list(own.get("join_keys") or []) != list(keys):
        return "join_key_mismatch"
    strategy = own.get("strategy")
    if strategy in ("salted_heavy_key_join", "heavy_key_isolation_join") and resolve_columns(names, plan)[1] is None:
        return "missing_technical_columns"
    if strategy not in JOIN_STRATEGIES:
        return "unsupported_join_strategy"
    if strategy in ("salted_heavy_key_join", "heavy_key_isolation_join"):
        every = [k for s in ("left", "right", "shared") for k in (plan.get("join_plan") or {}).get(f"{s}_heavy_key_values", [])]
        if any([p["column"] for p in k.get("parts", [])] != list(keys) for k in every):
            return "invalid_structured_heavy_keys"
    return None


def method_aware_join(left: DataFrame, right: DataFrame, keys: Sequence[str], plan: dict[str, Any]) -> tuple[DataFrame, dict[str, Any]]:
    """(joined, what was done) by the strategy that the plan recommends."""
    strategy = plan["recommended_downstream_plan"]["strategy"]
    _, salt = resolve_columns(left.columns, plan)
    joined = plan.get("join_plan") or {}
    if strategy == "broadcast_join":
        return broadcast_join(left, right, keys, joined.get("right_side_size_mb"), joined.get("broadcast_threshold_mb", 0)), {"strategy": strategy}
    if strategy in ("salted_heavy_key_join", "heavy_key_isolation_join"):
        heavy, salts = plan_heavy_keys(left, plan, keys, strategy == "salted_heavy_key_join")
        return heavy_join(left, right, keys, heavy, salts, salt), {"strategy": strategy, "heavy_keys": len(plan["heavy_keys"])}
    if strategy == "physical_repartitioning":
        return inner_join(left, right, keys), {"strategy": strategy}
    return inner_join(left, right, keys), {"strategy": strategy, "degraded_reason": "unknown_strategy"}


def planned_salts(plan: Plan, left: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(heavy keys, salt counts) of a plan that was not written out."""
    rows = [{"structured_key": {"parts": h["parts"]}, "salt_count": h["salt_count"]} for h in plan.heavy]
    document = {"heavy_keys": [{"key": h["key"], **r} for h, r in zip(plan.heavy, rows, strict=True)], "join_plan": {"shared_heavy_key_values": [{"encoded": h["key"], "parts": h["parts"]} for h in plan.heavy]}}
    return plan_heavy_keys(left, document, keys, True)


def join_metrics(joined: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """rows, distinct_keys, sums, and an order-free checksum of the key and work columns."""
    columns = numeric_work_columns(joined) if columns is None else list(columns)
    return joined.agg(F.count("*").alias("rows"), F.count_distinct(*(F.col(k) for k in keys)).alias("distinct_keys"), *map(wide_sum, columns), checksum([*keys, *columns]).alias("checksum"))


def checksum(columns: Sequence[str]) -> Column:
    """Order-free checksum of rows: the sum of a hash of each row. Nulls are marked, so that they do not slide between columns."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c).cast("string"))]
    return F.sum(F.xxhash64(*marked).cast(WIDE))
