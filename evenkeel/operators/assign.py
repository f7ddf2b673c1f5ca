"""Rows to partitions: planned partition of ordinary keys, salts of heavy keys.

Plan tables are joined on the key's canonical text. They are broadcast only up to a stated number
of keys, beyond it they are joined like any table.

Salting: `round_robin` gives the i-th occurrence of a heavy key in scan order the salt i mod S, by
local row numbers within blocks of bounded size and a prefix sum over the blocks' counts, so that
no task sees all rows of a key; `spread` takes a hash of file and row and needs no second pass.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.hashing import partition_id_column
from ..functions.keys import encode_key
from ..plans.planner import Plan

#: Plan rows up to which a plan table is broadcast.
BROADCAST_KEYS = 100_000
#: Rows of a block in which occurrences are numbered locally.
BLOCK = 1 << 20


def scan_order(frame: DataFrame) -> tuple[Column, Column]:
    """(file, row in the file) of a DataFrame over files; of any other (task, row in the task)."""
    try:
        frame.select("_metadata.row_index")
        return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), F.col("_metadata.row_index")
    except Exception:  # noqa: BLE001  no such column: not read from files
        i = F.monotonically_increasing_id()
        return F.lpad(F.shiftright(i, 33).cast("string"), 12, "0"), i.bitwiseAND(F.lit((1 << 33) - 1))


def numbered(rows: DataFrame, by: Sequence[str], file: str, at: str, out: str) -> DataFrame:
    """rows with the 0-based number of each among those with equal `by`, in the order of (file, at)."""
    block = rows.withColumn("__block", F.floor(F.col(at) / BLOCK).cast("long"))
    local = block.withColumn("__n", F.row_number().over(W.partitionBy(*by, file, "__block").orderBy(at)))
    counts = block.groupBy(*by, file, "__block").agg(F.count("*").alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(W.partitionBy(*by).orderBy(file, "__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, file, "__block", before.alias("__before"))
    joined = local.join(offsets, [*by, file, "__block"])
    return joined.withColumn(out, F.col("__n") - 1 + F.col("__before")).drop("__block", "__n", "__before")


def assign(frame: DataFrame, plan: Plan, keys: Sequence[str], unsigned: Iterable[str] = (), salting: str = "round_robin", columns: tuple[str, str, str] = ("_rp_partition_id", "_rp_salt", "_rp_is_heavy_key")) -> DataFrame:
    """frame with partition, salt (null for ordinary keys) and heavy flag."""
    partition, salt, heavy = columns
    names = frame.columns
    file, at = scan_order(frame)
    base = frame.withColumns({"__file": file, "__at": at}) if plan.heavy else frame
    rows = base.withColumn("__key", encode_key(frame, keys, unsigned))
    small = lambda t, n: F.broadcast(t) if n <= BROADCAST_KEYS else t
    salts = plan.salts.withColumnRenamed("key", "__key")
    if plan.heavy:
        count = sum(len(h["salt_partitions"]) for h in plan.document["heavy_keys"])
        rows = rows.join(small(salts, count), "__key", "left")
    ordinary = rows.where("salt_count is null").drop("salt_count", "partitions", "__file", "__at") if plan.heavy else rows
    by_hash = partition_id_column(F.col("__key"), plan.seed, plan.partitions)
    if plan.normal is not None:
        ordinary = ordinary.join(small(plan.normal.withColumnRenamed("key", "__key").withColumnRenamed("partition_id", "__pid"), plan.normal_count), "__key", "left")
        by_hash = F.coalesce("__pid", by_hash)
    ordinary = ordinary.select(*names, by_hash.cast("int").alias(partition), F.lit(None).cast("int").alias(salt), F.lit(False).alias(heavy))
    if not plan.heavy:
        return ordinary
    hot = rows.where("salt_count is not null")
    if salting == "round_robin":
        hot = numbered(hot, ["__key"], "__file", "__at", "__i").withColumn("__salt", (F.col("__i") % F.col("salt_count")).cast("int"))
    elif salting == "spread":
        hot = hot.withColumn("__salt", F.pmod(F.xxhash64("__file", "__at"), F.col("salt_count")).cast("int"))
    else:
        raise ValueError(f"unknown salting: {salting}")
    hot = hot.select(*names, F.element_at("partitions", F.col("__salt") + 1).alias(partition), F.col("__salt").alias(salt), F.lit(True).alias(heavy))
    return ordinary.unionByName(hot)


def partitions_of_key(plan_document: dict, encoded: str, keys: DataFrame | None = None) -> list[int]:
    """Partitions that may hold a key: for point look-ups that prune partition folders. keys: the plan's table, for keys that the document does not list."""
    for h in plan_document["heavy_keys"]:
        if h["key"] == encoded:
            return sorted({s["partition_id"] for s in h["salt_partitions"]})
    for k in plan_document["normal_keys"]:
        if k["key"] == encoded:
            return [k["partition_id"]]
    found = keys.where((F.col("key") == encoded) & F.col("partition_id").isNotNull()).first() if keys is not None else None
    if found:
        return [found["partition_id"]]
    return list(range(plan_document["output_partitions"]))
