"""Preparing a dataset: statistics, plan, and either a rewrite or the decision to leave it as it is."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .functions.arithmetic import mb_to_bytes
from .functions.keys import unsigned_columns
from .operators.assign import assign
from .plans.planner import Plan, build_plan, set_after, side_statistics
from .session import ship
from .sources.files import InputDataset, read_dataset
from .sources.sinks import manifest, max_records, reused_manifest, write_layout, write_metadata


@dataclass
class Prepared:
    plan: Plan
    statistics: dict[str, Any]
    manifest: dict[str, Any]
    path: str

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.manifest["dataset_location"])


def _unsigned(spark: SparkSession, dataset: InputDataset, keys: tuple[str, ...]) -> tuple[str, ...]:
    if dataset.format != "parquet" or not dataset.files:
        return ()
    return tuple(c for c in unsigned_columns(spark, dataset.files[0].path) if c in keys)


def plan_dataset(spark: SparkSession, config: Config, dataset: InputDataset | None = None, right: InputDataset | None = None) -> tuple[Plan, InputDataset, tuple[str, ...]]:
    """The plan of a configured dataset; nothing is written."""
    ship(spark)
    config = config.for_join()
    keys = config.partitioning.key_columns
    dataset = dataset or read_dataset(spark, config.dataset.input, config.dataset.input_format)
    unsigned = _unsigned(spark, dataset, keys)
    left = side_statistics(config, dataset, keys, unsigned)
    other = None
    if config.job.type == "join" and config.join:
        right = right or read_dataset(spark, config.join.right_input, config.dataset.input_format)
        other = side_statistics(config, right, config.join.join_keys, _unsigned(spark, right, config.join.join_keys))
    try:
        return build_plan(spark, config, left, other), dataset, unsigned
    finally:  # the plan holds what it needs
        for side in (left, other):
            if side:
                side.frequencies.unpersist()


def run(spark: SparkSession, config: Config, salting: str = "round_robin") -> Prepared:
    """Plans and, where the plan says so, rewrites; data first, metadata after."""
    begun = time.time()
    own = config.for_join()
    plan, dataset, unsigned = plan_dataset(spark, config)
    planned = time.time()
    out, keys = own.output, own.partitioning.key_columns
    written = planned
    if plan.rewrite:
        columns = (out.partition_column, out.salt_column, out.heavy_key_column)
        rows = assign(dataset.frame, plan, keys, unsigned, salting, columns)
        records = max_records(plan.statistics["input"]["estimated_row_width_bytes"], mb_to_bytes(own.storage.target_file_size_mb))
        keep = [*dataset.frame.columns, *(columns if out.include_technical_columns else ())]
        write_layout(rows, out.path, plan.partitions, out.partition_column, out.format, records, keep)
        written = time.time()
        done = manifest(spark, out.path, plan.partitions)
        set_after(plan.statistics, [p["row_count"] for p in done["partitions"]])
    else:
        done = reused_manifest(dataset, plan.statistics["estimates"]["before_partition_sizes"])
    plan.statistics["timing"] = {"read_seconds": 0.0, "statistics_seconds": planned - begun, "planning_seconds": 0.0, "assignment_seconds": 0.0, "writing_seconds": written - planned, "total_seconds": time.time() - begun}
    write_metadata(spark, out.path, plan.document, plan.statistics, done, plan.keys)
    return Prepared(plan, plan.statistics, done, out.path)
