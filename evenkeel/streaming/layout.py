"""Keeping a layout up to date: micro-batches are assigned with a stored plan and appended.

The plan stays as it is; keys that it does not know go by hash, heavy keys are spread over their
planned salts by a hash of the row, so that batches need no memory of earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.assign import assign
from ..plans.planner import Plan
from ..sources.sinks import write_layout


def append_batches(stream: DataFrame, plan: Plan, keys: Sequence[str], path: str, checkpoint: str, partition_column: str = "_rp_partition_id") -> DataStreamWriter:
    """A writer that appends each micro-batch to the layout at path; start it, or run it once with a trigger."""

    def one(batch: DataFrame, number: int) -> None:
        rows = assign(batch, plan, keys, salting="spread")
        # A batch that is run again after a failure replaces what it wrote before.
        write_layout(rows, f"{path}/batch={number}", plan.partitions, partition_column, mode="overwrite")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
