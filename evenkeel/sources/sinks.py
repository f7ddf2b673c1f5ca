"""Writing layouts, manifests, metadata documents and reports."""

from __future__ import annotations

import csv
import io
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import UnsupportedFormat
from .files import InputDataset, _hadoop

PARTITION_DIR = "rp_partition"
VERSION = "0.2.0"
#: The table of all keys beside the documents; readers of the layout pass over names that begin so.
KEY_TABLE = "_keys.parquet"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, path: str, value: Any) -> None:
    write_text(spark, path, json.dumps(value, indent=2, default=str))


def max_records(row_width: int | None, target_file_bytes: int) -> int:
    """Rows a file holds before the next one begins; 0 (no limit) where the width is unknown."""
    return max(1, target_file_bytes // row_width) if row_width else 0


def write_layout(assigned: DataFrame, path: str, partitions: int, partition_column: str, fmt: str = "parquet", records: int = 0, keep: list[str] | None = None, mode: str = "overwrite", tasks: int | None = None) -> None:
    """One folder a partition, each partition written by one task: rows go straight to the task of their partition.

    tasks: how many write tasks share the partitions where there are more than that (else one each).
    """
    if fmt != "parquet":
        raise UnsupportedFormat(f"{fmt} output")
    frame = assigned.withColumn(PARTITION_DIR, F.col(partition_column).cast("int"))
    placed = frame.repartitionById(partitions, F.col(PARTITION_DIR))
    if keep is not None:
        placed = placed.select(*keep, PARTITION_DIR)
    placed.write.mode(mode).option("maxRecordsPerFile", records).partitionBy(PARTITION_DIR).parquet(path)


def manifest_frames(spark: SparkSession, path: str, partitions: int) -> tuple[DataFrame, DataFrame]:
    """(files: path, partition_id, row_count, size_bytes; partitions: partition_id, row_count, file_count, size_bytes), empty partitions included."""
    rows = spark.read.parquet(path).select(F.col(PARTITION_DIR).cast("int").alias("partition_id"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"))
    files = rows.groupBy("path", "partition_id", "size_bytes").agg(F.count("*").alias("row_count"))
    own = files.groupBy("partition_id").agg(F.sum("row_count").alias("row_count"), F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"))
    all_ = spark.range(partitions).select(F.col("id").cast("int").alias("partition_id"))
    each = all_.join(own, "partition_id", "left").select("partition_id", F.coalesce("row_count", F.lit(0)).alias("row_count"), F.coalesce("file_count", F.lit(0)).alias("file_count"), "size_bytes")
    return files, each


def manifest(spark: SparkSession, path: str, partitions: int) -> dict[str, Any]:
    """The manifest of a written layout; files and partitions are as many as were planned, so they fit the driver."""
    files, each = manifest_frames(spark, path, partitions)
    files = files.cache()
    try:
        listed = [{"path": r["path"], "partition_id": r["partition_id"], "row_count": r["row_count"], "size_bytes": r["size_bytes"]} for r in files.orderBy("path").collect()]
        parts = [r.asDict() for r in each.orderBy("partition_id").collect()]
    finally:
        files.unpersist()
    return {"version": VERSION, "input_reused": False, "dataset_location": path, "output_files": listed, "partitions": parts}


def reused_manifest(dataset: InputDataset, before_sizes: list[int]) -> dict[str, Any]:
    """The manifest of a no-op: the input is the output."""
    return {
        "version": VERSION,
        "input_reused": True,
        "dataset_location": dataset.path,
        "output_files": [],
        "partitions": [{"partition_id": i, "row_count": n, "file_count": 0, "size_bytes": None} for i, n in enumerate(before_sizes)],
    }


def write_metadata(spark: SparkSession, folder: str, plan: dict, stats: dict, manifest_: dict, keys: DataFrame) -> None:
    """The table of keys (key, frequency, partition_id) and the three documents, after the data, which a later overwrite would take along."""
    keys.write.mode("overwrite").parquet(f"{folder}/{KEY_TABLE}")
    for name, value in (("_partition_plan", plan), ("_stats", stats), ("_manifest", manifest_)):
        write_json(spark, f"{folder}/{name}.json", value)


def write_csv_rows(spark: SparkSession, path: str, rows: list[dict[str, Any]], columns: list[str]) -> None:
    out = io.StringIO()
    writer = csv.DictWriter(out, columns, extrasaction="ignore", lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    write_text(spark, path, out.getvalue())


RESULT_COLUMNS = ["workload", "mode", "dataset_label", "dataset_path", "elapsed_seconds", "rows", "result_rows", "partitions", "spark_app_id", "skipped", "skip_reason", "correctness_json", "extra_json"]


def write_reports(spark: SparkSession, results: list[dict[str, Any]], summary: dict[str, Any], json_path: str, csv_path: str) -> None:
    write_json(spark, json_path, {"summary": summary, "results": results})
    rows = [{**r, "correctness_json": json.dumps(r["correctness"], sort_keys=True), "extra_json": json.dumps(r["extra"], sort_keys=True)} for r in results]
    write_csv_rows(spark, csv_path, rows, RESULT_COLUMNS)


def write_experiment_summary(spark: SparkSession, folder: str, rows: list[dict[str, Any]], aggregated: list[dict[str, Any]]) -> None:
    """summary.csv and summary.json (aggregated), summary_raw.csv (as measured)."""
    for name, table in (("summary_raw", rows), ("summary", aggregated)):
        write_csv_rows(spark, f"{folder}/{name}.csv", table, list(dict.fromkeys(k for r in table for k in r)))
    write_json(spark, f"{folder}/summary.json", aggregated)


def write_generated(frame: DataFrame, path: str, files: int = 1, compression: str = "snappy", row_group_bytes: int | None = None, metadata: dict[str, Any] | None = None) -> int:
    """A generated dataset in so many files, its JSON side file, and the count read back, which must agree."""
    spark = frame.sparkSession
    writer = frame.repartition(files).write.mode("overwrite").option("compression", compression)
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    rows = spark.read.parquet(path).count()
    if metadata is not None:
        if metadata.get("rows", rows) != rows:
            raise ValueError(f"wrote {rows} rows, not {metadata['rows']}")
        write_json(spark, f"{path.rstrip('/')}.metadata.json", {**metadata, "rows": rows})
    return rows
