"""Key frequencies, heavy keys, file and partition statistics.

Frequencies are one aggregation over the key columns with map-side combining; everything else
works on its result, so the data are read once. Hashes are taken of distinct keys, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ..functions.arithmetic import MIB, div_ceil, mb_to_bytes, salt_count_column, skew_frame
from ..functions.hashing import partition_id_column
from ..functions.keys import encode_key, structured_key
from ..sources.files import InputFile


def key_frequencies(frame: DataFrame, keys: Sequence[str], unsigned: Iterable[str] = ()) -> DataFrame:
    """key (canonical text), parts (structured), the key columns themselves as `k`, frequency.

    Groups by the key columns and encodes once a distinct key.
    """
    counts = frame.groupBy(*keys).agg(F.count("*").alias("frequency"))
    own = counts.select(*keys, "frequency")
    return own.select(encode_key(own, keys, unsigned).alias("key"), structured_key(own, keys, unsigned).alias("parts"), F.struct(*keys).alias("k"), "frequency")


def space_saving(keys: Iterable[str], capacity: int) -> tuple[dict[str, int], int]:
    """Space-Saving counters in the order seen: (key: count, largest count that was replaced)."""
    import heapq

    counts: dict[str, int] = {}
    heap: list[tuple[int, str]] = []
    worst, capacity = 0, max(1, capacity)
    for key in keys:
        if key in counts:
            counts[key] += 1
            continue
        if len(counts) < capacity:
            counts[key] = 1
            heapq.heappush(heap, (1, key))
            continue
        while True:  # entries of the heap may be behind; put them right until one is current
            n, least = heap[0]
            now = counts.get(least)
            if now is None:
                heapq.heappop(heap)
            elif now != n:
                heapq.heapreplace(heap, (now, least))
            else:
                break
        worst = max(worst, n)
        del counts[least]
        counts[key] = n + 1
        heapq.heapreplace(heap, (n + 1, key))
    return dict(sorted(counts.items())), worst


def approximate_frequencies(frame: DataFrame, keys: Sequence[str], capacity: int, unsigned: Iterable[str] = ()) -> tuple[DataFrame, dict[str, Any]]:
    """Space-Saving summaries of at most `capacity` counters a task, merged to `capacity` counters.

    A key's merged count is the sum of its counters, with the least counter of each full summary that
    does not hold it (an overestimate, as within one summary); the bound reported is the sum of the
    summaries' bounds or the largest count left out by the merge, whichever is larger.
    """
    spark = frame.sparkSession
    encoded = frame.select(encode_key(frame, keys, unsigned).alias("key"))

    def summarise(batches):
        seen_rows = 0

        def each():
            nonlocal seen_rows
            for b in batches:
                seen_rows += b.num_rows
                yield from b.column(0).to_pylist()

        counts, worst = space_saving(each(), capacity)
        if counts:
            least = min(counts.values()) if len(counts) >= capacity else 0
            yield pa.RecordBatch.from_pydict({"key": [*counts, None], "n": [*counts.values(), least], "worst": [worst] * (len(counts) + 1), "rows": [0] * len(counts) + [seen_rows]})

    parts = encoded.mapInArrow(summarise, "key string, n long, worst long, rows long")
    seen = parts.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("tasks"), F.sum("worst").alias("worst"), F.sum("rows").alias("rows"), F.sum(F.when(F.col("key").isNull(), F.col("n"))).alias("floor")).cache()
    try:
        totals = seen.where("key is null").select("worst", "floor", "rows").first()
        floor, worst = (int(totals["floor"] or 0), int(totals["worst"] or 0)) if totals else (0, 0)
        top = seen.where("key is not null").orderBy(F.desc("n"), "key").limit(capacity + 1).collect()  # bounded by capacity
    finally:
        seen.unpersist()
    left_out = int(top[capacity]["n"]) if len(top) > capacity else 0
    kept = top[:capacity]
    bound = max(worst, floor, left_out)
    rows = [(r["key"], int(r["n"])) for r in kept]
    out = spark.createDataFrame(rows, "key string, frequency long")
    return out, {"mode": "approximate", "capacity": capacity, "error_bound": f"space_saving_max_overestimate={bound}", "exact": False, "frequencies_truncated": True, "summary_size": len(rows), "max_error": bound, "observed_total_rows": int(totals["rows"]) if totals else 0}


def with_typed_keys(counters: DataFrame, frame: DataFrame, keys: Sequence[str], unsigned: Iterable[str] = ()) -> DataFrame:
    """counters (key, frequency; few) with `parts` and `k`, looked up in the rows: each task keeps one row a counter."""
    own = frame.select(encode_key(frame, keys, unsigned).alias("key"), structured_key(frame, keys, unsigned).alias("parts"), F.struct(*keys).alias("k"))
    wanted = F.broadcast(counters.select("key"))  # at most the summary's capacity
    return counters.join(own.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("parts").alias("parts"), F.first("k").alias("k")), "key")


def frequency_summary(frequencies: DataFrame) -> Row:
    """rows, distinct_keys, mean and max frequency; zeros for nothing."""
    return frequency_summary_frame(frequencies).first()


def frequency_summary_frame(frequencies: DataFrame) -> DataFrame:
    return frequencies.agg(
        F.coalesce(F.sum("frequency"), F.lit(0)).cast("long").alias("rows"),
        F.count("*").alias("distinct_keys"),
        F.coalesce(F.sum("frequency") / F.count("*"), F.lit(0.0)).alias("mean_key_frequency"),
        F.coalesce(F.max("frequency"), F.lit(0)).cast("long").alias("max_key_frequency"),
    )


def heavy_candidates(frequencies: DataFrame, alpha: float) -> DataFrame:
    """Keys more frequent than alpha times the mean."""
    mean = frequencies.agg((F.sum("frequency") / F.count("*")).alias("mean_"))  # one row
    return frequencies.join(F.broadcast(mean), F.col("frequency") > F.lit(alpha) * F.col("mean_")).drop("mean_")


def heavy_keys(frequencies: DataFrame, alpha: float, target_rows: int) -> DataFrame:
    """Keys above alpha times the mean or above target_rows, with the reasons in that order and their salts."""
    mean = frequencies.agg((F.sum("frequency") / F.count("*")).alias("mean_"))
    above, over = F.col("frequency") > F.lit(alpha) * F.col("mean_"), F.col("frequency") > F.lit(target_rows)
    reasons = F.array_compact(F.array(F.when(above, F.lit("above_mean_threshold")), F.when(over, F.lit("exceeds_target_partition_rows"))))
    return frequencies.join(F.broadcast(mean), above | over).withColumn("reasons", reasons).withColumn("salt_count", salt_count_column(F.col("frequency"), target_rows)).drop("mean_")


def partition_sizes(frequencies: DataFrame, partitions: int, seed: int) -> DataFrame:
    """partition_id, rows of each partition under plain hashing; empty ones are 0."""
    own = frequencies.select(partition_id_column(F.col("key"), seed, partitions).alias("partition_id"), F.col("frequency").alias("rows"))
    return _filled(own, partitions)


def _filled(own: DataFrame, partitions: int) -> DataFrame:
    """Sums of rows by partition_id. Empty partitions come by a union: a join on the hash would let the
    optimizer filter the scan by it, and so take the hash of every row."""
    none = own.sparkSession.range(partitions).select(F.col("id").cast("int").alias("partition_id"), F.lit(0).cast("long").alias("rows"))
    return own.unionByName(none).groupBy("partition_id").agg(F.sum("rows").cast("long").alias("rows"))


def hash_partition_sizes(frame: DataFrame, keys: Sequence[str], partitions: int, seed: int, unsigned: Iterable[str] = ()) -> DataFrame:
    """The same from all rows, without counting keys: for when frequencies are approximate."""
    hashed = frame.select(partition_id_column(encode_key(frame, keys, unsigned), seed, partitions).alias("partition_id"))
    return _filled(hashed.groupBy("partition_id").agg(F.count("*").alias("rows")), partitions)


def skew_statistics(sizes: DataFrame, column: str = "rows") -> DataFrame:
    """One row of skew statistics of partition sizes."""
    return skew_frame(sizes, column)


def size_list(sizes: DataFrame) -> list[int]:
    return [r["rows"] for r in sizes.orderBy("partition_id").collect()]  # one a partition


def file_frame(spark: SparkSession, files: Sequence[InputFile]) -> DataFrame:
    return spark.createDataFrame([(f.path, f.size_bytes) for f in files], "path string, size_bytes long")


def file_summary(files: Sequence[InputFile], min_file_mb: int, target_file_mb: int) -> dict[str, Any]:
    sizes = [f.size_bytes for f in files]
    return {
        "input_file_count": len(sizes),
        "min_file_size_bytes": min(sizes, default=None),
        "max_file_size_bytes": max(sizes, default=None),
        "mean_file_size_bytes": sum(sizes) / len(sizes) if sizes else None,
        "small_file_count": sum(s < mb_to_bytes(min_file_mb) for s in sizes),
        "oversized_file_count": sum(s > mb_to_bytes(target_file_mb) for s in sizes),
    }


def file_summary_frame(files: DataFrame, min_file_mb: int, target_file_mb: int) -> DataFrame:
    """The same over a file listing DataFrame (path, size_bytes)."""
    small, large = F.col("size_bytes") < mb_to_bytes(min_file_mb), F.col("size_bytes") > mb_to_bytes(target_file_mb)
    return files.agg(F.count("*").alias("input_file_count"), F.min("size_bytes").alias("min_file_size_bytes"), F.max("size_bytes").alias("max_file_size_bytes"), F.avg("size_bytes").alias("mean_file_size_bytes"), F.count_if(small).alias("small_file_count"), F.count_if(large).alias("oversized_file_count"))


def row_width(total_bytes: int, rows: int) -> int | None:
    """Bytes a row takes on disk, rounded up; None where either is 0."""
    return max(1, div_ceil(total_bytes, rows)) if total_bytes and rows else None


def dataset_mb(total_bytes: int) -> int | None:
    return div_ceil(total_bytes, MIB) if total_bytes else None


def observed_files(frame: DataFrame) -> DataFrame:
    """path, size_bytes and rows of the files a DataFrame reads."""
    return frame.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes")).groupBy("path", "size_bytes").agg(F.count("*").alias("rows"))
