"""From statistics to a plan: heavy keys, placement, rewrite decision, join plan, recommendation."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config
from ..errors import FileSizeBalancingNotImplemented, ResourceLimitExceeded
from ..functions.arithmetic import imbalance, mb_to_bytes, skew
from ..functions.hashing import partition_id_column
from ..operators import statistics as st
from ..session import scratch_folder
from ..sources.files import InputDataset, InputFile, read_json
from ..sources.sinks import KEY_TABLE, VERSION
from .placement import Loads, place_each, place_salts
from .targeting import Target, target

#: Keys that metadata documents list; the whole table is written beside them (KEY_TABLE).
LISTED_KEYS = 10_000
#: Placed keys that the driver holds at a time; a plan of more becomes a table in the shared folder.
PLACED_BATCH = 100_000


@dataclass
class SideStatistics:
    """Statistics of one input: everything that planning needs, heavy keys on the driver, frequencies as a DataFrame."""

    dataset_bytes: int
    files: list[InputFile]
    rows: int
    distinct_keys: int | None
    mean: float
    most: int
    target: Target
    width: int | None
    before: list[int]
    heavy: list[dict[str, Any]]
    candidates: list[str]
    detection: dict[str, Any]
    frequencies: DataFrame  # kept while planning
    warnings: list[str] = field(default_factory=list)

    @property
    def exact(self) -> bool:
        return self.detection["exact"]


def side_statistics(config: Config, dataset: InputDataset, keys: tuple[str, ...], unsigned: tuple[str, ...] = ()) -> SideStatistics:
    """One aggregation over the key columns, or in approximate mode one summary a task; frequencies are kept (spilling to disk), rows are not."""
    frame, p = dataset.frame, config.partitioning
    approximate = config.statistics.heavy_hitter_mode == "approximate"
    if approximate:  # no key is counted exactly
        frequencies, detection = st.approximate_frequencies(frame, keys, config.statistics.approximate_capacity, unsigned)
        frequencies = st.with_typed_keys(frequencies, frame, keys, unsigned).persist()
        summary, rows, distinct = st.frequency_summary(frequencies), detection["observed_total_rows"], None
    else:
        frequencies = st.key_frequencies(frame, keys, unsigned).persist()
        summary = st.frequency_summary(frequencies)
        rows, distinct = int(summary["rows"]), int(summary["distinct_keys"])
        detection = {"mode": "exact", "capacity": config.statistics.approximate_capacity, "error_bound": "0", "exact": True, "frequencies_truncated": False, "summary_size": distinct, "max_error": 0, "observed_total_rows": rows}
    size = dataset.size_bytes
    mb = st.dataset_mb(size)
    limit = config.resources.memory_limit_mb
    warnings = []
    if mb is not None and mb > limit:
        if config.resources.fail_on_memory_limit:
            raise ResourceLimitExceeded(mb, limit)
        warnings.append("estimated_dataset_size_exceeds_configured_memory_limit")
    width = st.row_width(size, rows)
    goal = target(rows, width, p.target_partition_size_mb, p.min_partitions, p.max_partitions)
    # All of them, as documents and join plans list them: distinct keys / alpha and rows / target rows at most.
    heavy_rows = sorted(st.heavy_keys(frequencies, p.heavy_key_alpha, goal.target_rows).collect(), key=lambda r: r["key"].encode())
    heavy = [
        {"key": r["key"], "parts": [x.asDict() for x in r["parts"]], "frequency": int(r["frequency"]), "reasons": list(r["reasons"]), "salt_count": int(r["salt_count"])}
        for r in heavy_rows
    ]
    mean = float(summary["mean_key_frequency"])
    return SideStatistics(
        size, dataset.files, rows, distinct, mean, int(summary["max_key_frequency"]), goal, width,
        st.size_list(st.hash_partition_sizes(frame, keys, goal.partitions, p.seed, unsigned) if approximate else st.partition_sizes(frequencies, goal.partitions, p.seed)),
        heavy, [h["key"] for h in heavy if "above_mean_threshold" in h["reasons"]], detection, frequencies, warnings,
    )


@dataclass
class Plan:
    """The plan document, and the tables rows are assigned with."""

    document: dict[str, Any]
    statistics: dict[str, Any]
    partitions: int
    seed: int
    normal: DataFrame | None  # key, partition_id; keys not in it go by hash
    normal_count: int
    salts: DataFrame  # key, salt_count, partitions (by salt)
    heavy: list[dict[str, Any]]
    keys: DataFrame  # key, frequency, partition_id of all keys; null for heavy ones, whose salts the document lists

    @property
    def rewrite(self) -> bool:
        return self.document["rewrite_required"]


def rewrite_decision(job: str, force: bool, heavy: bool, complete: bool, before: list[int], planned: list[int], target_rows: int, threshold: float) -> tuple[bool, str]:
    """(rewrite, reason); the first rule that applies decides."""
    if force:
        return True, "force_rewrite"
    if job in ("scan", "filter"):
        return False, "downstream_operator_not_skew_sensitive"
    if heavy:
        return True, "heavy_keys_detected"
    if not complete:
        return False, "normal_key_assignment_incomplete"
    better = sum(before) != sum(planned) or imbalance(planned) < imbalance(before) or max(planned, default=0) < max(before, default=0)
    for applies, reason in ((max(before, default=0) > target_rows, "max_partition_exceeds_target_rows"), (imbalance(before) > threshold, "imbalance_ratio_exceeds_no_op_threshold")):
        if applies:
            return (True, reason) if better else (False, "planned_distribution_does_not_improve_skew")
    return False, "no_rewrite_needed"


def join_strategy(mode: str, right_mb: int | None, threshold_mb: int, left: list[str], right: list[str]) -> str:
    if mode == "broadcast_if_small" and right_mb is not None and right_mb <= threshold_mb:
        return "broadcast_join_recommendation"
    if set(left) & set(right):
        return "salted_heavy_key_join"
    return "heavy_key_isolation_join" if left or right else "physical_only"


def _plan_key(h: dict[str, Any]) -> dict[str, Any]:
    return {"encoded": h["key"], "parts": h["parts"]}


def join_plan(config: Config, left: SideStatistics, right: SideStatistics | None) -> dict[str, Any] | None:
    if config.join is None or config.job.type != "join" or right is None:
        return None
    there = {h["key"] for h in right.heavy}
    shared = [h for h in left.heavy if h["key"] in there]
    right_mb = st.dataset_mb(right.dataset_bytes)
    names = lambda x: [h["key"] for h in x]
    return {
        "left_heavy_keys": names(left.heavy),
        "right_heavy_keys": names(right.heavy),
        "shared_heavy_keys": names(shared),
        "left_heavy_key_values": list(map(_plan_key, left.heavy)),
        "right_heavy_key_values": list(map(_plan_key, right.heavy)),
        "shared_heavy_key_values": list(map(_plan_key, shared)),
        "recommended_strategy": join_strategy(config.join.right_side_mode, right_mb, config.join.broadcast_threshold_mb, names(left.heavy), names(right.heavy)),
        "right_side_size_mb": right_mb,
        "broadcast_threshold_mb": config.join.broadcast_threshold_mb,
    }


#: Join strategy: (downstream strategy, whether the operator changes, note); fixed values.
JOIN_RECOMMENDATIONS = {
    "broadcast_join_recommendation": ("broadcast_join", True, "right_side_broadcastable"),
    "salted_heavy_key_join": ("salted_heavy_key_join", True, "shared_heavy_keys_detected"),
    "heavy_key_isolation_join": ("heavy_key_isolation_join", True, "one_sided_heavy_keys_detected"),
    "physical_only": ("physical_repartitioning", False, "no_join_heavy_keys_detected"),
}


def recommendation(config: Config, joined: dict[str, Any] | None) -> dict[str, Any]:
    out, keys, job = config.output, list(config.partitioning.key_columns), config.job.type
    technical = out.include_technical_columns
    notes = [] if technical else ["technical_columns_disabled"]
    strategy, changes, partial, final, join_keys = "input_reuse_no_op", False, [], [], []
    if job == "filter":
        notes += ["filter_selectivity_unknown", "filter_no_key_shuffle"]
    elif job == "group_by":
        strategy, changes, final = "two_stage_group_by", True, keys
        partial = ([out.partition_column, out.salt_column] if technical else []) + keys
        if not technical:
            notes.append("method_aware_group_by_requires_technical_columns")
    elif job == "join":
        join_keys = list(config.join.join_keys) if config.join else keys
        strategy, changes, note = JOIN_RECOMMENDATIONS.get((joined or {}).get("recommended_strategy"), ("generic_join_repartitioning", True, "join_plan_missing"))
        notes.append(note)
    elif job == "generic":
        strategy = "physical_repartitioning"
    named = lambda c: c if technical else None
    return {"job_type": job, "strategy": strategy, "requires_operator_rewrite": changes, "partition_column": named(out.partition_column), "salt_column": named(out.salt_column), "heavy_key_column": named(out.heavy_key_column), "partial_group_keys": partial, "final_group_keys": final, "join_keys": join_keys, "notes": notes}


def _heavy_document(h: dict[str, Any], salts: list[int] | None) -> dict[str, Any]:
    return {"key": h["key"], "structured_key": _plan_key(h), "estimated_frequency": h["frequency"], "detection_reasons": h["reasons"], "salt_count": len(salts) if salts else 1, "salt_partitions": [{"salt_index": i, "partition_id": p} for i, p in enumerate(salts or [])]}


def place_all(spark: SparkSession, ordered: DataFrame, loads: Loads, seed: int) -> tuple[DataFrame, int]:
    """(key, frequency, partition_id; how many) of sorted (key, frequency), which stream through the driver."""
    schema, folder, count, batch = "key string, frequency long, partition_id int", None, 0, []
    for row in place_each(((r["key"], int(r["frequency"])) for r in ordered.toLocalIterator()), loads, seed):
        if len(batch) == PLACED_BATCH:
            folder = folder or scratch_folder(spark, "placed")
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
            batch = []
        batch.append(row)
        count += 1
    frame = spark.createDataFrame(batch, schema)
    if folder is None:
        return frame, count
    frame.coalesce(1).write.mode("append").parquet(folder)
    return spark.read.schema(schema).parquet(folder), count


def build_plan(spark: SparkSession, config: Config, left: SideStatistics, right: SideStatistics | None = None) -> Plan:
    p, n = config.partitioning, left.target.partitions
    if p.strategy == "file_size_balancing":
        raise FileSizeBalancingNotImplemented
    heavy_names = [h["key"] for h in left.heavy]
    heavy_frame = spark.createDataFrame([(k,) for k in heavy_names], "key string")
    loads = Loads([0] * n)
    complete, notes, mode = left.exact, [], p.normal_key_assignment
    listed, normal_frame, normal_count, placed_all = [], None, 0, True
    by_hash = partition_id_column(F.col("key"), p.seed, n).cast("int").alias("partition_id")
    others = left.frequencies.select("key", "frequency").join(heavy_frame, "key", "left_anti").select("key", "frequency", by_hash)
    if not left.exact:
        notes.append("normal_key_frequencies_truncated")
        if mode == "load_aware":
            notes.append("load_aware_normal_assignment_disabled_in_approximate_mode")
        mode = "hash"
    else:
        ordinary = left.frequencies.select("key", "frequency").join(heavy_frame, "key", "left_anti")
        if mode == "load_aware":
            ordered = ordinary.orderBy(F.desc("frequency"), "key")
            placed_all = p.max_placed_keys is None or left.distinct_keys - len(left.heavy) <= p.max_placed_keys
            if not placed_all:  # as asked for, the rarest go by hash; their loads are known before any key is placed
                notes.append("load_aware_normal_assignment_limited_to_most_frequent_keys")
                ordered = ordered.limit(p.max_placed_keys)
                last = ordered.orderBy("frequency", F.desc("key")).first()
                rest = ordinary.where((F.col("frequency") < last["frequency"]) | ((F.col("frequency") == last["frequency"]) & (F.col("key") > last["key"])))
                loads = Loads(st.size_list(st.partition_sizes(rest, n, p.seed)))
                ordered = ordered.orderBy(F.desc("frequency"), "key")
            placed, normal_count = place_all(spark, ordered, loads, p.seed)
            normal_frame = placed.select("key", "partition_id")
            listed = placed.orderBy("key").limit(LISTED_KEYS).collect()
            others = placed if placed_all else placed.unionByName(rest.select("key", "frequency", by_hash))
        else:
            loads = Loads(st.size_list(st.partition_sizes(ordinary, n, p.seed)))
            listed = ordinary.withColumn("partition_id", partition_id_column(F.col("key"), p.seed, n)).orderBy(F.desc("frequency"), "key").limit(LISTED_KEYS).collect()
            normal_count = left.distinct_keys - len(left.heavy)
    salts = place_salts(((h["key"], h["frequency"]) for h in left.heavy), loads, left.target.target_rows, p.seed)
    rewrite, reason = rewrite_decision(config.job.type, p.force_rewrite, bool(left.heavy), complete, left.before, loads.sizes, left.target.target_rows, p.no_op_max_imbalance_ratio)
    joined = join_plan(config, left, right)
    size = left.dataset_bytes or None
    out = config.output
    document = {
        "version": VERSION,
        "created_at": f"unix_seconds:{int(time.time())}",
        "strategy": p.strategy,
        "action": "rewrite" if rewrite else "no_op",
        "rewrite_required": rewrite,
        "key_columns": list(p.key_columns),
        "job_type": config.job.type,
        "downstream_engine": config.job.downstream_engine,
        "target_partition_size_mb": p.target_partition_size_mb,
        "target_partition_rows": left.target.target_rows,
        "min_partitions": p.min_partitions,
        "max_partitions": p.max_partitions,
        "output_partitions": n,
        "required_partitions_by_size": left.target.required_by_size,
        "feasibility": {"target_partition_size_satisfied": left.target.satisfied, "reason": left.target.reason},
        "technical_columns": {"included": out.include_technical_columns, "partition_column": out.partition_column, "salt_column": out.salt_column, "heavy_key_column": out.heavy_key_column},
        "normal_key_assignment": mode,
        "normal_key_assignment_complete": complete,
        "normal_key_assignment_notes": notes,
        "normal_keys": [{"key": r["key"], "estimated_frequency": int(r["frequency"]), "partition_id": r["partition_id"]} for r in sorted(listed, key=lambda r: r["key"].encode())],
        "normal_keys_listed_all": normal_count == len(listed) and placed_all,
        "key_table": KEY_TABLE,
        "heavy_keys": [_heavy_document(h, salts[h["key"]]) for h in left.heavy],
        "recommended_downstream_plan": recommendation(config, joined),
        "join_plan": joined,
        "cost_estimate": {"estimated_rows_read": left.rows if rewrite else 0, "estimated_rows_written": left.rows if rewrite else 0, "estimated_bytes_read": size if rewrite else 0, "estimated_bytes_written": size if rewrite else 0, "rewrite_required": rewrite, "reason": reason},
        "skip_reason": None if rewrite else reason,
        "hash_function": "fnv1a64_seeded",
        "seed": p.seed,
    }
    salt_frame = _salt_frame(spark, salts)
    keys = others.unionByName(spark.createDataFrame([(h["key"], h["frequency"], None) for h in left.heavy], "key string, frequency long, partition_id int"))
    return Plan(document, statistics_document(config, left, right, loads.sizes, salts), n, p.seed, normal_frame, normal_count, salt_frame, left.heavy, keys)


def _salt_frame(spark: SparkSession, salts: dict[str, list[int]]) -> DataFrame:
    return spark.createDataFrame([(k, len(v), v) for k, v in salts.items()], "key string, salt_count int, partitions array<int>")


def stored_plan(spark: SparkSession, folder: str) -> Plan:
    """The plan of a prepared dataset, from its documents and its table of keys."""
    document, statistics = (read_json(spark, f"{folder}/{name}.json") for name in ("_partition_plan", "_stats"))
    keys = spark.read.parquet(f"{folder}/{document['key_table']}")
    normal = keys.where("partition_id is not null").select("key", "partition_id")
    salts = {h["key"]: [s["partition_id"] for s in h["salt_partitions"]] for h in document["heavy_keys"]}
    heavy = [{"key": h["key"], "parts": h["structured_key"]["parts"], "frequency": h["estimated_frequency"], "reasons": h["detection_reasons"], "salt_count": h["salt_count"]} for h in document["heavy_keys"]]
    return Plan(document, statistics, document["output_partitions"], document["seed"], normal, normal.count(), _salt_frame(spark, salts), heavy, keys)


def bound(target_rows: int, before: list[int], after: list[int] | None = None) -> dict[str, Any]:
    ok_before, most = max(before, default=0) <= target_rows, None if after is None else max(after, default=0)
    ok_after = None if most is None else most <= target_rows
    reason = None if ok_after or (ok_after is None and ok_before) else "before_max_partition_rows_exceed_target" if ok_after is None else "after_max_partition_rows_exceed_target"
    return {"target_partition_rows": target_rows, "estimated_before_max_partition_rows": max(before, default=0), "estimated_after_max_partition_rows": most, "target_rows_satisfied_before": ok_before, "target_rows_satisfied_after": ok_after, "reason": reason}


def _side_document(side: SideStatistics) -> dict[str, Any]:
    return {"total_rows": side.rows, "total_size_bytes": side.dataset_bytes or None, "estimated_size_mb": st.dataset_mb(side.dataset_bytes), "heavy_keys": [h["key"] for h in side.heavy], "heavy_key_values": list(map(_plan_key, side.heavy))}


def statistics_document(config: Config, left: SideStatistics, right: SideStatistics | None, planned: list[int], salts: dict[str, list[int]]) -> dict[str, Any]:
    s, r = config.storage, config.resources
    mb = st.dataset_mb(left.dataset_bytes)
    listed = {x["key"]: int(x["frequency"]) for x in left.frequencies.select("key", "frequency").orderBy(F.desc("frequency"), "key").limit(LISTED_KEYS).collect()}
    before = skew(left.before)
    heavy = [_heavy_document(h, salts.get(h["key"])) for h in left.heavy]
    names = set(left.candidates)
    candidates = [_heavy_document(h, None) for h in left.heavy if h["key"] in names]
    return {
        "version": VERSION,
        "input": {
            "total_rows": left.rows,
            **st.file_summary(left.files, s.min_file_size_mb, s.target_file_size_mb),
            "input_files": [{"path": f.path, "size_bytes": f.size_bytes} for f in left.files],
            "estimated_row_width_bytes": left.width,
            "distinct_keys": left.distinct_keys,
            "key_frequencies_exact": left.exact,
            "key_frequencies_truncated": not left.exact or len(listed) < left.distinct_keys,
            "key_table": KEY_TABLE,
            "normal_keys_materialized": left.exact,
            "mean_key_frequency": left.mean,
            "max_key_frequency": left.most,
            "key_frequencies": dict(sorted(listed.items())),
            "heavy_hitter_candidates": candidates,
            "heavy_hitters": heavy,
        },
        "heavy_hitter_detection": left.detection,
        "storage": {"target_file_size_mb": s.target_file_size_mb, "min_file_size_mb": s.min_file_size_mb, "target_file_size_bytes": mb_to_bytes(s.target_file_size_mb), "min_file_size_bytes": mb_to_bytes(s.min_file_size_mb)},
        "join": {"join_keys": list(config.join.join_keys), "left": _side_document(left), "right": _side_document(right) if right else None} if config.join and config.job.type == "join" else None,
        "before_skew": before,
        "after_skew": None,
        "skew": before,
        "partition_bound": bound(left.target.target_rows, left.before),
        "estimates": {"target_partitions": left.target.partitions, "before_partition_sizes": left.before, "after_partition_sizes": planned},
        "resources": {"configured_local_threads": r.local_threads, "local_threads_used": r.local_threads, "parallel_execution_enabled": r.local_threads > 1, "configured_memory_limit_mb": r.memory_limit_mb, "estimated_dataset_size_mb": mb, "in_memory_processing_used": False, "memory_limit_exceeded": mb is not None and mb > r.memory_limit_mb, "warnings": left.warnings},
        "timing": None,
    }


def set_after(statistics: dict[str, Any], sizes: list[int]) -> None:
    """Skew and bound of what was really written."""
    target_rows, before = statistics["partition_bound"]["target_partition_rows"], statistics["estimates"]["before_partition_sizes"]
    statistics["after_skew"] = statistics["skew"] = skew(sizes)
    statistics["estimates"]["after_partition_sizes"] = sizes
    statistics["partition_bound"] = bound(target_rows, before, sizes)


