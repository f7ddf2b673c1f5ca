"""Experiment runners: suite, research matrix, quality sweep. One process, one session."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession, functions as F

from . import benchmark, pipeline
from .config import Config
from .generate import datasets as gen
from .operators import analytics, verify
from .sources.files import exists, read_manifest, read_plan
from .sources.sinks import write_experiment_summary

JOIN_SCENARIOS = ("small_right_join", "shared_heavy_join", "one_sided_heavy_join")


def scenario_config(data: str, out: str, workload: str, case: dict[str, Any], right: str | None = None) -> Config:
    raw: dict[str, Any] = {
        "dataset": {"input": data, "input_format": "parquet"},
        "output": {"path": out},
        "partitioning": {"key_columns": ["user_id"], "target_partition_size_mb": case.get("target_partition_size_mb", 64), "min_partitions": case.get("min_partitions", 1), "max_partitions": case.get("max_partitions", 16), "heavy_key_alpha": case.get("alpha", 2.0), "seed": case.get("seed", 42)},
        "job": {"type": workload},
    }
    if workload == "join":
        raw["join"] = {"right_input": right, "join_keys": ["user_id"], "broadcast_threshold_mb": 10 if case.get("scenario") == "small_right_join" else 0}
    return Config.from_dict(raw)


def can_skip(spark: SparkSession, data: str, out: str, config: Config) -> bool:
    """Whether an earlier output belongs to the same plan and can be used again."""
    if not exists(spark, out):
        return False
    plan, manifest = read_plan(spark, out), read_manifest(spark, out)
    if not plan or not manifest:
        return False
    p = config.partitioning
    return plan["key_columns"] == list(p.key_columns) and plan["job_type"] == config.job.type and plan["max_partitions"] == p.max_partitions and plan["seed"] == p.seed and (not manifest["input_reused"] or manifest["dataset_location"] == data)


def run_case(spark: SparkSession, folder: str, case: dict[str, Any], workload: str | None = None, reuse: bool = False) -> dict[str, Any]:
    """Generate, prepare, run, verify: one row of a suite's summary."""
    scenario = case["scenario"]
    workload = workload or ("join" if scenario in JOIN_SCENARIOS else "group_by")
    left, right = gen.suite_scenario(spark, scenario, case["rows"], case.get("keys", 1000), case.get("heavy_fraction", 0.5), case.get("max_partitions", 16), case.get("seed", 42))
    data, right_data, out = f"{folder}/data", f"{folder}/right", f"{folder}/prepared"
    if not (reuse and exists(spark, data)):
        gen_rows = gen.older_rows(left, case.get("seed", 42), case.get("payloads", 2))
        gen_rows.write.mode("overwrite").parquet(data)
        if workload == "join":
            side = right if right is not None else left
            side.select(F.col("key").alias("user_id"), "row_id").write.mode("overwrite").parquet(right_data)
    config = scenario_config(data, out, workload, case, right_data if workload == "join" else None)
    if not (reuse and can_skip(spark, data, out, config)):
        pipeline.run(spark, config)
    record = analytics.collect_results(spark, out)
    found = benchmark.Benchmark(spark, data, out, ["user_id"], right_data if workload == "join" else None, "full").run([workload])
    for r in found:
        verify.require(r.correctness, f"{scenario} {r.workload} {r.mode}")
    s = benchmark.summary(found)
    metrics = analytics.partition_metrics(record)
    return {**case, "workload": workload, **s, **{k: record[k] for k in ("action", "skip_reason", "heavy_keys", "salts", "recommended_strategy", "before_max_mean_ratio", "after_max_mean_ratio", "preprocessing_seconds")}, "metrics": metrics, "results": found}


def run_suite(spark: SparkSession, folder: str, cases: Sequence[dict[str, Any]]) -> list[dict[str, Any]]:
    rows = [run_case(spark, f"{folder}/case-{i:04d}", c) for i, c in enumerate(cases)]
    flat = [{k: v for k, v in r.items() if k not in ("metrics", "results")} for r in rows]
    write_experiment_summary(spark, folder, flat, flat)
    return rows


#: Research skews by suite scenario (fixed names).
SKEWS = {"uniform": "uniform_no_skew", "heavy_key": "single_heavy", "multi_heavy_key": "multi_heavy", "zipf": "zipf"}


def run_research(spark: SparkSession, folder: str, rows: Sequence[int], skews: Sequence[str] = tuple(SKEWS), workloads: Sequence[str] = benchmark.WORKLOADS, dataset_repetitions: int = 1, spark_repetitions: int = 1, trim: float = 0.0, **case: Any) -> list[dict[str, Any]]:
    """Raw rows a (skew, workload, rows, repetition, variant), and their trimmed means, written to folder."""
    raw: list[dict[str, Any]] = []
    for skew in skews:
        for n in rows:
            for d in range(dataset_repetitions):
                for w in workloads:
                    c = {"scenario": SKEWS[skew], "rows": n, "seed": 42 + d, **case}
                    for k in range(spark_repetitions):
                        got = run_case(spark, f"{folder}/{skew}-{n}-{d}-{w}", c, w, reuse=k > 0)
                        modes = {r.mode: r for r in got["results"] if not r.skipped}
                        best = modes.get("method_aware") or modes.get("physical_only")
                        for name, r, phase, pre in (("baseline", modes["baseline"], "before", 0.0), ("prepared", best, "after", got["preprocessing_seconds"] or 0.0)):
                            raw.append({"skew": skew, "workload": w, "rows": n, "variant": name, "dataset_repetition": d, "spark_repetition": k, "spark_mode": r.mode, "spark_time_seconds": r.elapsed_seconds, "preprocessing_seconds": pre, "total_with_preprocessing_seconds": r.elapsed_seconds + pre, "tau": got["metrics"][phase]["max_mean_ratio"]})
    kinds = "skew string, workload string, rows long, variant string, dataset_repetition int, spark_repetition int, spark_mode string, spark_time_seconds double, preprocessing_seconds double, total_with_preprocessing_seconds double, tau double"
    table = spark.createDataFrame([tuple(r.values()) for r in raw], kinds)
    mean = [r.asDict() for r in analytics.aggregate_summary(table, trim).orderBy(*analytics.GROUP).collect()]
    write_experiment_summary(spark, folder, raw, mean)
    return mean


def partition_quality(spark: SparkSession, folder: str, rows: int, fractions: Sequence[float] = (0, 0.05, *(i / 10 for i in range(1, 10))), partitions: int = 16) -> list[dict[str, Any]]:
    """Largest over mean partition before and after, by the share of one heavy key."""
    out = []
    for f in fractions:
        frame = gen.single_heavy(spark, rows, 1000, f) if f else gen.uniform(spark, rows, 1000)
        data = f"{folder}/quality-{int(f * 100):02d}"
        gen.older_rows(frame, payloads=0).write.mode("overwrite").parquet(data)
        config = scenario_config(data, f"{data}-prepared", "group_by", {"max_partitions": partitions, "min_partitions": partitions})
        got = pipeline.run(spark, config).statistics
        before = got["before_skew"]["max_mean_imbalance_ratio"]
        out.append({"heavy_fraction": f, "rho_before": before, "rho_after": (got["after_skew"] or {}).get("max_mean_imbalance_ratio", before)})
    return out
