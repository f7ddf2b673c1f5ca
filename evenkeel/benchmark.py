"""Timing workloads on a dataset and its prepared layout, with verification."""

from __future__ import annotations

import re
import subprocess
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import verify, workloads as wl
from .sources.files import data_path, join_right_side, read_manifest, read_plan
from .sources.sinks import write_reports

WORKLOADS = ("scan", "filter", "group_by", "join")


@dataclass
class Result:
    workload: str
    mode: str
    dataset_label: str
    dataset_path: str
    elapsed_seconds: float
    rows: int
    result_rows: int
    partitions: int
    spark_app_id: str
    correctness: dict[str, Any] = field(default_factory=dict)
    extra: dict[str, Any] = field(default_factory=dict)
    skipped: bool = False
    skip_reason: str | None = None


def timed(action: Callable[[], Any]) -> tuple[float, Any]:
    begun = time.perf_counter()
    out = action()
    return time.perf_counter() - begun, out


def java_major(text: str) -> int | None:
    m = re.search(r'version "(\d+)(?:\.(\d+))?', text)
    return None if not m else int(m[2]) if m[1] == "1" and m[2] else int(m[1])


def check_java(most: int = 21) -> None:
    said = subprocess.run(["java", "-version"], capture_output=True, text=True).stderr
    major = java_major(said)
    if major is not None and major > most:
        raise RuntimeError(f"Java {major} is newer than {most}, the last one supported here")


class Benchmark:
    """Workloads of one dataset in the modes baseline, physical_only and method_aware.

    Each mode runs exactly one action; checks run after the timing. `level`: none, basic (rows and
    result rows) or full (groups and checksums). The right side of joins is cached before any timing.
    """

    def __init__(self, spark: SparkSession, original: str, prepared: str | None, keys: Sequence[str], right: str | None = None, level: str = "basic", warmup: bool = False):
        if level not in verify.LEVELS:
            raise ValueError(f"unknown level: {level}")
        self.spark, self.keys, self.level, self.warmup = spark, list(keys), level, warmup
        self.original, self.prepared = original, prepared
        self.plan = read_plan(spark, prepared) if prepared else None
        self.manifest = read_manifest(spark, prepared) if prepared else None
        self.left = {"baseline": spark.read.parquet(original)}
        if prepared:
            self.left["physical_only"] = spark.read.parquet(data_path(prepared, self.manifest))
        self.right_path = right
        self._right: DataFrame | None = None

    @property
    def right(self) -> DataFrame:
        if self._right is None:
            source = self.spark.read.parquet(self.right_path) if self.right_path else self.left["baseline"]
            self._right = join_right_side(source, self.keys).cache()
            self._right.count()
        return self._right

    def _result(self, workload: str, mode: str, seconds: float, rows: int, result_rows: int, **extra: Any) -> Result:
        base = mode == "baseline"
        return Result(workload, mode, "original" if base else "prepared", self.original if base else str(self.prepared), seconds, rows, result_rows, self.left["baseline" if base else "physical_only"].rdd.getNumPartitions(), self.spark.sparkContext.applicationId, {}, extra)

    def _totals(self, workload: str, mode: str, frame: DataFrame, **extra: Any) -> Result:
        if self.warmup:
            self.left["baseline" if mode == "baseline" else "physical_only"].limit(1).count()
        seconds, row = timed(frame.first)
        d = row.asDict()
        sums = {k: v for k, v in d.items() if "_sum" in k}
        return self._result(workload, mode, seconds, int(d["rows"]), int(d.get("result_rows", d["rows"])), work_checksum=str(sum(int(v or 0) for v in sums.values())), work_columns=list(sums), **extra)

    def scan(self) -> list[Result]:
        return self._checked([self._totals("scan", m, wl.scan(f)) for m, f in self.left.items()])

    def filter(self) -> list[Result]:
        return self._checked([self._totals("filter", m, wl.filtered(f, self.keys[0]), predicate="pmod(xxhash64(key), 10) == 0") for m, f in self.left.items()])

    def group_by(self) -> list[Result]:
        out, groups = [], {}
        for mode, frame in self.left.items():
            groups[mode] = wl.group_by(wl.without_technical(frame), self.keys)
        if self.plan and not (self.manifest or {}).get("input_reused"):
            frame = self.left["physical_only"]
            keys, degraded = wl.partial_keys(frame.columns, self.plan, self.keys)
            groups["method_aware"] = wl.two_stage_group_by(frame, keys, self.keys, wl.numeric_work_columns(wl.without_technical(frame)))
        for mode, g in groups.items():
            more = {"partial_group_keys": keys, "degraded_reason": degraded} if mode == "method_aware" else {}
            out.append(self._totals("group_by", mode, wl.group_totals(g), **more))
        if self.level == "full":
            for r in out[1:]:
                r.correctness |= verify.verify_groups(groups["baseline"], groups[r.mode], self.keys)
        return self._checked(out)

    def join(self) -> list[Result]:
        out, joined = [], {}
        for mode, frame in self.left.items():
            joined[mode] = wl.inner_join(wl.without_technical(frame), self.right, self.keys)
        extra: dict[str, Any] = {}
        why = wl.skip_reason(self.plan, self.manifest, self.keys, self.left["physical_only"].columns) if self.prepared else "partition_plan_missing"
        if why is None:
            joined["method_aware"], extra = wl.method_aware_join(self.left["physical_only"], self.right, self.keys, self.plan)
        columns = wl.numeric_work_columns(joined["baseline"])
        for mode, j in joined.items():
            seconds, row = timed(wl.join_metrics(j, self.keys, columns).first)
            out.append(self._result("join", mode, seconds, int(row["rows"]), int(row["rows"]), distinct_keys=int(row["distinct_keys"]), checksum=str(row["checksum"]), **(extra if mode == "method_aware" else {})))
        for r in out[1:]:
            r.correctness["checksum_matches_baseline"] = r.extra["checksum"] == out[0].extra["checksum"]
            if self.level == "full":
                r.correctness |= verify.verify_join(joined["baseline"], joined[r.mode], self.keys)
        out = self._checked(out)
        if why is not None:
            out.append(skipped_result("join", "method_aware", str(self.prepared), why, self.spark.sparkContext.applicationId))
        return out

    def _checked(self, results: list[Result]) -> list[Result]:
        if self.level != "none":
            for r in results[1:]:
                r.correctness |= verify.basic(asdict(results[0]), asdict(r))
        return results

    def run(self, names: Sequence[str] = WORKLOADS) -> list[Result]:
        try:
            return [r for n in names for r in getattr(self, n)()]
        finally:
            if self._right is not None:
                self._right.unpersist()


def skipped_result(workload: str, mode: str, path: str, reason: str, app: str) -> Result:
    return Result(workload, mode, "prepared", path, 0.0, 0, 0, 0, app, {}, {}, True, reason)


def summary(results: Sequence[Result]) -> dict[str, Any]:
    """Times and correctness of the first workload that ran, and of method-aware group-by and join."""
    by = {w: {r.mode: r for r in results if r.workload == w} for w in WORKLOADS}
    active = next((by[w] for w in WORKLOADS if by[w]), {})
    seconds = lambda r: None if r is None or r.skipped else r.elapsed_seconds
    flag = lambda r, k: None if r is None or r.skipped else r.correctness.get(k)
    join = by["join"].get("method_aware")
    return {
        "spark_baseline_seconds": seconds(active.get("baseline")),
        "spark_physical_only_seconds": seconds(active.get("physical_only")),
        "spark_method_aware_seconds": seconds(active.get("method_aware")),
        "spark_method_aware_join_seconds": seconds(join),
        "group_by_exact_correctness": flag(by["group_by"].get("method_aware"), "exact_group_counts_match"),
        "join_checksum_correctness": flag(join, "checksum_matches_baseline"),
        "method_aware_join_applied": bool(join and not join.skipped),
        "method_aware_join_skipped": join.skipped if join else None,
        "method_aware_join_skip_reason": join.skip_reason if join else None,
        "method_aware_join_strategy": (join.extra or {}).get("strategy") if join else None,
    }


def report(spark: SparkSession, results: Sequence[Result], json_path: str, csv_path: str) -> None:
    write_reports(spark, [asdict(r) for r in results], summary(results), json_path, csv_path)


def run_tasks(spark: SparkSession, tasks: list[dict[str, Any]]) -> dict[str, list[Result]]:
    """A suite of tasks in one session; each is written to its reports if it names any."""
    out = {}
    for i, t in enumerate(tasks):
        names = WORKLOADS if t["workload"] == "all" else [t["workload"]]
        keys = t.get("key_columns") or [t.get("key_column", "user_id")]
        found = Benchmark(spark, t["original"], t["preprocessed"], keys, t.get("join_right"), t.get("correctness_level", "basic"), bool(t.get("warmup"))).run(names)
        if t.get("json_report") and t.get("csv_report"):
            report(spark, found, t["json_report"], t["csv_report"])
        out[t.get("name", str(i))] = found
    return out
