"""Command line: prepare, bench, tasks, generate, suite, research, smoke, quality."""

from __future__ import annotations

import argparse
import json
import sys

from . import benchmark, experiments, pipeline
from .config import Config
from .generate import datasets as gen
from .operators import analytics
from .session import ISOLATED, session
from .sources.files import read_tasks
from .sources.sinks import write_generated


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evenkeel", description=__doc__)
    p.add_argument("--master", help="a cluster's address; else spark-submit's, else this machine")
    p.add_argument("--cores", default="*", help="of this machine, where there is no other master")
    p.add_argument("--shuffle-partitions", type=int)
    p.add_argument("--driver-memory")
    p.add_argument("--executor-memory")
    p.add_argument("--broadcast-threshold", help="bytes up to which Spark broadcasts by itself; -1 for never")
    p.add_argument("--no-adaptive", action="store_true")
    p.add_argument("--no-vectorized-reader", action="store_true")
    p.add_argument("--reader-batch-size", type=int)
    p.add_argument("--max-partition-bytes")
    p.add_argument("--conf", action="append", default=[], metavar="KEY=VALUE")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("prepare", help="statistics, plan, rewrite or no-op")
    a.add_argument("--config", required=True)
    a.add_argument("--input")
    a.add_argument("--output")
    a = sub.add_parser("bench", help="workloads on a dataset and its prepared layout")
    a.add_argument("--original", required=True)
    a.add_argument("--preprocessed", required=True)
    a.add_argument("--key-column", action="append")
    a.add_argument("--join-right")
    a.add_argument("--workload", choices=[*benchmark.WORKLOADS, "all"], default="all")
    a.add_argument("--correctness-level", choices=["none", "basic", "full"], default="basic")
    a.add_argument("--isolated", action="store_true", help="without adaptive execution and automatic broadcasts")
    a.add_argument("--warmup", action="store_true")
    a.add_argument("--json-report", required=True)
    a.add_argument("--csv-report", required=True)
    a = sub.add_parser("tasks", help="a file of benchmark tasks in one session")
    a.add_argument("--tasks", required=True)
    a = sub.add_parser("generate", help="a skewed dataset")
    a.add_argument("--scenario", choices=gen.SCENARIOS, required=True)
    a.add_argument("--rows", type=int, required=True)
    a.add_argument("--keys", type=int, default=1000)
    a.add_argument("--heavy-fraction", type=float, default=0.5)
    a.add_argument("--heavy-keys", default="", help="KEY:FRACTION,...")
    a.add_argument("--exponent", type=float, default=1.2)
    a.add_argument("--seed", type=int, default=42)
    a.add_argument("--files", type=int, default=1)
    a.add_argument("--payloads", type=int, default=0)
    a.add_argument("--compression", default="snappy")
    a.add_argument("--output", required=True)
    for name in ("suite", "research", "smoke", "quality"):
        a = sub.add_parser(name)
        a.add_argument("--folder", required=True)
        a.add_argument("--rows", type=int, nargs="+", default=[100_000])
        if name != "quality":
            a.add_argument("--max-partitions", type=int, nargs="+" if name == "suite" else None)
            a.add_argument("--keys", type=int, default=1000)
    for name, (skews, datasets, runs) in {"research": (list(experiments.SKEWS), 1, 1), "smoke": (["uniform", "heavy_key", "zipf"], 2, 3)}.items():
        a = sub.choices[name]
        a.add_argument("--skews", nargs="+", choices=list(experiments.SKEWS), default=skews)
        a.add_argument("--workloads", nargs="+", choices=benchmark.WORKLOADS, default=list(benchmark.WORKLOADS))
        a.add_argument("--dataset-repetitions", type=int, default=datasets)
        a.add_argument("--spark-repetitions", type=int, default=runs)
        a.add_argument("--trim", type=float, default=0.0)
        a.add_argument("--heavy-fraction", type=float, default=0.5)
        a.add_argument("--payloads", type=int, default=8)
    a = sub.choices["suite"]
    for axis in ("scenario", "heavy-fraction", "target-partition-size-mb"):
        values = analytics.MATRIX[axis.replace("-", "_")]
        a.add_argument(f"--{axis}", type=type(values[0]), nargs="+", default=values)
    return p


def spark_conf(a: argparse.Namespace) -> dict[str, str]:
    """Spark settings of the flags; --conf wins over the others."""
    named = {
        "spark.driver.memory": a.driver_memory,
        "spark.executor.memory": a.executor_memory,
        "spark.sql.autoBroadcastJoinThreshold": a.broadcast_threshold,
        "spark.sql.adaptive.enabled": "false" if a.no_adaptive else None,
        "spark.sql.parquet.enableVectorizedReader": "false" if a.no_vectorized_reader else None,
        "spark.sql.parquet.columnarReaderBatchSize": a.reader_batch_size,
        "spark.sql.files.maxPartitionBytes": a.max_partition_bytes,
    }
    isolated = ISOLATED if getattr(a, "isolated", False) else {}
    return isolated | {k: str(v) for k, v in named.items() if v is not None} | dict(x.split("=", 1) for x in a.conf)


def research(spark, a) -> list:
    more = {} if a.max_partitions is None else {"max_partitions": a.max_partitions}
    return experiments.run_research(spark, a.folder, a.rows, a.skews, a.workloads, a.dataset_repetitions, a.spark_repetitions, a.trim, keys=a.keys, heavy_fraction=a.heavy_fraction, payloads=a.payloads, **more)


def generate(spark, a) -> dict:
    make = {
        "uniform": lambda: gen.uniform(spark, a.rows, a.keys, a.seed),
        "single_heavy": lambda: gen.single_heavy(spark, a.rows, a.keys, a.heavy_fraction, seed=a.seed),
        "multi_heavy": lambda: gen.multi_heavy(spark, a.rows, a.keys, total=a.heavy_fraction, seed=a.seed),
        "custom_heavy": lambda: gen.custom_heavy(spark, a.rows, a.keys, a.heavy_keys, seed=a.seed),
        "zipf": lambda: gen.zipf(spark, a.rows, a.keys, a.exponent, a.seed),
        "group_by": lambda: gen.group_by_scenario(spark, a.rows, a.keys, seed=a.seed),
        "join_pair": lambda: gen.join_pair(spark, a.rows, a.keys, a.heavy_fraction, seed=a.seed),
    }
    frames = make[a.scenario]()
    names = {a.output: frames} if not isinstance(frames, tuple) else {f"{a.output}/left": frames[0], f"{a.output}/right": frames[1]}
    out = {}
    for path, frame in names.items():
        rows = gen.build_rows(frame, gen.Columns(payloads=a.payloads), a.seed)
        skew = json.loads(gen.key_skew(frame, "key").toJSON().first())
        out[path] = {"scenario": a.scenario, "seed": a.seed, "skew": skew}
        out[path]["rows"] = write_generated(rows, path, a.files, a.compression, None, {"rows": skew["rows"], **out[path]})
    return out


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = session(a.master or (f"local[{a.cores}]" if a.cores != "*" else None), a.shuffle_partitions, spark_conf(a))
    if a.command == "prepare":
        got = pipeline.run(spark, Config.from_yaml_file(a.config).overridden(a.input, a.output))
        said: object = {"action": got.plan.document["action"], "path": got.path, "skew": got.statistics["skew"]}
    elif a.command == "bench":
        names = benchmark.WORKLOADS if a.workload == "all" else [a.workload]
        found = benchmark.Benchmark(spark, a.original, a.preprocessed, a.key_column or ["user_id"], a.join_right, a.correctness_level, a.warmup).run(names)
        benchmark.report(spark, found, a.json_report, a.csv_report)
        said = benchmark.summary(found)
    elif a.command == "tasks":
        said = {k: benchmark.summary(v) for k, v in benchmark.run_tasks(spark, read_tasks(spark, a.tasks)).items()}
    elif a.command == "generate":
        said = generate(spark, a)
    elif a.command == "suite":
        axes = {"rows": a.rows, "scenario": a.scenario, "heavy_fraction": a.heavy_fraction, "target_partition_size_mb": a.target_partition_size_mb}
        cases = analytics.matrix(**axes, **({"max_partitions": a.max_partitions} if a.max_partitions else {}))
        said = len(experiments.run_suite(spark, a.folder, [c | {"keys": a.keys} for c in cases]))
    elif a.command in ("research", "smoke"):
        said = research(spark, a)
    else:
        said = experiments.partition_quality(spark, a.folder, a.rows[0])
    print(json.dumps(said, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
