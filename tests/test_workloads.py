import json

import pytest
from pyspark.sql import functions as F

from evenkeel import benchmark, cli, experiments
from evenkeel.errors import CorrectnessMismatch
from evenkeel.generate import datasets as gen
from evenkeel.operators import analytics, verify, workloads as wl
from evenkeel.sources.files import read_json, read_tasks


def same(a, b):
    b = b.select(*a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# --- columns and gates ---------------------------------------------------------------------------------


def test_work_columns(spark):
    f = spark.createDataFrame([(1, 2, 3, "x", 4)], "payload_10 long, payload_2 long, value long, payload_3 string, other long")
    assert wl.numeric_work_columns(f) == ["value", "payload_2", "payload_10"]
    assert wl.grouped_work_columns(["payload_10_sum", "value_sum", "payload_2_sum", "x"]) == ["value_sum", "payload_2_sum", "payload_10_sum"]


PLAN = {"technical_columns": {"partition_column": "_rp_partition_id", "salt_column": "_rp_salt"}, "recommended_downstream_plan": {"job_type": "group_by", "partial_group_keys": ["_rp_partition_id", "_rp_salt", "user_id"]}}


def test_partial_keys():
    assert wl.partial_keys(["_rp_partition_id", "_rp_salt", "user_id"], PLAN, ["user_id"]) == (["_rp_partition_id", "_rp_salt", "user_id"], None)
    keys, why = wl.partial_keys(["_rp_partition_id", "user_id"], PLAN, ["user_id"])
    assert keys == ["_rp_partition_id", "user_id"] and why == "missing_salt_column"
    assert wl.partial_keys(["user_id", "rp_partition", "_ap_salt"], None, ["user_id"]) == (["rp_partition", "_ap_salt", "user_id"], None)
    assert wl.partial_keys(["user_id"], None, ["user_id"]) == (["user_id"], "missing_partition_column")


def test_skip_reasons():
    names = ["user_id", "_rp_salt"]
    join = {"job_type": "join", "technical_columns": {}, "recommended_downstream_plan": {"job_type": "join", "strategy": "salted_heavy_key_join", "join_keys": ["user_id"]}, "join_plan": {"shared_heavy_key_values": [{"parts": [{"column": "user_id"}]}]}}
    why = lambda plan, manifest=None, keys=("user_id",), columns=names: wl.skip_reason(plan, manifest, list(keys), columns)
    assert why(None) == "partition_plan_missing"
    assert why(join, {"input_reused": True}) == "input_reused"
    assert why(PLAN | {"job_type": "group_by"}) == "partition_plan_job_type_not_join"
    assert why(join, keys=("other",)) == "join_key_mismatch"
    assert why(join, columns=["user_id"]) == "missing_technical_columns"
    assert why(join | {"recommended_downstream_plan": join["recommended_downstream_plan"] | {"strategy": "magic"}}) == "unsupported_join_strategy"
    assert why(join | {"join_plan": {"shared_heavy_key_values": [{"parts": [{"column": "x"}]}]}}) == "invalid_structured_heavy_keys"
    assert why(join) is None


# --- results ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["string", "long", "date", "timestamp", "timestamp_ntz", "decimal(12,3)"])
def test_heavy_join_is_a_join(spark, kind):
    """Null keys, duplicate right keys, salts of all kinds of keys: the rows of a plain join."""
    value = {"string": "concat('k', id % 5)", "long": "id % 5", "date": "date_from_unix_date(cast(id % 5 as int))", "timestamp": "timestamp_seconds(id % 5)", "timestamp_ntz": "cast(timestamp_seconds(id % 5) as timestamp_ntz)"}.get(kind, "cast((id % 5) / 8 as decimal(12,3))")
    left = spark.range(60).selectExpr(f"if(id % 11 = 0, null, {value}) as k", "id as l", "if(id % 5 < 2, cast(id % 3 as int), null) as _rp_salt")
    right = spark.range(15).selectExpr(f"if(id = 14, null, {value}) as k", "id as r")
    heavy = spark.range(3).selectExpr(f"{value} as k")
    joined = wl.heavy_join(left, right, ["k"], heavy, heavy.withColumn("salt_count", F.lit(3)), "_rp_salt")
    assert same(joined.select("k", "l", "r"), left.join(right, "k").select("k", "l", "r"))
    isolated = wl.heavy_join(left.drop("_rp_salt"), right, ["k"], heavy, None, None)
    assert same(isolated.select("k", "l", "r"), left.join(right, "k").select("k", "l", "r"))
    added = wl.replicated_rows(right, ["k"], heavy.withColumn("salt_count", F.lit(3))).first()[0]
    assert added == 2 * right.join(heavy, "k").count()


def test_no_cross_join_in_the_plan(spark):
    left = spark.range(60).selectExpr("id % 5 as k", "cast(id % 3 as int) as _rp_salt")
    heavy = spark.range(3).selectExpr("id as k")
    plan = wl.heavy_join(left, spark.range(9).selectExpr("id as k"), ["k"], heavy, heavy.withColumn("salt_count", F.lit(3)), "_rp_salt")._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_two_stages_equal_one(spark):
    f = spark.range(500).selectExpr("if(id % 7 = 0, null, id % 7) as k", "id as value", "id % 4 as p", "if(id % 2 = 0, 1, null) as s")
    assert same(wl.group_by(f, ["k"], ["value"]), wl.two_stage_group_by(f, ["p", "s"], ["k"], ["value"]).withColumn("count", F.col("count").cast("long")))


def test_checks_see_differences(spark):
    a = spark.createDataFrame([("a", None), ("b", "x")], "x string, y string")
    b = spark.createDataFrame([(None, "a"), ("b", "x")], "x string, y string")
    assert not verify.checksums_equal(a, b, ["x"]) and verify.checksums_equal(a, a, ["x"])
    g = spark.createDataFrame([("a", 2), (None, 3)], "k string, count long")
    h = spark.createDataFrame([("a", 2), ("c", 1)], "k string, count long")
    assert sorted(map(tuple, verify.group_count_difference(g, h, ["k"]).collect()), key=str) == [("c", None, 1), (None, 3, None)]
    assert verify.verify_groups(g, g, ["k"])["exact_group_counts_match"]
    with pytest.raises(CorrectnessMismatch):
        verify.require({"x": False}, "test")


def test_heavy_predicate(spark):
    f = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    got = wl.heavy_predicate(f, ["k"], spark.createDataFrame([("a",), (None,)], "k string"))
    assert {r["k"]: r["is_heavy"] for r in got.collect()} == {"a": True, None: True, "b": False}


# --- end to end ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("scenario", ["single_heavy", "shared_heavy_join", "one_sided_heavy_join", "small_right_join", "normal_key_hash_skew"])
def test_suite_cases(spark, tmp_path, scenario):
    """Generate, prepare, run, verify: every mode equals the baseline, or the case raises."""
    got = experiments.run_case(spark, str(tmp_path), {"scenario": scenario, "rows": 4000, "keys": 300, "heavy_fraction": 0.5, "max_partitions": 8, "min_partitions": 8})
    want = {"shared_heavy_join": "salted_heavy_key_join", "one_sided_heavy_join": "heavy_key_isolation_join", "small_right_join": "broadcast_join"}.get(scenario)
    if want:
        assert got["method_aware_join_applied"] and got["method_aware_join_strategy"] == want and got["join_checksum_correctness"]
    else:
        assert got["group_by_exact_correctness"]
    assert got["after_max_mean_ratio"] <= got["before_max_mean_ratio"]


def test_benchmark_reports_and_tasks(spark, tmp_path):
    data, out = str(tmp_path / "d"), str(tmp_path / "p")
    gen.older_rows(gen.single_heavy(spark, 3000, 50), payloads=1).write.parquet(data)
    from evenkeel import pipeline

    pipeline.run(spark, experiments.scenario_config(data, out, "group_by", {"max_partitions": 4}))
    tasks = tmp_path / "tasks.json"
    tasks.write_text(json.dumps({"tasks": [{"name": "t", "original": data, "preprocessed": out, "workload": "all", "json_report": str(tmp_path / "r.json"), "csv_report": str(tmp_path / "r.csv")}]}))
    found = benchmark.run_tasks(spark, read_tasks(spark, str(tasks)))["t"]
    assert [(r.workload, r.mode) for r in found if r.skipped] == [("join", "method_aware")]
    assert all(v for r in found for v in r.correctness.values())
    assert {r.workload for r in found} == set(benchmark.WORKLOADS)
    report = read_json(spark, str(tmp_path / "r.json"))
    assert report["summary"]["method_aware_join_skip_reason"] == "partition_plan_job_type_not_join" and len(report["results"]) == len(found)
    assert (tmp_path / "r.csv").read_text().splitlines()[0].startswith("workload,mode,dataset_label")
    record = analytics.collect_results(spark, out)
    m = analytics.partition_metrics(record)
    assert m["after"]["max_partition_rows"] <= m["before"]["max_partition_rows"] and set(m["after"]) == set(analytics.PHASE_METRICS)
    with pytest.raises(ValueError):
        tasks.write_text("{}")
        read_tasks(spark, str(tasks))


def test_partition_metrics():
    m = analytics.partition_metrics({"rows": 100, "target_partition_rows": 35, "before_skew": {"max_partition_size": 70, "mean_partition_size": 25}, "after_skew": {"max_partition_size": 30, "mean_partition_size": 25}, "cost_estimate": {"estimated_bytes_written": 1000, "estimated_rows_written": 100}})
    assert m["before"]["largest_partition_share"] == 0.7 and m["after"]["skew_reduction_factor"] == pytest.approx(70 / 30)
    assert m["before"]["max_over_target_partition_rows"] == 2 and m["after"]["max_partition_bytes_estimated"] == 300
    none = analytics.partition_metrics({"rows": 0, "target_partition_rows": 1, "before_skew": {"max_partition_size": 0}, "after_skew": None, "cost_estimate": {"estimated_bytes_written": 0, "estimated_rows_written": 0}})
    assert set(none["after"]) == set(analytics.PHASE_METRICS) and none["after"]["skew_reduction_factor"] is None and none["before"]["max_partition_bytes_estimated"] is None
    assert analytics.add_optional(1, None) is None and analytics.first_number("", "x", "2") == 2


def test_research_and_quality(spark, tmp_path):
    mean = experiments.run_research(spark, str(tmp_path), [1500], ["heavy_key"], ["group_by"], spark_repetitions=2, trim=0.2, keys=50, max_partitions=4)
    assert {r["variant"] for r in mean} == {"baseline", "prepared"} and all(r["total_repetitions"] == 2 for r in mean)
    assert (tmp_path / "summary.csv").exists() and (tmp_path / "summary_raw.csv").exists()
    q = experiments.partition_quality(spark, str(tmp_path), 2000, [0, 0.5], 8)
    assert q[1]["rho_before"] > 3 and q[1]["rho_after"] < 1.6


def test_variants_and_series(spark, tmp_path):
    rows = [("a", "baseline", False), ("a", "physical_only", False), ("a", "method_aware", False), ("b", "baseline", False), ("b", "physical_only", False), ("b", "method_aware", True)]
    got = analytics.select_variants(spark.createDataFrame(rows, "w string, mode string, skipped boolean"), ["w"]).collect()
    assert {(r["w"], r["variant"]): r["mode"] for r in got} == {("a", "baseline"): "baseline", ("a", "prepared"): "method_aware", ("b", "baseline"): "baseline", ("b", "prepared"): "physical_only"}
    (tmp_path / "s.csv").write_text("a,b\n1.5,x\noops,y\n")
    assert [r["a"] for r in analytics.read_series(spark, str(tmp_path / "s.csv"), ["a"]).collect()] == [1.5, None]


# --- generators ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [1, 2, 7, 100, 999, 1000, 1024, 10_007])
def test_positions_are_a_bijection(spark, rows):
    got = gen._positions(spark, rows, 42).agg(F.count_distinct("at").alias("n"), F.max("at").alias("m")).first()
    assert (got["n"], got["m"]) == (rows, rows - 1)


def test_allot_and_parse():
    assert gen.allot(10, [1, 1, 1]) == [4, 3, 3] and sum(gen.allot(1001, [3, 2, 1, 0.5])) == 1001
    assert gen.parse_custom_heavy("a:0.5,b:0.25") == [("a", 0.5), ("b", 0.25)]
    for bad in ("a", "a:0.9,b:0.9", "a:0.1,a:0.1", "a:0"):
        with pytest.raises(ValueError):
            gen.parse_custom_heavy(bad)


def test_many_keys_by_ranges(spark):
    counts = {r["key"]: r["n"] for r in gen.zipf(spark, 30_000, 3000, 1.1).groupBy("key").agg(F.count("*").alias("n")).collect()}
    want = {f"key_{i:08d}": n for i, n in enumerate(gen.zipf_counts(30_000, 3000, 1.1)) if n}
    assert counts == want


def test_generator_command(spark, tmp_path, capsys):
    out = str(tmp_path / "g")
    a = cli.parser().parse_args(["generate", "--scenario", "multi_heavy", "--rows", "2000", "--keys", "20", "--payloads", "2", "--output", out])
    said = cli.generate(spark, a)[out]
    assert said["rows"] == 2000 and said["skew"]["top_keys"][0]["count"] == 200
    assert spark.read.parquet(out).columns == ["user_id", "row_id", "value", "payload_0", "payload_1"]
    assert read_json(spark, f"{out}.metadata.json")["rows"] == 2000
    rows = gen.build_rows(gen.uniform(spark, 50, 5), gen.Columns(keys=("region", "user_id"), categories=("c",), payload_bytes=100, timestamp=True))
    first = rows.orderBy("row_id").first()
    assert len(first["payload"]) == 100 and first["region"].startswith("region_") and str(first["event_time"]) == "2024-01-01 00:00:00"


def test_flags_become_settings():
    p = cli.parser()
    a = p.parse_args(["--master", "spark://h:7077", "--executor-memory", "8g", "--no-adaptive", "--broadcast-threshold", "-1", "--conf", "spark.x=a=b", "smoke", "--folder", "f", "--skews", "zipf"])
    assert cli.spark_conf(a) == {"spark.executor.memory": "8g", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.x": "a=b"}
    assert (a.master, a.skews, a.dataset_repetitions, a.spark_repetitions) == ("spark://h:7077", ["zipf"], 2, 3)
    a = p.parse_args(["bench", "--isolated", "--original", "o", "--preprocessed", "p", "--json-report", "j", "--csv-report", "c"])
    assert cli.spark_conf(a)["spark.sql.autoBroadcastJoinThreshold"] == "-1" and a.master is None
    assert p.parse_args(["suite", "--folder", "f", "--scenario", "zipf"]).heavy_fraction == analytics.MATRIX["heavy_fraction"]


def test_java_version():
    assert benchmark.java_major('openjdk version "17.0.2" 2022') == 17 and benchmark.java_major('java version "1.8.0_1"') == 8 and benchmark.java_major("?") is None
    benchmark.check_java(99)
