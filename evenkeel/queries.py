"""The driver's queries: one for each operator, with the SQL that must give the same rows.

Types are made to match: counts are bigint, sums decimal(38,0) or rounded doubles.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .config import Config
from .functions.arithmetic import salt_count_column, salt_load_column, skew_frame
from .functions.hashing import fnv1a64_column, partition_id_column, stable_value
from .functions.keys import encode_key, keys_frame, structured_key
from .generate import datasets as gen
from .operators import analytics, statistics as st, verify, workloads as wl
from .operators.assign import assign, numbered, partitions_of_key
from .pipeline import plan_dataset, run as prepare
from .plans.planner import stored_plan
from .plans.targeting import target
from .session import scratch_folder, ship
from .sources.files import InputDataset, in_memory, join_right_side, list_files, read_dataset, read_manifest, read_plan, read_prepared
from .sources.sinks import manifest_frames
from .streaming.layout import append_batches

SEED = 42


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _dataset(spark: SparkSession, d: str, name: str, files: bool = False) -> InputDataset:
    path = f"{d}/{name}.parquet"
    return InputDataset(path, "memory", list_files(spark, path) if files else [], _t(spark, d, name))


def _config(key: str, job: str = "group_by", most: int = 16, alpha: float = 2.0, **more) -> Config:
    return Config.from_dict({"dataset": {"input": "x", "input_format": "parquet"}, "output": {"path": "x"}, "partitioning": {"key_columns": [key], "target_partition_size_mb": 64, "max_partitions": most, "heavy_key_alpha": alpha, "seed": SEED}, "job": {"type": job}, **more})


def _plan(spark, d, name, key, **more):
    """A plan with unknown row width: target rows are rows / partitions."""
    return plan_dataset(spark, _config(key, **more), _dataset(spark, d, name))[0]


# --- the queries ----------------------------------------------------------------------------------------


def scan_agg(spark, d):
    return wl.scan(_t(spark, d, "events"))


def filter_xxhash(spark, d):
    return wl.filtered(_t(spark, d, "events"), "user_id")


def filter_fnv(spark, d):
    return wl.scan(wl.key_sample_fnv(_t(spark, d, "events"), ["user_id"], SEED, 10))


def group_by_key(spark, d):
    return wl.group_by(_t(spark, d, "events"), ["user_id"])


def group_totals(spark, d):
    return wl.group_totals(wl.group_by(_t(spark, d, "events"), ["user_id"])).withColumn("rows", F.col("rows").cast("long"))


def two_stage_group_by(spark, d):
    events = _t(spark, d, "events")
    plan = _plan(spark, d, "events", "event_type")
    rows = assign(events, plan, ["event_type"])
    keys, _ = wl.partial_keys(rows.columns, plan.document, ["event_type"])
    return wl.two_stage_group_by(rows, keys, ["event_type"], ["value"]).withColumn("count", F.col("count").cast("long"))


def _orders_customer(spark, d):
    orders = _t(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return orders, _t(spark, d, "customer")


def _per_nation(joined):
    return joined.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("decimal(38,0)")).alias("cents"))


def inner_join(spark, d):
    o, c = _orders_customer(spark, d)
    return _per_nation(wl.inner_join(o, c, ["c_custkey"]))


def broadcast_join(spark, d):
    o, c = _orders_customer(spark, d)
    size = st.dataset_mb(sum(f.size_bytes for f in list_files(spark, f"{d}/customer.parquet")))
    return _per_nation(wl.broadcast_join(o, c, ["c_custkey"], size, 10))


def _heavy_join(spark, d, isolate=False):
    supplier = _t(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    lines = _t(spark, d, "lineitem").select("l_suppkey", "l_extendedprice")
    n = max(16, supplier.count() * 5 // 4)
    plan = _plan(spark, d, "lineitem", "l_suppkey", most=n)
    heavy, salts = wl.planned_salts(plan, lines, ["l_suppkey"])
    if isolate:  # heavy keys apart, without salts: rows need none of what assignment gives them
        joined = wl.heavy_join(lines, supplier, ["l_suppkey"], heavy, None, None)
    else:
        joined = wl.heavy_join(assign(lines, plan, ["l_suppkey"]), supplier, ["l_suppkey"], heavy, salts, "_rp_salt", sum(h["salt_count"] for h in plan.heavy))
    return joined.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")).alias("cents"))


def salted_join(spark, d):
    return _heavy_join(spark, d)


def isolation_join(spark, d):
    return _heavy_join(spark, d, True)


def join_metrics(spark, d):
    o, c = _orders_customer(spark, d)
    return wl.join_metrics(o.join(c, "c_custkey"), ["c_custkey"], []).select("rows", "distinct_keys")


def composite_join(spark, d):
    left = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    right = left.select("l_returnflag", "l_linestatus").dropDuplicates()
    keys = ["l_returnflag", "l_linestatus"]
    heavy = keys_frame(spark, [[{"column": "l_returnflag", "value_type": "utf8", "value": "N"}, {"column": "l_linestatus", "value_type": "utf8", "value": "O"}]], left.schema, keys)
    salted = left.withColumn("_rp_salt", F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), F.pmod(F.xxhash64("l_quantity"), F.lit(3)).cast("int")))
    joined = wl.heavy_join(salted, right, keys, heavy, heavy.withColumn("salt_count", F.lit(3)), "_rp_salt")
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def anti_join(spark, d):
    return _t(spark, d, "customer").join(_t(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def join_right(spark, d):
    return join_right_side(_t(spark, d, "orders"), ["o_custkey"]).select("o_custkey")


def union_by_name(spark, d):
    n, r = _t(spark, d, "nation").select("n_name", "n_regionkey"), _t(spark, d, "region").select(F.col("r_name").alias("n_name"))
    return n.unionByName(r, allowMissingColumns=True)


def group_difference(spark, d):
    e = _t(spark, d, "events")
    a = wl.group_by(e, ["event_type"], [])
    b = wl.group_by(e.where("value >= 20 and event_type <> 'click'"), ["event_type"], [])
    return verify.group_count_difference(a, b, ["event_type"])


def group_correctness(spark, d):
    """One row: whether the two-stage result equals the plain one, group by group and by checksum."""
    plain = wl.group_by(_t(spark, d, "events"), ["event_type"], ["value"])
    found = verify.verify_groups(plain, two_stage_group_by(spark, d), ["event_type"])
    return spark.createDataFrame([(found["group_count_diff"], found["exact_group_counts_match"], found["checksum_matches_baseline"])], "group_count_diff long, exact_group_counts_match boolean, checksum_matches_baseline boolean")


def row_checksum(spark, d):
    return _t(spark, d, "orders").agg(wl.checksum(["o_orderkey", "o_custkey"]).alias("checksum"), F.count("*").alias("rows"))


def encoded_keys(spark, d):
    o = _t(spark, d, "orders")
    return o.select("o_orderkey", encode_key(o, ["o_custkey", "o_orderstatus", "o_orderdate"]).alias("key"))


def structured_keys(spark, d):
    n = _t(spark, d, "nation")
    return n.select("n_nationkey", F.explode(structured_key(n, ["n_nationkey", "n_name"])).alias("p")).select("n_nationkey", "p.column", "p.value_type", "p.value")


def key_frequencies(spark, d):
    return st.key_frequencies(_t(spark, d, "lineitem"), ["l_orderkey"]).select("key", "frequency")


def frequency_summary(spark, d):
    s = st.frequency_summary_frame(st.key_frequencies(_t(spark, d, "lineitem"), ["l_orderkey"]))
    return s.withColumn("mean_key_frequency", F.round("mean_key_frequency", 6))


def heavy_candidates(spark, d):
    return st.heavy_candidates(st.key_frequencies(_t(spark, d, "lineitem"), ["l_orderkey"]), 2.0).select("key", "frequency")


def heavy_keys(spark, d):
    docs = _t(spark, d, "documents")
    found = st.heavy_keys(st.key_frequencies(docs, ["lang"]), 2.0, -(-docs.count() // 16))
    return found.select("key", "frequency", F.array_join("reasons", ",").alias("reasons"), "salt_count")


def planned_heavy_keys(spark, d):
    """The heavy keys of a whole plan: the same rows by way of the planner."""
    plan = _plan(spark, d, "documents", "lang")
    rows = [(h["key"], h["frequency"], ",".join(h["reasons"]), h["salt_count"]) for h in plan.heavy]
    return spark.createDataFrame(rows, "key string, frequency long, reasons string, salt_count long")


def salt_loads(spark, d):
    docs = _t(spark, d, "documents")
    f = st.key_frequencies(docs, ["lang"]).withColumn("salt_count", salt_count_column(F.col("frequency"), 50))
    each = f.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salt_count") - 1)))
    return each.select("key", "salt", salt_load_column(F.col("frequency"), F.col("salt_count"), F.col("salt")).alias("load"))


def assigned_salts(spark, d):
    """Rows of each salt after assignment: base and remainder."""
    rows = assign(_t(spark, d, "documents"), _plan(spark, d, "documents", "lang"), ["lang"])
    return rows.groupBy("lang", F.col("_rp_salt").cast("long").alias("salt")).agg(F.count("*").alias("n"))


def fnv_hash(spark, d):
    n = _t(spark, d, "nation")
    return n.select("n_nationkey", fnv1a64_column(encode_key(n, ["n_name"]), SEED).cast("string").alias("hash"), partition_id_column(encode_key(n, ["n_name"]), SEED, 16).cast("long").alias("partition"))


def fnv_partition_sizes(spark, d):
    return st.partition_sizes(st.key_frequencies(_t(spark, d, "lineitem"), ["l_suppkey"]), 16, SEED).select(F.col("partition_id").cast("long").alias("partition_id"), "rows")


def skew_statistics(spark, d):
    s = st.skew_statistics(fnv_partition_sizes(spark, d))
    return s.select(*(F.round(c, 6).alias(c) if c != "max_partition_size" else F.col(c) for c in s.columns))


def skew_of_keys(spark, d):
    sizes = _t(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("rows"))
    s = skew_frame(sizes)
    return s.select(*(F.round(c, 6).alias(c) if c != "max_partition_size" else F.col(c) for c in s.columns))


def lpt_order(spark, d):
    f = st.key_frequencies(_t(spark, d, "orders"), ["o_custkey"])
    return f.select("key", "frequency").orderBy(F.desc("frequency"), "key")


def load_aware_sizes(spark, d):
    """Rows of each partition under the plan."""
    rows = assign(_t(spark, d, "orders"), _plan(spark, d, "orders", "o_custkey"), ["o_custkey"])
    return rows.groupBy(F.col("_rp_partition_id").cast("long").alias("partition_id")).agg(F.count("*").alias("rows"))


def plan_balance(spark, d):
    """Balance before and after, of three skewed tables."""
    out = []
    for name, key in (("documents", "lang"), ("events", "event_type"), ("orders", "o_custkey")):
        p = _plan(spark, d, name, key)
        e = p.statistics["estimates"]
        out.append((name, key, p.document["action"], p.document["cost_estimate"]["reason"], len(p.heavy), sum(h["salt_count"] for h in p.heavy), max(e["before_partition_sizes"]), max(e["after_partition_sizes"])))
    return spark.createDataFrame(out, "dataset string, key string, action string, reason string, heavy_keys long, salts long, before_max long, after_max long")


def approximate_keys(spark, d):
    """Space-Saving with room for all keys: equal to exact counts."""
    ship(spark)
    return st.approximate_frequencies(_t(spark, d, "events"), ["event_type"], 1000)[0]


def approximate_heavy(spark, d):
    """Space-Saving with far fewer counters than keys: each key above rows / counters is there, and within the stated error."""
    ship(spark)
    rows = _t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 1, "hot").otherwise(F.col("l_orderkey").cast("string")).alias("k"))
    found, said = st.approximate_frequencies(rows, ["k"], 64)
    exact = st.key_frequencies(rows, ["k"]).select("key", F.col("frequency").alias("n"))
    sure = exact.where(F.col("n") > said["observed_total_rows"] / 64)
    return sure.join(found, "key", "left").select("key", "n", (F.col("frequency") - F.col("n")).between(0, said["max_error"]).alias("within_error"))


def row_partition_sizes(spark, d):
    """Partition sizes under plain hashing, from rows without counting keys."""
    sizes = st.hash_partition_sizes(_t(spark, d, "lineitem").select("l_suppkey"), ["l_suppkey"], 16, SEED)
    return sizes.select(F.col("partition_id").cast("long").alias("partition_id"), "rows")


def heavy_rows(spark, d):
    """Rows of heavy keys told from the rest, by a join with the plan's keys."""
    docs = _t(spark, d, "documents")
    heavy, _ = wl.planned_salts(_plan(spark, d, "documents", "lang"), docs, ["lang"])
    return wl.heavy_predicate(docs.select("lang"), ["lang"], heavy).groupBy("lang", "is_heavy").agg(F.count("*").alias("n"))


def join_payloads(spark, d):
    """The join workload's right side: one payload a key."""
    right = join_right_side(_t(spark, d, "orders"), ["o_custkey"])
    return right.agg(F.count("*").alias("rows"), F.count_distinct("o_custkey").alias("keys"), F.count_distinct("join_payload").alias("payloads"))


# Whole runs: a table is prepared as a layout in a scratch folder, and read back.


def _prepared(spark, d, name, columns, key, job="group_by", fmt="parquet", **more):
    """(folder of the layout, what was prepared) of some columns of a table, always rewritten."""
    ship(spark)
    folder = scratch_folder(spark, "layout")
    rows = _t(spark, d, name).select(*columns)
    if fmt == "csv":
        rows.write.option("header", True).csv(f"{folder}/input")
    else:
        rows.write.parquet(f"{folder}/input")
    config = Config.from_dict({"dataset": {"input": f"{folder}/input", "input_format": fmt}, "output": {"path": f"{folder}/out"}, "partitioning": {"key_columns": [key], "target_partition_size_mb": 64, "heavy_key_alpha": 2.0, "min_partitions": 16, "max_partitions": 16, "force_rewrite": True, "seed": SEED, **more.pop("partitioning", {})}, "job": {"type": job}, **more})
    return f"{folder}/out", prepare(spark, config)


def csv_source(spark, d):
    ship(spark)
    folder = scratch_folder(spark, "csv")
    _t(spark, d, "nation").select("n_nationkey", "n_name").write.option("header", True).csv(folder)
    return read_dataset(spark, folder, "csv").frame


def csv_layout(spark, d):
    """CSV in, Parquet layout out, with all columns."""
    out, _ = _prepared(spark, d, "supplier", ["s_suppkey", "s_nationkey"], "s_nationkey", fmt="csv")
    return read_prepared(spark, out).groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(F.col("s_suppkey").cast("long")).alias("keys"))


def layout_rows(spark, d):
    out, _ = _prepared(spark, d, "lineitem", ["l_suppkey", "l_quantity"], "l_suppkey")
    return read_prepared(spark, out).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def layout_manifest(spark, d):
    """Rows of each partition by the manifest of a layout placed by hash."""
    out, _ = _prepared(spark, d, "customer", ["c_custkey"], "c_custkey", partitioning={"normal_key_assignment": "hash"})
    parts = read_manifest(spark, out)["partitions"]
    return spark.createDataFrame([(p["partition_id"], p["row_count"]) for p in parts], "partition_id long, rows long")


def layout_files(spark, d):
    """Rows, by partition folder, of a layout whose heavy keys were salted: each row is in the partition that it was given."""
    out, _ = _prepared(spark, d, "documents", ["doc_id", "lang"], "lang")
    _, each = manifest_frames(spark, out, 16)
    rows = read_prepared(spark, out)
    return each.agg(F.sum("row_count").alias("rows"), F.count("*").alias("partitions")).crossJoin(rows.agg(F.count_if(F.col("rp_partition") != F.col("_rp_partition_id")).alias("astray")))  # one row each


def stored_keys(spark, d):
    """The table of all keys beside a layout's documents, read back as a plan."""
    out, _ = _prepared(spark, d, "orders", ["o_custkey"], "o_custkey")
    return stored_plan(spark, out).keys.select("key", "frequency")


def method_aware_join(spark, d):
    """The join that a stored plan recommends, on its layout."""
    folder = scratch_folder(spark, "right")
    _t(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").write.parquet(folder)
    out, _ = _prepared(spark, d, "lineitem", ["l_suppkey", "l_extendedprice"], "l_suppkey", "join", join={"right_input": folder, "join_keys": ["l_suppkey"], "broadcast_threshold_mb": 0, "right_side_mode": "shuffle"}, partitioning={"heavy_key_alpha": 1.0})
    plan, left = read_plan(spark, out), read_prepared(spark, out)
    assert wl.skip_reason(plan, read_manifest(spark, out), ["l_suppkey"], left.columns) is None
    joined, _ = wl.method_aware_join(left, spark.read.parquet(folder), ["l_suppkey"], plan)
    return joined.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("decimal(38,0)")).alias("cents"))


def skip_reasons(spark, d):
    """Why the join of a layout does not run by its plan: for other keys, another job, no plan."""
    out, _ = _prepared(spark, d, "nation", ["n_nationkey", "n_regionkey"], "n_regionkey")
    plan, names = read_plan(spark, out), read_prepared(spark, out).columns
    as_join = plan | {"job_type": "join", "recommended_downstream_plan": plan["recommended_downstream_plan"] | {"job_type": "join", "join_keys": ["n_regionkey"]}}
    cases = [("no plan", None, None), ("reused", plan, {"input_reused": True}), ("other job", plan, None), ("other keys", as_join | {"recommended_downstream_plan": as_join["recommended_downstream_plan"] | {"join_keys": ["x"]}}, None), ("strategy", as_join, None)]
    return spark.createDataFrame([(n, wl.skip_reason(p, m, ["n_regionkey"], names)) for n, p, m in cases], "case string, reason string")


def appended_layout(spark, d):
    """A stream of orders appended to a layout with its stored plan."""
    out, _ = _prepared(spark, d, "orders", ["o_custkey", "o_orderkey"], "o_custkey")
    source = out.rsplit("/", 1)[0] + "/input"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    more = scratch_folder(spark, "appended")
    append_batches(stream, stored_plan(spark, out), ["o_custkey"], more, scratch_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(more).groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("rp_partition").alias("partitions")).select("o_custkey", "n", (F.col("partitions") >= 1).alias("placed"))

def layout_record(spark, d):
    """One flat record of a layout's three documents: rows, keys, balance before, and what was written."""
    out, _ = _prepared(spark, d, "customer", ["c_custkey"], "c_custkey", partitioning={"normal_key_assignment": "hash"})
    r = analytics.collect_results(spark, out)
    w = r["written_partitions"]
    row = (r["rows"], r["distinct_keys"], r["output_partitions"], round(r["before_max_mean_ratio"], 6), r["skew_reduction_ratio"], w["max"], w["mean"], round(w["max_mean_ratio"], 6))
    return spark.createDataFrame([row], "rows long, distinct_keys long, output_partitions long, before_ratio double, reduction double, written_max long, written_mean double, written_ratio double")


def join_plan(spark, d):
    """Heavy keys of both sides of a planned join, and the strategy that they lead to."""
    events = _t(spark, d, "events").select("event_type", "value")
    config = _config("event_type", "join", join={"right_input": "x", "join_keys": ["event_type"], "right_side_mode": "shuffle", "broadcast_threshold_mb": 0})
    left, right = (InputDataset("x", "memory", [], f) for f in (events, events.where("event_type <> 'click'")))
    found = plan_dataset(spark, config, left, right)[0].document["join_plan"]
    names = [("left", "left_heavy_keys"), ("right", "right_heavy_keys"), ("shared", "shared_heavy_keys")]
    return spark.createDataFrame([(side, k, found["recommended_strategy"]) for side, n in names for k in found[n]], "side string, key string, strategy string")


def rewrite_reasons(spark, d):
    """Whether a layout is rewritten, and why, by job and force."""
    out = []
    for job, force in (("group_by", False), ("scan", False), ("filter", False), ("scan", True)):
        config = _config("lang", job)
        config = dataclasses.replace(config, partitioning=dataclasses.replace(config.partitioning, force_rewrite=force))
        plan = plan_dataset(spark, config, _dataset(spark, d, "documents"))[0]
        out.append((job, force, plan.rewrite, plan.document["cost_estimate"]["reason"]))
    return spark.createDataFrame(out, "job string, forced boolean, rewrite boolean, reason string")


def partition_targets(spark, d):
    """Partitions and rows of each for several tables and sizes, from row counts and a stated row width."""
    out = []
    for name in ("customer", "orders", "lineitem"):
        rows = _t(spark, d, name).count()
        for width in (10, 400):
            t = target(rows, width, 1, 2, 16)
            out.append((name, width, t.partitions, t.target_rows, t.required_by_size, t.satisfied))
    return spark.createDataFrame(out, "dataset string, width long, partitions long, target_rows long, required_by_size long, satisfied boolean")


def typed_keys(spark, d):
    """Structured keys turned back into typed columns: date and time, text, number."""
    o = _t(spark, d, "orders").select(F.date_trunc("year", "o_orderdate").alias("year"), "o_orderstatus", (F.year("o_orderdate") * 1000).cast("long").alias("n")).distinct()
    names = ["year", "o_orderstatus", "n"]
    parts = [[p.asDict() for p in r["k"]] for r in o.select(structured_key(o, names).alias("k")).collect()]  # a few a year
    return keys_frame(spark, parts, o.schema, names)


def first_heavy_keys(spark, d):
    """The first five heavy keys of a plan, in key order, as a list to show."""
    return planned_heavy_keys(spark, d).select("key", "frequency", "salt_count").orderBy("key").limit(5)


def key_lookup(spark, d):
    """Partitions to read for each language: the salts' for heavy keys, one for the rest."""
    out, _ = _prepared(spark, d, "documents", ["doc_id", "lang"], "lang")
    plan, rows = stored_plan(spark, out), read_prepared(spark, out)
    keys = rows.select("lang", encode_key(rows, ["lang"]).alias("key")).distinct().collect()  # languages
    pairs = [(r["lang"], p) for r in keys for p in partitions_of_key(plan.document, r["key"], plan.keys)]
    looked = spark.createDataFrame(pairs, "l string, p long")
    held = rows.join(F.broadcast(looked), F.col("lang").eqNullSafe(F.col("l")) & (F.col("rp_partition") == F.col("p")))
    return held.groupBy("lang").agg(F.count("*").alias("n"))


def result_variants(spark, d):
    """Runs told into baseline and prepared ones; skipped runs do not count."""
    o = _t(spark, d, "orders")
    mode = F.element_at(F.array(F.lit("baseline"), F.lit("physical_only"), F.lit("method_aware")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    runs = o.select("o_orderkey", "o_orderpriority", "o_orderstatus", mode.alias("mode"), (F.col("o_orderstatus") == "P").alias("skipped"))
    return analytics.select_variants(runs, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "variant")


def memory_source(spark, d):
    rows = [(i, None if i == 3 else f"k{i % 4}") for i in range(20)]
    return st.key_frequencies(in_memory(spark, rows, "id long, k string").frame, ["k"]).select("key", "frequency")


def file_summary(spark, d):
    return st.observed_files(_t(spark, d, "lineitem")).agg(F.count("*").alias("files"), F.sum("rows").alias("rows"))


def numbered_rows(spark, d):
    """Occurrence numbers by prefix sums over blocks, against a plain window."""
    e = _t(spark, d, "events").select("event_type", F.col("event_id").alias("at"), F.lit("f").alias("file"))
    return numbered(e, ["event_type"], "file", "at", "i").select("event_type", F.col("at").alias("event_id"), F.col("i").cast("long").alias("i"))


def rolling_hash(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", stable_value(F.col("c_mktsegment"), F.col("c_custkey"), SEED).alias("v"))


def top_keys(spark, d):
    return gen.top_keys(_t(spark, d, "lineitem"), "l_partkey")


def key_skew(spark, d):
    s = gen.key_skew(_t(spark, d, "lineitem"), "l_suppkey")
    return s.select("rows", "distinct_keys", "max_frequency", F.round("mean_frequency", 6).alias("mean_frequency"), F.round("max_mean_ratio", 6).alias("max_mean_ratio"), F.round("coefficient_of_variation", 6).alias("coefficient_of_variation"))


def _counts(frame):
    return frame.groupBy("key").agg(F.count("*").alias("n"))


def generate_uniform(spark, d):
    return _counts(gen.uniform(spark, 10_003, 100))


def generate_single_heavy(spark, d):
    return _counts(gen.single_heavy(spark, 10_000, 50, 0.5))


def generate_multi_heavy(spark, d):
    return _counts(gen.multi_heavy(spark, 10_000, 40, 5, 0.6))


def generate_custom_heavy(spark, d):
    return _counts(gen.custom_heavy(spark, 10_000, 30, "a:0.4,b:0.2"))


def generate_zipf(spark, d):
    return _counts(gen.zipf(spark, 20_000, 100, 1.2))


def generate_join_pair(spark, d):
    left, right = gen.join_pair(spark, 10_000, 40, 0.5)
    both = _counts(left).withColumnRenamed("n", "left_n").join(_counts(right).withColumnRenamed("n", "right_n"), "key")
    return both


def generate_rows(spark, d):
    rows = gen.build_rows(gen.uniform(spark, 1000, 10), gen.Columns(categories=("region",), payloads=2, timestamp=True))
    return rows.agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("keys"), F.max("event_time").cast("string").alias("last"), F.count_if(F.col("value").between(0, 999_999)).alias("in_range"))


def generate_group_by(spark, d):
    return _counts(gen.group_by_scenario(spark, 10_000, 50, "single_heavy", fraction=0.3))


def generate_right_sides(spark, d):
    """Rows, distinct keys and rows of the heavy key, of each right side of the join scenarios."""
    sides = [gen.join_right_side(spark, n, 6000).withColumn("scenario", F.lit(n)) for n in ("small", "shared", "one_sided")]
    both = sides[0].unionByName(sides[1]).unionByName(sides[2])
    return both.groupBy("scenario").agg(F.count("*").alias("rows"), F.count_distinct("key").alias("keys"), F.count_if(F.col("key") == "heavy_00000000").alias("heavy"))


def dimension(spark, d):
    return gen.dimension(_t(spark, d, "customer").select("c_mktsegment"), "c_mktsegment")


def collision_keys(spark, d):
    return gen.collision_keys(spark, 50, 16)


def trimmed_mean(spark, d):
    rows = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").alias("value"))
    # ties in value are equal values, so which of them is trimmed does not matter
    return analytics.trimmed_mean(rows, ["l_returnflag", "l_linestatus"], "value", 0.2).withColumn("value", F.round("value", 3))


def _series(spark, d):
    e = _t(spark, d, "events").groupBy(F.col("event_type").alias("workload"), F.hour("ts").cast("long").alias("rows")).agg(F.round(F.max("value"), 4).alias("spark_time_seconds"))
    return e.withColumns({"skew": F.lit("s"), "variant": F.lit("v")})


def interpolation(spark, d):
    return analytics.expected_times(_series(spark, d)).select("workload", "rows", F.round("expected", 5).alias("expected"))


def smoothing(spark, d):
    return analytics.smoothed_copy(_series(spark, d)).select("workload", "rows", F.round("spark_time_seconds", 5).alias("spark_time_seconds"), "spark_time_seconds_raw", "time_smoothed")


def report_pivot(spark, d):
    o = _t(spark, d, "orders")
    mode = F.element_at(F.array(F.lit("baseline"), F.lit("physical_only"), F.lit("method_aware")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = o.groupBy("o_orderstatus", mode.alias("mode")).agg(F.round(F.max("o_totalprice"), 2).alias("elapsed_seconds")).withColumn("skipped", F.col("mode") == "method_aware")
    return analytics.report_pivot(rows, ["o_orderstatus"])


def matrix(spark, d):
    return spark.createDataFrame([tuple(c.values()) for c in analytics.matrix()], "scenario string, rows long, heavy_fraction double, max_partitions long, target_partition_size_mb long")


def aggregated_summary(spark, d):
    o = _t(spark, d, "orders").where("o_totalprice is not null")
    raw = o.select(
        F.col("o_orderstatus").alias("skew"), F.lit("w").alias("workload"), F.lit(1).cast("long").alias("rows"), F.col("o_orderpriority").alias("variant"),
        (F.col("o_orderkey") % 5).cast("int").alias("dataset_repetition"), F.col("o_orderkey").alias("spark_repetition"), F.lit("m").alias("spark_mode"),
        F.col("o_totalprice").alias("spark_time_seconds"), F.lit(1.0).alias("preprocessing_seconds"), (F.col("o_totalprice") + 1).alias("total_with_preprocessing_seconds"), (F.col("o_custkey") * 1.0).alias("tau"),
    )
    s = analytics.aggregate_summary(raw, 0.1)
    return s.select("skew", "variant", "dataset_repetitions", "total_repetitions", F.round("spark_time_seconds", 3).alias("spark_time_seconds"), F.round("tau", 4).alias("tau"), "tau_min", "tau_max")


def skew_aware_join(spark, d):
    """The flagship: encode, count, find heavy keys, plan, salt in memory, join, aggregate."""
    return salted_join(spark, d)


# --- SQL --------------------------------------------------------------------------------------------------

_JOIN = "SELECT c_nationkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS DECIMAL(38,0))) AS cents FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
_SUPPLIER = "SELECT s_nationkey, count(*) AS n, sum(CAST(round(l_extendedprice * 100) AS DECIMAL(38,0))) AS cents FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"
_KEY = "'{n}:{c}#int64:' || {c}"
_ORDER_KEY = "'10:l_orderkey#int64:' || l_orderkey"
_LANG_KEY = "'4:lang#' || CASE WHEN lang IS NULL THEN 'null' ELSE 'utf8:' || strlen(lang) || ':' || lang END"
_HEAVY = f"""
WITH f AS (SELECT {_LANG_KEY} AS key, count(*) AS frequency FROM documents GROUP BY 1),
     t AS (SELECT CAST(ceil(sum(frequency) / 16) AS BIGINT) AS t, avg(frequency) AS m FROM f)
SELECT key, frequency, CASE WHEN frequency > 2 * m THEN 'above_mean_threshold,' ELSE '' END || 'exceeds_target_partition_rows' AS reasons,
       CAST((frequency + t - 1) // t AS BIGINT) AS salt_count
FROM f, t WHERE frequency > t
"""


def _fnv(keys: str, n: int) -> str:
    """CTE h(key, hash): seeded FNV-1a of keys(key), byte by byte."""
    return f"""
RECURSIVE k AS ({keys}),
b AS (SELECT key, hex(encode(key)) AS x FROM k),
r(key, x, i, h) AS (
  SELECT key, x, 0, CAST({0xCBF29CE484222325 ^ SEED} AS UHUGEINT) FROM b
  UNION ALL
  SELECT key, x, i + 1, ((CAST(xor(CAST(h AS UBIGINT), CAST(('0x' || substr(x, 2 * i + 1, 2)) AS UBIGINT)) AS UHUGEINT) * CAST(1099511628211 AS UHUGEINT)) % CAST(18446744073709551616 AS UHUGEINT))
  FROM r WHERE i < length(x) / 2),
h AS (SELECT key, h AS hash, CAST(h % {n} AS BIGINT) AS partition FROM r WHERE i = length(x) / 2)
"""


_SIZES = _fnv("SELECT DISTINCT '9:l_suppkey#int64:' || l_suppkey AS key FROM lineitem", 16) + """,
s AS (SELECT p.i AS partition_id, CAST(coalesce(sum(f.n), 0) AS BIGINT) AS rows
      FROM (SELECT range AS i FROM range(16)) p
      LEFT JOIN (SELECT partition, n FROM h JOIN (SELECT '9:l_suppkey#int64:' || l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1) USING (key)) f ON f.partition = p.i GROUP BY 1)
"""


def _skew_sql(source: str) -> str:
    return f"""l AS (SELECT list(rows ORDER BY rows) AS v, max(rows) AS mx, avg(rows) AS mean, var_pop(rows) AS var, stddev_pop(rows) AS sd, count(*) AS n FROM {source})
SELECT CAST(mx AS BIGINT) AS max_partition_size, round(mean, 6) AS mean_partition_size,
  CAST(v[CAST(ceil((n - 1) * 0.5) AS BIGINT) + 1] AS DOUBLE) AS median_partition_size, CAST(v[CAST(ceil((n - 1) * 0.95) AS BIGINT) + 1] AS DOUBLE) AS p95_partition_size,
  round(var, 6) AS partition_size_variance, round(sd / mean, 6) AS coefficient_of_variation, round(mx / mean, 6) AS max_mean_imbalance_ratio FROM l"""


_SERIES = "SELECT event_type AS workload, CAST(hour(ts) AS BIGINT) AS rows, round(max(value), 4) AS t FROM events GROUP BY 1, 2"
_EXPECTED = f"""
WITH s AS ({_SERIES}), w AS (SELECT *, lag(rows) OVER o AS r1, lag(t) OVER o AS t1, lag(rows, 2) OVER o AS r2, lag(t, 2) OVER o AS t2, lead(rows) OVER o AS r3, lead(t) OVER o AS t3,
  count(*) OVER (PARTITION BY workload) AS n FROM s WINDOW o AS (PARTITION BY workload ORDER BY rows)),
e AS (SELECT *, CASE WHEN n < 3 THEN NULL WHEN r3 IS NULL THEN CASE WHEN t1 >= t2 THEN t2 + (t1 - t2) * (rows - r2) / (r1 - r2) END ELSE t1 + (t3 - t1) * (rows - r1) / (r3 - r1) END AS expected FROM w)
"""
_ALLOT_ZIPF = """
WITH w AS (SELECT i, 20000 * pow(i + 1, -1.2) / (SELECT sum(pow(range + 1, -1.2)) FROM range(100)) AS x FROM (SELECT range AS i FROM range(100))),
f AS (SELECT i, CAST(floor(x) AS BIGINT) AS n, row_number() OVER (ORDER BY x - floor(x) DESC, i) AS r FROM w)
SELECT 'key_' || lpad(CAST(i AS VARCHAR), 8, '0') AS key, n + CASE WHEN r <= 20000 - (SELECT sum(n) FROM f) THEN 1 ELSE 0 END AS n FROM f
"""


def _tail(rows: int, keys: int, heavy: str) -> str:
    return f"{heavy} SELECT 'key_' || lpad(CAST(range AS VARCHAR), 8, '0') AS key, {rows} // {keys} + CASE WHEN range < {rows} % {keys} THEN 1 ELSE 0 END AS n FROM range({keys})"


ORACLE = {
    "scan_agg": "SELECT count(*) AS rows, coalesce(sum(CAST(value AS DECIMAL(38,0))), 0) AS value_sum FROM events",
    "filter_fnv": "WITH " + _fnv("SELECT DISTINCT '7:user_id#int64:' || user_id AS key FROM events", 10) + "SELECT count(*) AS rows, coalesce(sum(CAST(value AS DECIMAL(38,0))), 0) AS value_sum FROM events JOIN h ON h.key = '7:user_id#int64:' || user_id WHERE partition = 0",
    "group_by_key": "SELECT user_id, count(*) AS count, coalesce(sum(CAST(value AS DECIMAL(38,0))), 0) AS value_sum FROM events GROUP BY 1",
    "group_totals": "SELECT count(*) AS result_rows, CAST(sum(c) AS BIGINT) AS rows, max(c) AS max_group_count, sum(s) AS value_sum_total FROM (SELECT count(*) AS c, sum(CAST(value AS DECIMAL(38,0))) AS s FROM events GROUP BY user_id)",
    "two_stage_group_by": "SELECT event_type, count(*) AS count, sum(CAST(value AS DECIMAL(38,0))) AS value_sum FROM events GROUP BY 1",
    "inner_join": _JOIN,
    "broadcast_join": _JOIN,
    "salted_join": _SUPPLIER,
    "isolation_join": _SUPPLIER,
    "skew_aware_join": _SUPPLIER,
    "join_metrics": "SELECT count(*) AS rows, count(DISTINCT o_custkey) AS distinct_keys FROM orders JOIN customer ON o_custkey = c_custkey",
    "composite_join": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "join_right": "SELECT DISTINCT o_custkey FROM orders",
    "union_by_name": "SELECT n_name, n_regionkey FROM nation UNION ALL SELECT r_name, NULL FROM region",
    "group_difference": "SELECT coalesce(a.event_type, b.event_type) AS event_type, count_a, count_b FROM (SELECT event_type, count(*) AS count_a FROM events GROUP BY 1) a FULL JOIN (SELECT event_type, count(*) AS count_b FROM events WHERE value >= 20 AND event_type <> 'click' GROUP BY 1) b ON a.event_type IS NOT DISTINCT FROM b.event_type WHERE coalesce(count_a, 0) <> coalesce(count_b, 0)",
    "group_correctness": "SELECT CAST(0 AS BIGINT) AS group_count_diff, true AS exact_group_counts_match, true AS checksum_matches_baseline",
    "encoded_keys": "SELECT o_orderkey, '9:o_custkey#int64:' || o_custkey || '|13:o_orderstatus#utf8:' || strlen(o_orderstatus) || ':' || o_orderstatus || '|11:o_orderdate#timestamp_micros:' || epoch_us(o_orderdate) AS key FROM orders",
    "structured_keys": "SELECT n_nationkey, 'n_nationkey' AS \"column\", 'int64' AS value_type, CAST(n_nationkey AS VARCHAR) AS value FROM nation UNION ALL SELECT n_nationkey, 'n_name', 'utf8', n_name FROM nation",
    "key_frequencies": f"SELECT {_ORDER_KEY} AS key, count(*) AS frequency FROM lineitem GROUP BY 1",
    "frequency_summary": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, round(sum(n) / count(*), 6) AS mean_key_frequency, max(n) AS max_key_frequency FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "heavy_candidates": f"WITH f AS (SELECT {_ORDER_KEY} AS key, count(*) AS frequency FROM lineitem GROUP BY 1) SELECT key, frequency FROM f WHERE frequency > 2 * (SELECT avg(frequency) FROM f)",
    "heavy_keys": _HEAVY,
    "planned_heavy_keys": _HEAVY,
    "salt_loads": f"WITH f AS (SELECT {_LANG_KEY} AS key, count(*) AS n FROM documents GROUP BY 1), s AS (SELECT *, greatest(1, (n + 49) // 50) AS c FROM f) SELECT key, salt, CAST(n // c + CASE WHEN salt < n % c THEN 1 ELSE 0 END AS BIGINT) AS load FROM s, LATERAL (SELECT unnest(range(c)) AS salt)",
    "assigned_salts": f"WITH x AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT CAST(ceil(sum(n) / 16) AS BIGINT) AS t FROM x), s AS (SELECT lang, n, (n + t - 1) // t AS c FROM x, t WHERE n > t) SELECT lang, salt, CAST(n // c + CASE WHEN salt < n % c THEN 1 ELSE 0 END AS BIGINT) AS n FROM s, LATERAL (SELECT unnest(range(c)) AS salt)",
    "fnv_hash": "WITH " + _fnv("SELECT '6:n_name#utf8:' || strlen(n_name) || ':' || n_name AS key FROM nation", 16) + "SELECT n_nationkey, CAST(hash AS VARCHAR) AS hash, partition FROM nation JOIN h ON h.key = '6:n_name#utf8:' || strlen(n_name) || ':' || n_name",
    "fnv_partition_sizes": "WITH " + _SIZES + "SELECT partition_id, rows FROM s",
    "skew_statistics": "WITH " + _SIZES + ", " + _skew_sql("s"),
    "skew_of_keys": "WITH u AS (SELECT count(*) AS rows FROM events GROUP BY user_id), " + _skew_sql("u"),
    "lpt_order": "SELECT '9:o_custkey#int64:' || o_custkey AS key, count(*) AS frequency FROM orders GROUP BY 1 ORDER BY 2 DESC, 1",
    "approximate_keys": "SELECT '10:event_type#utf8:' || strlen(event_type) || ':' || event_type AS key, count(*) AS frequency FROM events GROUP BY 1",
    "approximate_heavy": "WITH k AS (SELECT CASE WHEN l_linenumber = 1 THEN 'hot' ELSE CAST(l_orderkey AS VARCHAR) END AS k FROM lineitem) SELECT '1:k#utf8:' || strlen(k) || ':' || k AS key, count(*) AS n, true AS within_error FROM k GROUP BY k HAVING count(*) > (SELECT count(*) FROM k) / 64",
    "row_partition_sizes": "WITH " + _SIZES + "SELECT partition_id, rows FROM s",
    "heavy_rows": f"WITH h AS ({_HEAVY}) SELECT lang, {_LANG_KEY} IN (SELECT key FROM h) AS is_heavy, count(*) AS n FROM documents GROUP BY 1, 2",
    "join_payloads": "SELECT count(DISTINCT o_custkey) AS rows, count(DISTINCT o_custkey) AS keys, count(DISTINCT o_custkey) AS payloads FROM orders",
    "csv_source": "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation",
    "csv_layout": "SELECT CAST(s_nationkey AS VARCHAR) AS s_nationkey, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS keys FROM supplier GROUP BY 1",
    "layout_rows": "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1",
    "layout_manifest": "WITH " + _fnv("SELECT '9:c_custkey#int64:' || c_custkey AS key FROM customer", 16) + "SELECT range AS partition_id, count(key) AS rows FROM range(16) LEFT JOIN h ON partition = range GROUP BY 1",
    "layout_files": "SELECT count(*) AS rows, CAST(16 AS BIGINT) AS partitions, CAST(0 AS BIGINT) AS astray FROM documents",
    "stored_keys": "SELECT '9:o_custkey#int64:' || o_custkey AS key, count(*) AS frequency FROM orders GROUP BY 1",
    "method_aware_join": _SUPPLIER,
    "skip_reasons": "SELECT * FROM (VALUES ('no plan', 'partition_plan_missing'), ('reused', 'input_reused'), ('other job', 'partition_plan_job_type_not_join'), ('other keys', 'join_key_mismatch'), ('strategy', 'unsupported_join_strategy')) AS t(\"case\", reason)",
    "appended_layout": "SELECT o_custkey, count(*) AS n, true AS placed FROM orders GROUP BY 1",
    "layout_record": "WITH " + _fnv("SELECT '9:c_custkey#int64:' || c_custkey AS key FROM customer", 16) + ", s AS (SELECT range AS p, count(key) AS n FROM range(16) LEFT JOIN h ON partition = range GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS rows, (SELECT count(DISTINCT c_custkey) FROM customer) AS distinct_keys, count(*) AS output_partitions, round(max(n) / avg(n), 6) AS before_ratio, CAST(1 AS DOUBLE) AS reduction, max(n) AS written_max, avg(n) AS written_mean, round(max(n) / avg(n), 6) AS written_ratio FROM s",
    "join_plan": """WITH l AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), r AS (SELECT * FROM l WHERE event_type <> 'click'),
a AS (SELECT event_type FROM l WHERE n > (SELECT ceil(sum(n) / 16) FROM l)), b AS (SELECT event_type FROM r WHERE n > (SELECT ceil(sum(n) / 16) FROM r)),
c AS (SELECT event_type FROM a INTERSECT SELECT event_type FROM b),
k AS (SELECT 'left' AS side, event_type FROM a UNION ALL SELECT 'right', event_type FROM b UNION ALL SELECT 'shared', event_type FROM c)
SELECT side, '10:event_type#utf8:' || strlen(event_type) || ':' || event_type AS key, CASE WHEN EXISTS (SELECT 1 FROM c) THEN 'salted_heavy_key_join' ELSE 'heavy_key_isolation_join' END AS strategy FROM k""",
    "rewrite_reasons": f"WITH h AS ({_HEAVY}), j AS (SELECT * FROM (VALUES ('group_by', false), ('scan', false), ('filter', false), ('scan', true)) AS t(job, forced)) SELECT job, forced, forced OR (job = 'group_by' AND EXISTS (SELECT 1 FROM h)) AS rewrite, CASE WHEN forced THEN 'force_rewrite' WHEN job <> 'group_by' THEN 'downstream_operator_not_skew_sensitive' WHEN EXISTS (SELECT 1 FROM h) THEN 'heavy_keys_detected' END AS reason FROM j",
    "partition_targets": "WITH t AS (SELECT 'customer' AS dataset, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem), w AS (SELECT *, greatest(1, (n * width + 1048575) // 1048576) AS need FROM t, (SELECT unnest([10, 400]) AS width)), p AS (SELECT *, least(greatest(need, 2), 16) AS parts FROM w) SELECT dataset, CAST(width AS BIGINT) AS width, CAST(parts AS BIGINT) AS partitions, CAST(greatest(1, least((n + parts - 1) // parts, 1048576 // width)) AS BIGINT) AS target_rows, CAST(need AS BIGINT) AS required_by_size, need <= 16 AS satisfied FROM p",
    "typed_keys": "SELECT DISTINCT date_trunc('year', o_orderdate) AS year, o_orderstatus, CAST(year(o_orderdate) * 1000 AS BIGINT) AS n FROM orders",
    "first_heavy_keys": f"SELECT key, frequency, salt_count FROM ({_HEAVY}) ORDER BY key LIMIT 5",
    "key_lookup": "SELECT lang, count(*) AS n FROM documents GROUP BY 1",
    "result_variants": "WITH r AS (SELECT *, o_orderkey % 3 AS m FROM orders WHERE coalesce(o_orderstatus <> 'P', true)), b AS (SELECT *, max(CASE WHEN m = 2 THEN 2 ELSE 1 END) OVER (PARTITION BY o_orderpriority, o_orderstatus) AS best FROM r) SELECT o_orderkey, CASE WHEN m = 0 THEN 'baseline' ELSE 'prepared' END AS variant FROM b WHERE m IN (0, best)",
    "memory_source": "WITH r AS (SELECT CASE WHEN range <> 3 THEN 'k' || range % 4 END AS k FROM range(20)) SELECT '1:k#' || CASE WHEN k IS NULL THEN 'null' ELSE 'utf8:' || strlen(k) || ':' || k END AS key, count(*) AS frequency FROM r GROUP BY k",
    "generate_group_by": _tail(7000, 50, "SELECT 'group_heavy_00000000' AS key, 3000 AS n UNION ALL"),
    "generate_right_sides": "SELECT * FROM (VALUES ('small', 6000::BIGINT, 6000::BIGINT, 0::BIGINT), ('shared', 6000, 3001, 3000), ('one_sided', 6000, 6000, 0)) AS t(scenario, rows, keys, heavy)",
    "file_summary": "SELECT CAST(1 AS BIGINT) AS files, count(*) AS rows FROM lineitem",
    "numbered_rows": "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events",
    "rolling_hash": f"WITH RECURSIVE b AS (SELECT c_custkey, hex(encode(c_mktsegment)) AS x FROM customer), r(c_custkey, x, i, v) AS (SELECT c_custkey, x, 0, CAST(xor({SEED}, c_custkey) & 2147483647 AS BIGINT) FROM b UNION ALL SELECT c_custkey, x, i + 1, xor(v * 131, CAST(('0x' || substr(x, 2 * i + 1, 2)) AS BIGINT)) & 2147483647 FROM r WHERE i < length(x) / 2) SELECT c_custkey, v FROM r WHERE i = length(x) / 2",
    "top_keys": "SELECT l_partkey, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "key_skew": "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, max(n) AS max_frequency, round(avg(n), 6) AS mean_frequency, round(max(n) / avg(n), 6) AS max_mean_ratio, round(stddev_pop(n) / avg(n), 6) AS coefficient_of_variation FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)",
    "generate_uniform": _tail(10003, 100, ""),
    "generate_single_heavy": _tail(5000, 50, "SELECT 'heavy_00000000' AS key, 5000 AS n UNION ALL"),
    "generate_multi_heavy": _tail(4000, 40, "SELECT 'heavy_0000000' || range AS key, 1200 AS n FROM range(5) UNION ALL"),
    "generate_custom_heavy": _tail(4000, 30, "SELECT 'a' AS key, 4000 AS n UNION ALL SELECT 'b', 2000 UNION ALL"),
    "generate_zipf": _ALLOT_ZIPF,
    "generate_join_pair": "SELECT 'join_heavy_00000000' AS key, 5000 AS left_n, 1500 AS right_n UNION ALL SELECT 'key_' || lpad(CAST(range AS VARCHAR), 8, '0'), 125, 25 FROM range(40)",
    "generate_rows": "SELECT CAST(1000 AS BIGINT) AS rows, CAST(10 AS BIGINT) AS keys, '2024-01-01 00:16:39' AS last, CAST(1000 AS BIGINT) AS in_range",
    "dimension": "SELECT c_mktsegment, 'dim_' || lpad(CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS VARCHAR), 8, '0') AS dimension_value FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)",
    "collision_keys": "WITH " + _fnv("SELECT '7:user_id#utf8:18:collision_' || lpad(CAST(range AS VARCHAR), 8, '0') AS key FROM range(3200)", 16) + "SELECT substr(key, 19) AS user_id FROM h WHERE partition = 0 ORDER BY key LIMIT 50",
    "trimmed_mean": "WITH r AS (SELECT l_returnflag, l_linestatus, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem) SELECT l_returnflag, l_linestatus, round(avg(v), 3) AS value FROM r WHERE r > floor(n * 0.2) AND r <= n - floor(n * 0.2) GROUP BY 1, 2",
    "interpolation": _EXPECTED + "SELECT workload, rows, round(expected, 5) AS expected FROM e",
    "smoothing": _EXPECTED + ", f AS (SELECT *, coalesce(expected > 0 AND abs(t - expected) >= 2.0 AND (t / expected > 1.75 OR t / expected < 0), false) AS z FROM e) SELECT workload, rows, round(CASE WHEN z THEN expected ELSE t END, 5) AS spark_time_seconds, t AS spark_time_seconds_raw, z AS time_smoothed FROM f",
    "report_pivot": "SELECT o_orderstatus, round(max(o_totalprice) FILTER (o_orderkey % 3 = 0), 2) AS baseline, round(max(o_totalprice) FILTER (o_orderkey % 3 = 1), 2) AS physical_only, CAST(NULL AS DOUBLE) AS method_aware FROM orders GROUP BY 1",
    "matrix": "SELECT scenario, CAST(r AS BIGINT) AS rows, CAST(h AS DOUBLE) AS heavy_fraction, CAST(m AS BIGINT) AS max_partitions, CAST(t AS BIGINT) AS target_partition_size_mb FROM (SELECT unnest(['uniform_no_skew', 'single_heavy', 'multi_heavy', 'zipf', 'normal_key_hash_skew', 'small_right_join', 'shared_heavy_join', 'one_sided_heavy_join']) AS scenario), (SELECT unnest([10000, 100000, 1000000]) AS r), (SELECT unnest([0.1, 0.25, 0.5, 0.75]) AS h), (SELECT unnest([4, 8, 16, 32]) AS m), (SELECT unnest([16, 64, 128]) AS t)",
    "aggregated_summary": """WITH o AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_totalprice)),
a AS (SELECT o_orderstatus AS skew, o_orderpriority AS variant, count(DISTINCT o_orderkey % 5) AS dataset_repetitions, count(*) AS total_repetitions, round(avg(o_totalprice) FILTER (r > floor(n * 0.1) AND r <= n - floor(n * 0.1)), 3) AS spark_time_seconds FROM o GROUP BY 1, 2),
t AS (SELECT o_orderstatus AS skew, o_orderpriority AS variant, o_orderkey % 5 AS d, CAST(arg_max(o_custkey, o_orderkey) AS DOUBLE) AS tau FROM orders GROUP BY 1, 2, 3),
b AS (SELECT skew, variant, round(avg(tau), 4) AS tau, min(tau) AS tau_min, max(tau) AS tau_max FROM t GROUP BY 1, 2)
SELECT a.*, tau, tau_min, tau_max FROM a JOIN b USING (skew, variant)""",
}

#: Queries without SQL: the engine's own hash, or placement by a greedy loop (tests hold them otherwise).
PLAIN = ["filter_xxhash", "row_checksum", "load_aware_sizes", "plan_balance"]


def queries() -> dict:
    return {name: globals()[name] for name in [*ORACLE, *PLAIN]}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
