import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from evenkeel import pipeline
from evenkeel.config import Config
from evenkeel.errors import FileSizeBalancingNotImplemented, InputPathNotFound, NoParquetFiles, ResourceLimitExceeded, UnsupportedColumnType, UnsupportedFormat
from evenkeel.functions import arithmetic, hashing, keys
from evenkeel.operators import statistics as st
from evenkeel.operators.assign import assign, partitions_of_key
from evenkeel.plans import placement, planner
from evenkeel.plans.placement import Loads, place_normal, place_salts
from evenkeel.plans.targeting import target
from evenkeel.sources import files, sinks

GOLDEN = {
    "7:user_id#utf8:5:heavy": 6637662816898448031,
    "7:user_id#null": 12230479113306647505,
    "7:user_id#utf8:0:": 2082845550107705201,
    "7:user_id#int64:42": 14128112956915863417,
    "7:user_id#utf8:5:a=b|c|6:region#utf8:2:eu": 3655022952626428685,
}


def config(job="group_by", key=("user_id",), most=4, **more):
    raw = {"dataset": {"input": "x", "input_format": "parquet"}, "output": {"path": "x"}, "partitioning": {"key_columns": list(key), "target_partition_size_mb": 1, "max_partitions": most, "heavy_key_alpha": 2.0, "seed": 42}, "job": {"type": job}}
    for k, v in more.items():
        raw[k] = {**raw.get(k, {}), **v}
    return Config.from_dict(raw)


def memory(spark, values, kind="string", size=0):
    d = files.in_memory(spark, [(v,) for v in values], f"user_id {kind}")
    d.files = [files.InputFile("f", size)] if size else []
    return d


HEAVY = ["heavy"] * 10 + ["a", "b", "c", "d"]


# --- functions ------------------------------------------------------------------------------------------


def test_hash_goldens(spark):
    frame = spark.createDataFrame([(k,) for k in GOLDEN] + [("",), ("ключ中" * 40,), (None,)], "k string")
    for r in frame.select("k", hashing.fnv1a64_column(F.col("k"), 42).alias("h"), hashing.partition_id_column(F.col("k"), 42, 13).alias("p")).collect():
        if r["k"] is None:
            assert r["p"] is None
            continue
        assert r["h"] == hashing.fnv1a64(r["k"], 42) and r["p"] == hashing.partition_id(r["k"], 42, 13)
        assert GOLDEN.get(r["k"], r["h"]) == r["h"]


def test_rolling_hash(spark):
    frame = spark.createDataFrame([("user_1", 7), ("", 0), ("é", 1 << 33)], "k string, r long")
    for r in frame.select("k", "r", hashing.stable_value(F.col("k"), F.col("r"), 42).alias("v"), hashing.stable_payload_value(F.col("k"), F.col("r"), 42, 3).alias("p")).collect():
        assert r["v"] == hashing.stable_value_python(r["k"], r["r"], 42) and 0 <= r["p"] < 1 << 31


def test_key_encoding(spark):
    row = (None, "", "a=b|c", 42, True, dt.date(1970, 1, 11), dt.datetime(1970, 1, 1, 0, 0, 1, 5), Decimal("-12.340"), Decimal("0.00"))
    schema = "n string, e string, s string, i int, b boolean, d date, t timestamp_ntz, m decimal(10,3), z decimal(5,2)"
    f = spark.createDataFrame([row], schema)
    one = lambda c: f.select(keys.encode_key(f, [c])).first()[0]
    assert [one(c) for c in "nesibdtmz"] == ["1:n#null", "1:e#utf8:0:", "1:s#utf8:5:a=b|c", "1:i#int64:42", "1:b#bool:true", "1:d#date32:10", "1:t#timestamp_micros:1000005", "1:m#decimal:16:decimal128(10,3):-12340", "1:z#decimal:15:decimal128(5,2):0"]
    assert f.select(keys.encode_key(f, ["s", "i"])).first()[0] == "1:s#utf8:5:a=b|c|1:i#int64:42"
    back = f.select(keys.structured_key(f, list("nesibdtmz")).alias("k")).first()["k"]
    typed = keys.keys_frame(spark, [[x.asDict() for x in back]], f.schema, list("nesibdtmz")).first()
    assert tuple(typed) == row
    with pytest.raises(UnsupportedColumnType, match="double"):
        keys.encode_key(spark.createDataFrame([(1.0,)], "x double"), ["x"])


def test_timestamps_do_not_depend_on_the_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        f = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' as t")
        assert f.select(keys.encode_key(f, ["t"])).first()[0] == "1:t#timestamp_micros:1704067200000000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_skew(spark):
    sizes = [3, 1, 2, 4]
    want = arithmetic.skew(sizes)
    assert want["median_partition_size"] == 3 and want["partition_size_variance"] == 1.25
    got = st.skew_statistics(spark.createDataFrame(list(enumerate(sizes)), "partition_id int, rows long")).first().asDict()
    assert got == pytest.approx(want)
    assert arithmetic.skew([])["max_mean_imbalance_ratio"] == 0
    none = st.skew_statistics(spark.createDataFrame([], "partition_id int, rows long")).first().asDict()
    assert none == pytest.approx(arithmetic.skew([]))


def test_targeting():
    t = target(100, None, 64, 1, 8)
    assert (t.partitions, t.target_rows, t.satisfied, t.reason) == (8, 13, False, "estimated_row_width_unavailable")
    t = target(10_000, 10_485, 1, 1, 128)
    assert (t.partitions, t.target_rows, t.satisfied) == (100, 100, True)
    assert target(10_000, 10_485, 1, 1, 4).reason == "required_partitions_exceed_max_partitions"
    assert target(0, 10, 1, 1, 4).partitions == 1


# --- planning -------------------------------------------------------------------------------------------


def test_worked_example(spark):
    plan, _, _ = pipeline.plan_dataset(spark, config(), memory(spark, HEAVY))
    e, d = plan.statistics["estimates"], plan.document
    assert e["before_partition_sizes"] == [1, 1, 1, 11] and e["after_partition_sizes"] == [5, 4, 4, 1]
    assert [(k["key"][-1], k["partition_id"]) for k in d["normal_keys"]] == [("a", 1), ("b", 2), ("c", 3), ("d", 0)]
    (h,) = d["heavy_keys"]
    assert [s["partition_id"] for s in h["salt_partitions"]] == [0, 1, 2] and h["detection_reasons"] == ["above_mean_threshold", "exceeds_target_partition_rows"]
    assert d["action"] == "rewrite" and d["cost_estimate"]["reason"] == "heavy_keys_detected"
    assert d["recommended_downstream_plan"]["partial_group_keys"] == ["_rp_partition_id", "_rp_salt", "user_id"]
    json.dumps(d), json.dumps(plan.statistics)
    assert partitions_of_key(d, h["key"]) == [0, 1, 2] and partitions_of_key(d, "7:user_id#utf8:1:a") == [1]


def test_null_and_integer_heavy_keys(spark):
    plan, _, _ = pipeline.plan_dataset(spark, config(), memory(spark, [None] * 10 + list("abcd")))
    assert plan.heavy[0]["key"] == "7:user_id#null" and plan.heavy[0]["parts"][0]["value"] is None
    plan, _, _ = pipeline.plan_dataset(spark, config(), memory(spark, [42] * 10 + [1, 2, 3, 4], "long"))
    assert plan.heavy[0]["key"] == "7:user_id#int64:42"


def test_no_op(spark):
    d = memory(spark, list("abcd") * 100, size=1024)
    plan, _, _ = pipeline.plan_dataset(spark, config(), d)
    assert not plan.rewrite and plan.document["skip_reason"] == "no_rewrite_needed" and not plan.heavy
    plan, _, _ = pipeline.plan_dataset(spark, config("scan"), memory(spark, HEAVY))
    assert plan.document["skip_reason"] == "downstream_operator_not_skew_sensitive"
    assert plan.document["recommended_downstream_plan"]["strategy"] == "input_reuse_no_op"
    plan, _, _ = pipeline.plan_dataset(spark, config("scan", partitioning={"force_rewrite": True}), memory(spark, HEAVY))
    assert plan.rewrite and plan.document["cost_estimate"]["reason"] == "force_rewrite"


def test_size_rule(spark):
    d = memory(spark, [k for k in "abcd" for _ in range(2500)], size=104_850_000)
    plan, _, _ = pipeline.plan_dataset(spark, config(most=128), d)
    assert plan.document["target_partition_rows"] == 100 and [h["salt_count"] for h in plan.heavy] == [25] * 4


def test_load_aware_beats_hash(spark):
    names = [k for k in (f"normal_{i}" for i in range(400)) if hashing.partition_id(f"7:user_id#utf8:{len(k)}:{k}", 42, 4) == 0][:12]
    d = memory(spark, [k for k in names for _ in range(5)])
    plan, _, _ = pipeline.plan_dataset(spark, config(partitioning={"heavy_key_alpha": 100.0}), d)
    e = plan.statistics["estimates"]
    assert e["before_partition_sizes"] == [60, 0, 0, 0] and e["after_partition_sizes"] == [15, 15, 15, 15]
    assert plan.document["cost_estimate"]["reason"] == "max_partition_exceeds_target_rows"
    by_hash, _, _ = pipeline.plan_dataset(spark, config(partitioning={"heavy_key_alpha": 100.0, "normal_key_assignment": "hash"}), d)
    assert by_hash.document["skip_reason"] == "planned_distribution_does_not_improve_skew"


def test_only_the_most_frequent_keys_are_placed_one_by_one(spark):
    d = memory(spark, [f"k{i}" for i in range(50) for _ in range(50 - i)])
    plan, _, _ = pipeline.plan_dataset(spark, config(partitioning={"heavy_key_alpha": 100.0, "max_placed_keys": 20, "force_rewrite": True}, most=8), d)
    rows = assign(d.frame, plan, ["user_id"])
    sizes = [r["n"] for r in rows.groupBy("_rp_partition_id").agg(F.count("*").alias("n")).orderBy("_rp_partition_id").collect()]
    assert plan.normal_count == 20 and plan.document["normal_key_assignment_complete"] and "load_aware_normal_assignment_limited_to_most_frequent_keys" in plan.document["normal_key_assignment_notes"]
    assert sum(sizes) == 1275 and max(sizes) <= max(plan.statistics["estimates"]["after_partition_sizes"])


def test_all_keys_are_placed_and_all_heavy_keys_kept(spark, monkeypatch):
    assert config().partitioning.max_placed_keys is None
    counts = {f"k{i}": 50 - i // 2 for i in range(50)}
    d = memory(spark, [k for k, n in counts.items() for _ in range(n)])
    monkeypatch.setattr(planner, "PLACED_BATCH", 7, raising=False)
    plan, _, _ = pipeline.plan_dataset(spark, config(partitioning={"heavy_key_alpha": 100.0, "force_rewrite": True}, most=8), d)
    loads = Loads([0] * plan.partitions)
    want = place_normal([(f"7:user_id#utf8:{len(k)}:{k}", n) for k, n in counts.items()], loads, 42)
    assert {r["key"]: r["partition_id"] for r in plan.normal.collect()} == want and plan.normal_count == 50 and not plan.heavy
    assert plan.statistics["estimates"]["after_partition_sizes"] == loads.sizes and not plan.document["normal_key_assignment_notes"]
    d = memory(spark, [f"h{i}" for i in range(5) for _ in range(40)] + [f"n{i}" for i in range(60)])
    plan, _, _ = pipeline.plan_dataset(spark, config(partitioning={"max_placed_keys": 2}), d)
    assert [h["key"][-2:] for h in plan.heavy] == [f"h{i}" for i in range(5)] and len(plan.statistics["input"]["heavy_hitters"]) == 5


@pytest.mark.parametrize("mode", ["load_aware", "hash"])
def test_all_keys_are_stored(spark, tmp_path, monkeypatch, mode):
    monkeypatch.setattr(planner, "LISTED_KEYS", 5)
    values = [f"k{i}" for i in range(30)] * 2 + ["hot"] * 80
    spark.createDataFrame([(v,) for v in values], "user_id string").coalesce(1).write.parquet(str(tmp_path / "in"))
    own = config(partitioning={"heavy_key_alpha": 5.0, "normal_key_assignment": mode}, dataset={"input": str(tmp_path / "in")}, output={"path": str(tmp_path / "out")})
    done = pipeline.run(spark, own)
    plan = planner.stored_plan(spark, done.path)
    assert plan.statistics["input"]["key_frequencies_truncated"] and not plan.document["normal_keys_listed_all"] and len(plan.document["normal_keys"]) == 5
    stored = {r["key"]: (r["frequency"], r["partition_id"]) for r in spark.read.parquet(f"{done.path}/{plan.document['key_table']}").collect()}
    assert len(stored) == 31 and stored["7:user_id#utf8:3:hot"] == (80, None) and plan.heavy == done.plan.heavy
    where = {}
    for r in done.frame(spark).select("user_id", "_rp_partition_id").distinct().collect():
        where.setdefault(f"7:user_id#utf8:{len(r[0])}:{r[0]}", []).append(r[1])
    for key, (frequency, _) in stored.items():
        held = partitions_of_key(plan.document, key, plan.keys)
        assert sorted(where[key]) == held if frequency == 2 else set(where[key]) <= set(held)
    again = assign(spark.read.parquet(str(tmp_path / "in")), plan, ["user_id"])
    first = assign(spark.read.parquet(str(tmp_path / "in")), done.plan, ["user_id"])
    assert sorted(map(str, again.collect())) == sorted(map(str, first.collect()))


def test_placement_against_a_plain_loop():
    import random

    rng = random.Random(1)
    pool = [(f"k{i}", rng.randint(1, 9)) for i in range(300)]
    sizes = [0] * 7
    want = {}
    for k, n in sorted(pool, key=lambda x: (-x[1], x[0])):
        i = min(range(7), key=lambda i: (sizes[i], hashing.fnv1a64(f"{k}|candidate={i}", 42), i))
        want[k] = i
        sizes[i] += n
    loads = Loads([0] * 7)
    assert place_normal(pool, loads, 42) == want and loads.sizes == sizes
    salts = place_salts([("h", 100)], loads, 30, 42)
    assert len(salts["h"]) == 4 and sum(loads.sizes) == sum(sizes) + 100


def test_placement_on_many_partitions(monkeypatch):
    """Whole ties are hashed as arrays: the partitions of a plain loop, without a hash for each key and partition."""
    import random

    rng, calls = random.Random(3), []
    pool = [(f"k{i}", rng.randint(0, 3)) for i in range(700)]
    loads = Loads([rng.choice((0, 0, 0, 1)) for _ in range(431)])
    sizes, want = loads.sizes.copy(), {}
    for k, n in sorted(pool, key=lambda x: (-x[1], x[0])):
        i = min(range(431), key=lambda i: (sizes[i], hashing.fnv1a64(f"{k}|candidate={i}", 42), i))
        want[k] = i
        sizes[i] += n
    assert place_normal(pool, loads, 42) == want and loads.sizes == sizes
    monkeypatch.setattr(placement, "fnv1a64", lambda *a, **b: calls.append(0) or hashing.fnv1a64(*a, **b))
    salts = place_salts([(f"k{i}", 3) for i in range(2000)], Loads([0] * 4000), 2, 42)
    assert sum(map(len, salts.values())) == 4000 and len(calls) < 4000 * 40


def test_least_hash_of_ties():
    """Also where the hashes of one ten begin at 0 again, and after partitions have gone."""
    below_0 = (-16 * pow(hashing.PRIME, -1, 1 << 64)) % (1 << 64) ^ ord("0")
    for state in (below_0, below_0 | 5, 0, 1, (1 << 64) - 1, *(hashing.fnv1a64(str(i)) for i in range(20))):
        own = set(range(3, 1234, 3)) | set(range(10))
        ties = placement.Ties(own, 7)
        for _ in range(30):
            best = ties.best(state)
            assert best == min(own, key=lambda i: (hashing.fnv1a64(str(i), state=state), i))
            own.discard(best)
            ties.drop(best)


def test_approximate(spark):
    d = memory(spark, [f"key_{i}" for i in range(250)])
    plan, _, _ = pipeline.plan_dataset(spark, config(statistics={"heavy_hitter_mode": "approximate", "approximate_capacity": 8}), d)
    assert plan.document["normal_key_assignment"] == "hash" and not plan.document["normal_key_assignment_complete"]
    assert plan.statistics["input"]["distinct_keys"] is None and plan.statistics["heavy_hitter_detection"]["frequencies_truncated"]
    frame = st.with_typed_keys(st.approximate_frequencies(d.frame, ["user_id"], 8)[0], d.frame, ["user_id"])
    assert frame.count() == 8 and all(r["key"].endswith(r["k"]["user_id"]) for r in frame.collect())
    counts, worst = st.space_saving(["heavy"] * 100 + [f"x{i}" for i in range(900)], 16)
    assert counts["heavy"] >= 100 and len(counts) == 16 and worst > 0


def test_space_saving_against_a_plain_loop():
    import random

    rng = random.Random(2)
    stream = [f"k{min(int(rng.paretovariate(0.8)), 60)}" for _ in range(2000)]
    counts, worst = {}, 0
    for k in stream:
        if k in counts:
            counts[k] += 1
        elif len(counts) < 10:
            counts[k] = 1
        else:
            n, out = min((n, x) for x, n in counts.items())
            worst = max(worst, n)
            del counts[out]
            counts[k] = n + 1
    assert st.space_saving(stream, 10) == (dict(sorted(counts.items())), worst)


def join_config(**more):
    return config("join", join={"right_input": "r", "join_keys": ["user_id"], **more})


def test_join_strategies(spark):
    left = memory(spark, ["heavy"] * 40 + list("abcd"))
    big = memory(spark, ["heavy"] * 30 + ["x", "y"], size=2 << 20)
    plan, _, _ = pipeline.plan_dataset(spark, join_config(broadcast_threshold_mb=1), left, big)
    j = plan.document["join_plan"]
    assert j["recommended_strategy"] == "salted_heavy_key_join" and j["shared_heavy_keys"] == ["7:user_id#utf8:5:heavy"] and j["right_side_size_mb"] == 2
    plan, _, _ = pipeline.plan_dataset(spark, join_config(), left, big)
    assert plan.document["recommended_downstream_plan"]["strategy"] == "broadcast_join"
    distinct = memory(spark, [f"r{i}" for i in range(40)], size=2 << 20)
    plan, _, _ = pipeline.plan_dataset(spark, join_config(broadcast_threshold_mb=0), left, distinct)
    assert plan.document["join_plan"]["recommended_strategy"] == "heavy_key_isolation_join"
    plan, _, _ = pipeline.plan_dataset(spark, join_config(broadcast_threshold_mb=0), memory(spark, [f"l{i}" for i in range(40)]), distinct)
    assert plan.document["recommended_downstream_plan"] | {"notes": 0} == plan.document["recommended_downstream_plan"] | {"notes": 0, "strategy": "physical_repartitioning", "requires_operator_rewrite": False}
    assert planner.join_strategy("shuffle", 1, 10, [], []) == "physical_only"


def test_refusals(spark, tmp_path):
    with pytest.raises(FileSizeBalancingNotImplemented):
        pipeline.plan_dataset(spark, config(partitioning={"strategy": "file_size_balancing"}), memory(spark, HEAVY))
    with pytest.raises(ResourceLimitExceeded):
        pipeline.plan_dataset(spark, config(resources={"memory_limit_mb": 1, "fail_on_memory_limit": True}), memory(spark, HEAVY, size=5 << 20))
    plan, _, _ = pipeline.plan_dataset(spark, config(resources={"memory_limit_mb": 1}), memory(spark, HEAVY, size=5 << 20))
    assert plan.statistics["resources"]["warnings"] == ["estimated_dataset_size_exceeds_configured_memory_limit"]
    with pytest.raises(InputPathNotFound):
        files.read_dataset(spark, str(tmp_path / "none"), "parquet")
    (tmp_path / "bare").mkdir()
    with pytest.raises(NoParquetFiles):
        files.read_dataset(spark, str(tmp_path / "bare"), "parquet")
    with pytest.raises(UnsupportedFormat):
        sinks.write_layout(spark.range(1), str(tmp_path / "o"), 1, "id", "csv")


# --- assignment and writing --------------------------------------------------------------------------------


def parquet_config(data, out, **more):
    return config(dataset={"input": data}, output={"path": out, **more.pop("output", {})}, **more)


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "data")
    rows = [(("heavy" if i % 4 else f"u{i % 8}"), i, "eu") for i in range(32)]
    spark.createDataFrame(rows, "user_id string, row_id long, region string").repartition(3).write.parquet(path)
    return path


def test_rewrite_keeps_rows(spark, table, tmp_path):
    out = str(tmp_path / "out")
    c = parquet_config(table, out, partitioning={"force_rewrite": True, "min_partitions": 4})
    got = pipeline.run(spark, c)
    back = got.frame(spark)
    assert set(back.columns) == {"user_id", "row_id", "region", "_rp_partition_id", "_rp_salt", "_rp_is_heavy_key", "rp_partition"}
    same = back.select("user_id", "row_id", "region")
    assert same.exceptAll(spark.read.parquet(table)).isEmpty() and spark.read.parquet(table).exceptAll(same).isEmpty()
    assert back.where("_rp_partition_id <> rp_partition or (_rp_salt is null) = _rp_is_heavy_key").isEmpty()
    salts = {h["key"]: h["salt_count"] for h in got.plan.document["heavy_keys"]}
    counts = {r["_rp_salt"]: r["n"] for r in back.where("user_id = 'heavy'").groupBy("_rp_salt").agg(F.count("*").alias("n")).collect()}
    n, s = 24, salts["7:user_id#utf8:5:heavy"]
    assert counts == {i: arithmetic.salt_load(n, s, i) for i in range(s)}
    parts = {p["partition_id"]: p["row_count"] for p in got.manifest["partitions"]}
    assert sum(parts.values()) == 32 and [parts[i] for i in sorted(parts)] == got.statistics["estimates"]["after_partition_sizes"]
    assert got.statistics["after_skew"] and files.read_plan(spark, out)["action"] == "rewrite" and files.read_manifest(spark, out)["partitions"] == got.manifest["partitions"]
    again = pipeline.run(spark, c)  # overwrites, no stale rows
    assert again.frame(spark).count() == 32


def test_round_robin_follows_the_files(spark, table, tmp_path):
    """The i-th heavy row in scan order has salt i mod S, also across blocks."""
    from evenkeel.operators import assign as module

    frame = spark.read.parquet(table)
    d = files.InputDataset(table, "parquet", [], frame)
    plan, _, _ = pipeline.plan_dataset(spark, config(), d)
    old, module.BLOCK = module.BLOCK, 2
    try:
        rows = assign(frame, plan, ["user_id"])
        got = {r["row_id"]: r["_rp_salt"] for r in rows.where("user_id = 'heavy'").collect()}
    finally:
        module.BLOCK = old
    order = frame.where("user_id = 'heavy'").select("row_id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()
    s = next(h["salt_count"] for h in plan.heavy if h["key"].endswith("heavy"))
    assert [got[r["row_id"]] for r in order] == [i % s for i in range(len(order))]


def test_spread_salting(spark, table):
    frame = spark.read.parquet(table)
    plan, _, _ = pipeline.plan_dataset(spark, config(), files.InputDataset(table, "parquet", [], frame))
    rows = assign(frame, plan, ["user_id"], salting="spread")
    assert rows.count() == 32 and rows.where("_rp_is_heavy_key").select("_rp_salt").distinct().count() > 1


def test_without_technical_columns(spark, table, tmp_path):
    got = pipeline.run(spark, parquet_config(table, str(tmp_path / "o"), output={"include_technical_columns": False}, partitioning={"force_rewrite": True}))
    assert set(got.frame(spark).columns) == {"user_id", "row_id", "region", "rp_partition"}
    assert "technical_columns_disabled" in got.plan.document["recommended_downstream_plan"]["notes"]


def test_no_op_reuses_the_input(spark, tmp_path):
    data, out = str(tmp_path / "d"), str(tmp_path / "o")
    spark.createDataFrame([(c, i) for i, c in enumerate("abcd" * 50)], "user_id string, row_id long").write.parquet(data)
    got = pipeline.run(spark, config("filter", dataset={"input": data}, output={"path": out}))
    assert got.manifest["input_reused"] and files.data_path(out, got.manifest) == data and got.frame(spark).count() == 200
    assert {p["file_count"] for p in got.manifest["partitions"]} == {0}


def test_files_roll(spark, tmp_path):
    data, out = str(tmp_path / "d"), str(tmp_path / "o")
    spark.range(3000).select(F.lit("k").alias("user_id"), F.sha2(F.col("id").cast("string"), 512).alias("payload")).write.parquet(data)
    c = parquet_config(data, out, partitioning={"force_rewrite": True, "max_partitions": 1}, storage={"target_file_size_mb": 1, "min_file_size_mb": 1})
    got = pipeline.run(spark, c)
    width = got.statistics["input"]["estimated_row_width_bytes"]
    assert sinks.max_records(width, 1 << 20) == (1 << 20) // width and sinks.max_records(None, 5) == 0
    sinks.write_layout(spark.read.parquet(data).withColumn("p", F.lit(0)), out, 1, "p", records=1000)
    assert len(files.list_files(spark, out, ".parquet")) == 3


def test_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("user_id,region,payload\nheavy,eu,1\n,us,2\nheavy,,3\n")
    d = files.read_dataset(spark, str(path), "csv")
    assert sorted(map(tuple, d.frame.collect())) == [("", "us", "2"), ("heavy", "", "3"), ("heavy", "eu", "1")]
    got = pipeline.run(spark, config(dataset={"input": str(path), "input_format": "csv"}, output={"path": str(tmp_path / "o"), "format": "parquet"}, partitioning={"force_rewrite": True}))
    assert {"user_id", "region", "payload"} <= set(got.frame(spark).columns)
    with pytest.raises(InputPathNotFound):
        files.read_csv(spark, str(tmp_path / "none.csv"))


def test_unsigned_keys(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "u.parquet")
    pq.write_table(pa.table({"user_id": pa.array([1, 2**63 + 5, 1, 1, 1, 1, 1], pa.uint64()), "x": pa.array(range(7), pa.int64())}), path)
    assert keys.unsigned_columns(spark, path) == ["user_id"]
    plan, _, _ = pipeline.plan_dataset(spark, config(dataset={"input": path}))
    assert {h["key"] for h in plan.heavy} | {k["key"] for k in plan.document["normal_keys"]} == {"7:user_id#uint64:1", f"7:user_id#uint64:{2**63 + 5}"}


def test_file_summary(spark):
    listing = [files.InputFile("a", 5 << 20), files.InputFile("b", 200 << 20), files.InputFile("c", 64 << 20)]
    want = st.file_summary(listing, 16, 128)
    assert (want["small_file_count"], want["oversized_file_count"]) == (1, 1)
    got = st.file_summary_frame(st.file_frame(spark, listing), 16, 128).first().asDict()
    assert got == pytest.approx(want)
    assert st.row_width(0, 5) is None and st.row_width(10, 3) == 4


def test_streaming_appends(spark, table, tmp_path):
    from evenkeel.streaming.layout import append_batches

    frame = spark.read.parquet(table)
    plan, _, _ = pipeline.plan_dataset(spark, config(), files.InputDataset(table, "parquet", [], frame))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(table)
    q = append_batches(stream, plan, ["user_id"], str(tmp_path / "s"), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 32 and back.select("batch").distinct().count() > 1
