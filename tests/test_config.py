import copy

import pytest

from evenkeel.config import Config
from evenkeel.errors import InvalidConfig, ParseYaml

BASE = {
    "dataset": {"input": "in", "input_format": "parquet"},
    "output": {"path": "out"},
    "partitioning": {"key_columns": ["k"], "target_partition_size_mb": 64, "max_partitions": 8, "heavy_key_alpha": 2.0, "seed": 42},
    "job": {"type": "group_by"},
}


def with_(path, value):
    raw = copy.deepcopy(BASE)
    at = raw
    *head, last = path.split(".")
    for p in head:
        at = at.setdefault(p, {})
    at[last] = value
    return raw


def test_defaults():
    c = Config.from_dict(BASE)
    assert (c.output.partition_column, c.output.salt_column, c.output.heavy_key_column) == ("_rp_partition_id", "_rp_salt", "_rp_is_heavy_key")
    assert c.partitioning.normal_key_assignment == "load_aware" and c.partitioning.no_op_max_imbalance_ratio == 1.2
    assert (c.statistics.heavy_hitter_mode, c.statistics.approximate_capacity) == ("exact", 10_000)
    assert (c.storage.target_file_size_mb, c.storage.min_file_size_mb) == (128, 16)


def test_legacy_form():
    raw = copy.deepcopy(BASE)
    raw["dataset"] = {"input": "in", "format": "csv", "output": "there"}
    del raw["output"]
    c = Config.from_dict(raw)
    assert (c.dataset.input_format, c.output.path, c.output.format) == ("csv", "there", "csv")


@pytest.mark.parametrize(
    ("path", "value", "message"),
    [
        ("dataset.input", " ", "dataset.input must not be empty"),
        ("dataset.input_format", None, "dataset.input_format or dataset.format must be specified"),
        ("output.path", "", "output.path or dataset.output must be specified"),
        ("partitioning.key_columns", ["", " "], "partitioning.key_columns must contain at least one non-empty column name"),
        ("partitioning.target_partition_size_mb", 0, "target_partition_size_mb must be greater than zero, got 0"),
        ("partitioning.min_partitions", 0, "min_partitions must be greater than zero, got 0"),
        ("partitioning.max_partitions", 0, "max_partitions must be greater than zero, got 0"),
        ("partitioning.min_partitions", 9, "got 9 > 8"),
        ("partitioning.no_op_max_imbalance_ratio", float("nan"), "must be finite and greater than zero, got nan"),
        ("partitioning.strategy", "magic", "unsupported partitioning.strategy: magic"),
        ("statistics.approximate_capacity", 0, "approximate_capacity must be greater than zero, got 0"),
        ("storage.target_file_size_mb", 0, "target_file_size_mb must be greater than zero, got 0"),
        ("storage.min_file_size_mb", 0, "min_file_size_mb must be greater than zero, got 0"),
        ("storage.min_file_size_mb", 500, "got 500 > 128"),
        ("join", {"right_input": " ", "join_keys": ["k"]}, "join.right_input must not be empty"),
        ("join", {"right_input": "r", "join_keys": [" "]}, "join.join_keys must contain at least one non-empty column name"),
        ("job.type", "sort", "unsupported job.type: sort"),
        ("partitioning.nonsense", 1, "nonsense"),
    ],
)
def test_refused(path, value, message):
    with pytest.raises(InvalidConfig, match=message.replace("(", "\\(")):
        Config.from_dict(with_(path, value))


def test_yaml_and_overrides():
    c = Config.from_yaml("dataset: {input: a, input_format: parquet}\noutput: {path: b}\npartitioning: {key_columns: [k], target_partition_size_mb: 1, max_partitions: 2, heavy_key_alpha: 2.0, seed: 1}\njob: {type: join}\njoin: {right_input: r, join_keys: [j], left_input: l}\n")
    assert c.for_join().dataset.input == "l" and c.for_join().partitioning.key_columns == ("j",)
    assert c.overridden("x", "y").for_join().dataset.input == "x" and c.overridden("x", "y").output.path == "y"
    with pytest.raises(ParseYaml):
        Config.from_yaml("a: [")
    with pytest.raises(ParseYaml):
        Config.from_yaml("just text")
