"""Configuration: YAML or dict to validated dataclasses."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any

import yaml

from .errors import InvalidConfig, ParseYaml, ReadFile

FORMATS = ("parquet", "csv")
STRATEGIES = ("adaptive_hash_salt", "file_size_balancing")
NORMAL_ASSIGNMENTS = ("load_aware", "hash")
JOB_TYPES = ("scan", "group_by", "join", "filter", "generic")
ENGINES = ("spark", "generic")
HEAVY_MODES = ("exact", "approximate")
RIGHT_SIDE_MODES = ("broadcast_if_small", "shuffle")


def _one_of(name: str, value: Any, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise InvalidConfig(f"unsupported {name}: {value}")
    return value


def _blank(value: str | None) -> bool:
    return value is None or not str(value).strip()


@dataclass(frozen=True)
class Dataset:
    input: str
    input_format: str

    def __post_init__(self):
        if _blank(self.input):
            raise InvalidConfig("dataset.input must not be empty")
        if self.input_format is None:
            raise InvalidConfig("dataset.input_format or dataset.format must be specified")
        _one_of("dataset.input_format", self.input_format, FORMATS)


@dataclass(frozen=True)
class Output:
    path: str
    format: str = "parquet"
    include_technical_columns: bool = True
    partition_column: str = "_rp_partition_id"
    salt_column: str = "_rp_salt"
    heavy_key_column: str = "_rp_is_heavy_key"

    def __post_init__(self):
        if _blank(self.path):
            raise InvalidConfig("output.path or dataset.output must be specified")
        _one_of("output.format", self.format, FORMATS)


@dataclass(frozen=True)
class Partitioning:
    key_columns: tuple[str, ...]
    target_partition_size_mb: int
    max_partitions: int
    heavy_key_alpha: float
    seed: int
    min_partitions: int = 1
    strategy: str = "adaptive_hash_salt"
    normal_key_assignment: str = "load_aware"
    force_rewrite: bool = False
    no_op_max_imbalance_ratio: float = 1.2
    #: Ordinary keys that are placed one by one, the rest (the rarest) going by hash, where that is asked for; None: all.
    max_placed_keys: int | None = None

    def __post_init__(self):
        if all(_blank(k) for k in self.key_columns):
            raise InvalidConfig("partitioning.key_columns must contain at least one non-empty column name")
        if self.target_partition_size_mb <= 0:
            raise InvalidConfig(f"partitioning.target_partition_size_mb must be greater than zero, got {self.target_partition_size_mb}")
        if self.min_partitions <= 0:
            raise InvalidConfig(f"partitioning.min_partitions must be greater than zero, got {self.min_partitions}")
        if self.max_partitions <= 0:
            raise InvalidConfig(f"partitioning.max_partitions must be greater than zero, got {self.max_partitions}")
        if self.min_partitions > self.max_partitions:
            raise InvalidConfig(f"partitioning.min_partitions must not be greater than partitioning.max_partitions, got {self.min_partitions} > {self.max_partitions}")
        if not math.isfinite(self.no_op_max_imbalance_ratio) or self.no_op_max_imbalance_ratio <= 0:
            raise InvalidConfig(f"partitioning.no_op_max_imbalance_ratio must be finite and greater than zero, got {self.no_op_max_imbalance_ratio}")
        _one_of("partitioning.strategy", self.strategy, STRATEGIES)
        _one_of("partitioning.normal_key_assignment", self.normal_key_assignment, NORMAL_ASSIGNMENTS)


@dataclass(frozen=True)
class Statistics:
    heavy_hitter_mode: str = "exact"
    approximate_capacity: int = 10_000

    def __post_init__(self):
        _one_of("statistics.heavy_hitter_mode", self.heavy_hitter_mode, HEAVY_MODES)
        if self.approximate_capacity <= 0:
            raise InvalidConfig(f"statistics.approximate_capacity must be greater than zero, got {self.approximate_capacity}")


@dataclass(frozen=True)
class Storage:
    target_file_size_mb: int = 128
    min_file_size_mb: int = 16

    def __post_init__(self):
        if self.target_file_size_mb <= 0:
            raise InvalidConfig(f"storage.target_file_size_mb must be greater than zero, got {self.target_file_size_mb}")
        if self.min_file_size_mb <= 0:
            raise InvalidConfig(f"storage.min_file_size_mb must be greater than zero, got {self.min_file_size_mb}")
        if self.min_file_size_mb > self.target_file_size_mb:
            raise InvalidConfig(f"storage.min_file_size_mb must not be greater than storage.target_file_size_mb, got {self.min_file_size_mb} > {self.target_file_size_mb}")


@dataclass(frozen=True)
class Job:
    type: str = "generic"
    downstream_engine: str = "spark"

    def __post_init__(self):
        _one_of("job.type", self.type, JOB_TYPES)
        _one_of("job.downstream_engine", self.downstream_engine, ENGINES)


@dataclass(frozen=True)
class Join:
    right_input: str
    join_keys: tuple[str, ...]
    left_input: str | None = None
    right_side_mode: str = "broadcast_if_small"
    broadcast_threshold_mb: int = 10

    def __post_init__(self):
        if _blank(self.right_input):
            raise InvalidConfig("join.right_input must not be empty")
        if all(_blank(k) for k in self.join_keys):
            raise InvalidConfig("join.join_keys must contain at least one non-empty column name")
        _one_of("join.right_side_mode", self.right_side_mode, RIGHT_SIDE_MODES)


@dataclass(frozen=True)
class Resources:
    local_threads: int = 1
    memory_limit_mb: int = 1 << 20
    fail_on_memory_limit: bool = False


@dataclass(frozen=True)
class Config:
    dataset: Dataset
    output: Output
    partitioning: Partitioning
    job: Job
    resources: Resources = field(default_factory=Resources)
    statistics: Statistics = field(default_factory=Statistics)
    storage: Storage = field(default_factory=Storage)
    join: Join | None = None

    @staticmethod
    def from_dict(raw: dict[str, Any]) -> Config:
        raw = raw or {}
        d = raw.get("dataset") or {}
        legacy = d.get("format")
        o = dict(raw.get("output") or {})
        p = dict(raw.get("partitioning") or {})
        p["key_columns"] = tuple(p.get("key_columns") or ())
        join = dict(raw["join"]) if raw.get("join") else None
        if join is not None:
            join["join_keys"] = tuple(join.get("join_keys") or ())
            join.setdefault("right_input", "")
        o["path"] = o.get("path") or d.get("output")
        o["format"] = o.get("format") or legacy or "parquet"
        if d.get("input_format") or legacy:
            o["format"] = (raw.get("output") or {}).get("format") or legacy or "parquet"
        try:
            return Config(
                Dataset(d.get("input") or "", d.get("input_format") or legacy),
                Output(**o),
                Partitioning(**p),
                Job(**(raw.get("job") or {})),
                Resources(**(raw.get("resources") or {})),
                Statistics(**(raw.get("statistics") or {})),
                Storage(**(raw.get("storage") or {})),
                Join(**join) if join else None,
            )
        except TypeError as e:
            raise InvalidConfig(str(e)) from e

    @staticmethod
    def from_yaml(text: str, path: str = "<string>") -> Config:
        try:
            raw = yaml.safe_load(text)
        except yaml.YAMLError as e:
            raise ParseYaml(path, e) from e
        if not isinstance(raw, dict):
            raise ParseYaml(path, "not a mapping")
        return Config.from_dict(raw)

    @staticmethod
    def from_yaml_file(path: str) -> Config:
        try:
            text = Path(path).read_text(encoding="utf-8")
        except OSError as e:
            raise ReadFile(path, e) from e
        return Config.from_yaml(text, path)

    def overridden(self, input: str | None = None, output: str | None = None) -> Config:  # noqa: A002
        """With paths from the command line; an explicit input also wins over join.left_input."""
        out = self
        if input:
            out = replace(out, dataset=replace(out.dataset, input=input))
            if out.join:
                out = replace(out, join=replace(out.join, left_input=input))
        if output:
            out = replace(out, output=replace(out.output, path=output))
        return out

    def for_join(self) -> Config:
        """For join jobs: the left input is the dataset and the join keys are the partitioning keys."""
        if self.job.type != "join" or self.join is None:
            return self
        return replace(self, dataset=replace(self.dataset, input=self.join.left_input or self.dataset.input), partitioning=replace(self.partitioning, key_columns=self.join.join_keys))
