"""Reading datasets, file listings and metadata documents."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import InputPathNotFound, NoParquetFiles, UnsupportedFormat


@dataclass(frozen=True)
class InputFile:
    path: str
    size_bytes: int


@dataclass
class InputDataset:
    """A DataFrame with the files it came from; no rows are held."""

    path: str
    format: str
    files: list[InputFile]
    frame: DataFrame

    @property
    def size_bytes(self) -> int:
        return sum(f.size_bytes for f in self.files)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def list_files(spark: SparkSession, path: str, suffix: str = "") -> list[InputFile]:
    """Files at or below path, sorted by path; names that start with _ or . are left out."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        raise InputPathNotFound(path)
    if fs.getFileStatus(p).isFile():
        s = fs.getFileStatus(p)
        return [InputFile(str(s.getPath().toString()), int(s.getLen()))]
    out, walk = [], fs.listFiles(p, True)
    while walk.hasNext():
        s = walk.next()
        name = str(s.getPath().getName())
        if name.endswith(suffix) and name[0] not in "_.":
            out.append(InputFile(str(s.getPath().toString()), int(s.getLen())))
    return sorted(out, key=lambda f: f.path)


def read_parquet(spark: SparkSession, path: str) -> InputDataset:
    files = list_files(spark, path, ".parquet")
    if not files:
        raise NoParquetFiles(path)
    single = len(files) == 1 and files[0].path.endswith(path.rstrip("/").rsplit("/", 1)[-1])
    reader = spark.read if single else spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return InputDataset(path, "parquet", files, reader.parquet(path))


def read_csv(spark: SparkSession, path: str) -> InputDataset:
    """A CSV file with a header; all columns are text, an empty cell is empty text, and short rows are errors."""
    files = list_files(spark, path)
    frame = spark.read.csv(path, header=True, inferSchema=False, mode="FAILFAST").fillna("")
    return InputDataset(path, "csv", files, frame)


def read_dataset(spark: SparkSession, path: str, fmt: str) -> InputDataset:
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "csv":
        return read_csv(spark, path)
    raise UnsupportedFormat(fmt)


def in_memory(spark: SparkSession, rows: list, schema: Any) -> InputDataset:
    return InputDataset("", "memory", [], spark.createDataFrame(rows, schema))


def read_json(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """A metadata document; None where there is none."""
    fs, p = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def read_plan(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    return read_json(spark, f"{folder}/_partition_plan.json")


def read_manifest(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    return read_json(spark, f"{folder}/_manifest.json")


def data_path(folder: str, manifest: dict[str, Any] | None) -> str:
    """Where the data of a prepared dataset are: the input itself if that was reused."""
    if manifest and manifest.get("input_reused"):
        return manifest.get("dataset_location") or folder
    return folder


def read_prepared(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(data_path(folder, read_manifest(spark, folder)))


def join_right_side(frame: DataFrame, keys: list[str], payload: str | None = "join_payload") -> DataFrame:
    """The keys once each, with their hash as payload: the right side of the join workload."""
    from pyspark.sql import functions as F

    own = frame.select(*keys).dropDuplicates(keys)
    return own.withColumn(payload, F.xxhash64(*keys)) if payload else own


def read_tasks(spark: SparkSession, path: str) -> list[dict[str, Any]]:
    """Benchmark tasks: a JSON list, or an object that holds one under `tasks`."""
    raw = read_json(spark, path)
    tasks = raw.get("tasks") if isinstance(raw, dict) else raw
    if not isinstance(tasks, list):
        raise ValueError("tasks must be a list, or an object with a list under 'tasks'")
    for t in tasks:
        missing = [k for k in ("original", "preprocessed", "workload") if not t.get(k)]
        if missing:
            raise ValueError(f"task without {', '.join(missing)}")
        for k in ("original", "preprocessed"):
            if not exists(spark, t[k]):
                raise InputPathNotFound(t[k])
    return tasks
