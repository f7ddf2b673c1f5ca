"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once an application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    if top.is_dir():  # not when the driver itself runs from a shipped archive
        folder = tempfile.mkdtemp(prefix="evenkeel-")
        path = os.path.join(folder, "evenkeel.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f"{top.name}/{f.relative_to(top)}")
        context.addPyFile(path)
    _shipped.add(context.applicationId)


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A new folder's path in spark.checkpoint.dir, which driver and executors share; a local one only for local masters."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), f"evenkeel-{os.getuid()}-{os.getpid()}")
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def session(master: str | None = None, shuffle_partitions: int | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session in UTC with adaptive execution.

    The master is the one given; else, under spark-submit, the one it names; else all cores of this
    machine. `conf` comes last and wins. Shuffle partitions stay as configured unless given.
    """
    builder = SparkSession.builder.appName("evenkeel").config("spark.sql.session.timeZone", "UTC")
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:  # spark-submit sets this variable for its Python driver
        builder = builder.master(master or "local[*]")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for one machine, without user interface."""
    quiet = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    return session(f"local[{cores}]", shuffle_partitions, quiet | {k.replace("__", "."): v for k, v in conf.items()})


#: Spark settings under which layouts are compared without help from adaptive execution.
ISOLATED = {
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "200",
    "spark.sql.parquet.enableVectorizedReader": "false",
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
}
