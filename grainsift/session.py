"""Session helpers: a configured local session and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("grainsift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # quicker plan building
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    name_local_folder(session)
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return configured


def name_local_folder(spark: SparkSession) -> None:
    """Name a temporary folder where a session of one machine has none set, as in tests.

    On a cluster nothing is set: such a folder would be lost with its machine.
    """
    master = spark.sparkContext.master
    one_machine = master.startswith("local") and not master.startswith("local-cluster")
    if one_machine and not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="grainsift-"))


_MADE: list[str] = []  # work folders named by this driver, oldest first


def new_work_dir(spark: SparkSession, label: str) -> str:
    """A fresh, unused folder below the shared one."""
    _MADE.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _MADE[-1]


def work_folders() -> list[str]:
    """The work folders named so far; what is beyond an earlier length was made since then."""
    return list(_MADE)


def delete_folders(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete work folders that no table still in use is read from; only ones named by this driver."""
    for path in paths:
        if path in _MADE:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
            _MADE.remove(path)


def materialized(df: DataFrame, label: str = "table") -> DataFrame:
    """The table written once to the shared folder and read back.

    Cuts the lineage before a table is used several times; later reads fetch only
    the columns they need. The folder stays until :func:`delete_folders` is given it.
    """
    path = new_work_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
