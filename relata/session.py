"""Session settings and the shared folder used to cut lineage or to write tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str, name: str = "relata", **extra: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors can read, named by ``spark.checkpoint.dir``.

    Where the setting is absent, a local run gets a folder of its own. A cluster does not: a
    folder on one machine is lost with it.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="relata-")
        context.setCheckpointDir(folder)
    return folder


def run_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/relata-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path inside the shared folder that no earlier run has used."""
    return f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str = "step") -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The stored rows do not change when an executor is lost, so partition and row numbers taken
    before the write hold in every later stage. Later stages read only the columns they need, and
    the optimizer knows the table's size when it decides on a broadcast.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def settle_bucketed(
    df: DataFrame, by: Sequence[str], sort: Sequence[str], label: str, number: int | None = None
) -> DataFrame:
    """``settle`` into files by the hash of ``by``, sorted inside.

    Joins, windows and roll-ups whose keys hold ``by`` read it without a shuffle. ``df`` should lie in
    partitions by the same hash and ``number``, so that each bucket is one file: all rows of a key
    are one task's, there and here.
    """
    spark = df.sparkSession
    name = f"relata_{label}_{uuid.uuid4().hex}".replace("-", "_")
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists").bucketBy(number or buckets(spark), *by).sortBy(*sort)
    writer.option("path", path).saveAsTable(name, format="parquet")
    return spark.table(name)


_relations: dict[tuple, DataFrame] = {}


def once(spark: SparkSession, name: str, inputs: Sequence[str], build: Callable[[], DataFrame]) -> DataFrame:
    """The relation ``name`` over the files ``inputs``, built on first use in this application.

    It is built again when an input has changed.
    """
    state = []
    for each in inputs:
        path, system = _file_system(spark, each)
        state.append((each, system.getFileStatus(path).getModificationTime(),
                      system.getContentSummary(path).getLength()))
    key = (run_folder(spark), name, buckets(spark), *state)
    if key not in _relations:
        _relations[key] = build()
    return _relations[key]


def clear(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder."""
    folder = run_folder(spark)
    path, system = _file_system(spark, folder)
    system.delete(path, True)
    for key in [k for k in _relations if k[0] == folder]:
        del _relations[key]
