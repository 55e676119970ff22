"""Small helpers around Arrow batches and stored steps."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import relata
from relata import session

# What a step is run with: shuffle files go when it ends, and texts travel to Python in batches that
# stay small beside an executor's memory, as several tasks hold some at both ends at a time.
STEP = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as they may not have it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(relata.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="relata-code-")) / "relata.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(root.rglob("*.py")):
            packed.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


Batches = Iterator[pa.RecordBatch]


def map_all(df: DataFrame, run: Callable[[Batches], Batches], schema: str) -> DataFrame:
    """``df`` through ``run``, which gets all Arrow batches of a task."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(
    df: DataFrame, step: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """Each Arrow batch of ``df`` through ``step``, which may give any number of batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)

    return map_all(df, run, schema)


def _under(spark: SparkSession, settings: dict[str, str], store: Callable[[], DataFrame]) -> DataFrame:
    conf = spark.conf
    before = {name: conf.get(name) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        return store()
    finally:
        for name, value in before.items():
            conf.set(name, value)


def settle(df: DataFrame, label: str) -> DataFrame:
    """``session.settle`` under ``STEP``.

    The stored table takes the place of the shuffle files, so disk use follows the largest step and
    not the sum.
    """
    return _under(df.sparkSession, STEP, lambda: session.settle(df, label))


def settle_by(df: DataFrame, column: str, label: str) -> DataFrame:
    """``session.settle_bucketed`` under ``STEP``: ``df`` is dealt out by ``column`` once, and joins on
    that column alone move the other side only.

    The shuffle files lie beside the table until it is written, so the table is packed closer.
    """
    number = session.buckets(df.sparkSession)
    dealt = df.repartition(number, column)
    return _under(
        df.sparkSession,
        {**STEP, "spark.sql.parquet.compression.codec": "zstd"},
        lambda: session.settle_bucketed(dealt, [column], [column], label, number),
    )
