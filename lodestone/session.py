"""Session construction and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, app: str = "lodestone", partitions: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster pass your own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs in local mode (tests), a
    temporary folder of this machine takes its place; on a cluster that is an
    error, as each executor would write to its own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly where an input has fewer partitions than there are cores; others stay as they are.

    For steps that spend far more on a row than moving it costs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows and bytes in an Arrow batch: some texts have 100 kB, so batches stay small.
ARROW_ROWS = 512
ARROW_BYTES = 8 << 20


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over small batches, on both sides of the pipe.

    The session's batch limits are lowered to ``ARROW_ROWS`` and
    ``ARROW_BYTES`` where they are higher: buffers of whole partitions would
    count twice in every executor.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= ARROW_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return df.mapInArrow(fn, schema)


_written: list[tuple[SparkSession, str, str | None]] = []


def materialise(df: DataFrame, name: str, bucket: str | None = None, buckets: int = 0) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    With ``bucket`` the table is dealt into ``buckets`` by that column, so that
    groups by it need no further shuffle. The table survives the loss of any
    executor. It is removed by ``release``, at the latest when the driver
    program ends.
    """
    spark = df.sparkSession
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{own}"
    if bucket is None:
        df.write.parquet(path)
        out, table = spark.read.schema(df.schema).parquet(path), None
    else:
        table = own.replace("-", "_")
        df.write.bucketBy(buckets, bucket).option("path", path).format("parquet").saveAsTable(table)
        out = spark.table(table)
    out.written_at = path
    _written.append((spark, path, table))
    return out


def release(*which: DataFrame) -> None:
    """Remove tables that ``materialise`` wrote: those it returned as ``which``, or all."""
    keep, paths = [], {df.written_at for df in which}
    for spark, path, table in _written:
        if which and path not in paths:
            keep.append((spark, path, table))
            continue
        try:
            jvm = spark.sparkContext._jvm
            if table:
                spark.sql(f"drop table if exists {table}")
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: nothing is left to remove it with
            pass
    _written[:] = keep


atexit.register(release)
