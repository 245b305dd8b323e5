"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or (local runs and tests, where it is unset) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='logloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables written since the innermost ``swept`` of this thread began.
_sweep: ContextVar[list[DataFrame] | None] = ContextVar("sweep", default=None)


#: Makes Spark delete an execution's shuffle files at its end, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
#: By session: writes that are under way, and the setting before the first of them.
_writing: dict[str, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Only for writes: their plans run once, where those of a caller's DataFrame may run again and would
    then make deleted files anew."""
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        n, before = _writing.get(session) or (0, spark.conf.get(CLEANUP, None))
        _writing[session] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _writing.pop(session)
            if n > 1:
                _writing[session] = n - 1, before
            elif before is None:
                spark.conf.unset(CLEANUP)
            else:
                spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a table of its own in the shared folder and read it back: lineage is cut,
    a lost executor costs a reread, the plan above sees real sizes, and what was shuffled for it goes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logloom/{label}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    written = _sweep.get()
    if written is not None:
        written.append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of ``materialize`` that nothing reads any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def swept() -> Iterator[list[DataFrame]]:
    """Deletes the tables that its thread writes within it at its end, but for those put into the list it
    gives; these belong to a sweep around it, if there is one."""
    kept: list[DataFrame] = []
    written: list[DataFrame] = []
    token = _sweep.set(written)
    try:
        yield kept
    finally:
        _sweep.reset(token)
        outer = _sweep.get()
        if outer is not None:
            outer.extend(kept)
        for table in written:
            if not any(table is x for x in kept):
                discard(table)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df``, dealt out by the columns ``by`` if it comes in fewer partitions than tasks can run at once, as
    a small file does: expressions that cost much more than moving a row then use every core. Inputs of
    many partitions stay as they are."""
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks, *by) if df.rdd.getNumPartitions() < tasks else df
