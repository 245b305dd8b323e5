"""Shared plumbing of the corpus operators: scratch tables, text buffers and connected components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.scratch import discard, materialize, shared_dir
from logloom.ship import ship

__all__ = ["discard", "materialize", "shared_dir"]

#: Rows that a Python operator holds at once while it turns results into Arrow batches.
OUT_ROWS = 50_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def trimmed(run: Callable) -> Callable:
    """``run`` for mapInArrow, with what its task has freed given back to the system at its end: workers
    live on, and the allocators would keep it beside the next operator's memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return whole


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a string or binary column: all bytes as one buffer and n + 1 offsets (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sorted_groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[pa.Table]:
    """Runs of equal ``key`` of batches that come sorted by it, several whole runs to a table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node of each one's component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) of each batch replaced by a star for each of its components."""
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes, roots = _roots(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        keep = nodes != roots
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Component of every node of ``edges`` (two long columns): (node, component), the smallest node.

    Alternating large and small stars over pre-contracted edges. Each half round is a map-side
    combined minimum and an equi-join that may be split when a star's centre is hot, and is written
    to the shared folder. No edge, node or component reaches the driver, only counts and checksums.
    """
    a, b = edges.columns[:2]
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    now = materialize(pairs.mapInArrow(trimmed(contract), "a long, b long").distinct(), "stars")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = state(now)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = now.union(now.select("b", "a"))
        # a table of its own, so that the join with it can be split where a star's centre is hot
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
        large = both.join(least, F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        mid = materialize(large, "stars")
        down = mid.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = materialize(down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "least")
        small = (
            down.join(lowest, F.col("a") == F.col("u"))
            .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.a", "e.b")
            .where("a <> b")
            .distinct()
        )
        new = materialize(small, "stars")
        for done in (now, mid, least, lowest):
            discard(done)
        now, after = new, state(new)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b"), F.col("b")).distinct())
