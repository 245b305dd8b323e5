"""Near-duplicate embeddings by random-hyperplane hashing in several tables (operator 1).

In each table a vector's key is the signs of its products with random hyperplanes; vectors of one
label that share a key are compared exactly, by cosine in double precision, and a pair is counted in
the first table where it meets. Components come from the distributed stars of ``common``.

Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or
null id, link with nothing; so do vectors of different length. Equal vectors of a label are one node
with a weight. Large buckets are dealt out by pairs of blocks, each compared by one matrix product;
a task gives one row per vector, not the pairs. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import connected_components, materialize, sorted_groups, trimmed

#: Keys have one bit more per doubling of the different vectors, so that a bucket holds about BUCKET of them
#: however many there are; BITS at least, and 30 at most, as a key is an int.
BITS, BUCKET, BLOCK = 12, 16, 1024
#: Share of the pairs at the threshold that may meet in no table.
MISSED = 0.0003


def key_bits(n: int) -> int:
    """Bits of a key for ``n`` different vectors."""
    return min(max(BITS, math.ceil(math.log2(max(n, 1) / BUCKET))), 30)


def table_count(threshold: float, bits: int) -> int:
    """Tables needed: a pair at the threshold agrees in a plane's sign with p (0.880 at 0.93), so all tables
    miss it with (1 - p ** bits) ** tables, which MISSED bounds."""
    p = 1 - math.acos(threshold) / math.pi
    return math.ceil(math.log(MISSED) / math.log1p(-(p**bits)))


def planes(dim: int, tables: int, bits: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, tables * bits))


def signatures(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    signs = (x @ planes(x.shape[1], tables, bits) > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _star(mask: np.ndarray) -> np.ndarray:
    """For a symmetric boolean matrix the least index of each row's component."""
    root = np.arange(len(mask))
    while True:
        new = np.minimum(root, np.where(mask, root[None, :], len(mask)).min(axis=1, initial=len(mask)))
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link_counts(nodes: DataFrame, threshold: float, tables: int, bits: int, block: int) -> DataFrame:
    """nodes: node long, label, vector array<float>, weight long. Rows (node, n, peer): the weight of
    newly met partners, and a node of the same component to link with."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1)
            size = vectors.value_lengths().to_numpy()
            sig = np.zeros((batch.num_rows, tables), np.int32)
            for d in np.unique(size):
                where = np.flatnonzero(size == d)
                x = vectors.take(pa.array(where)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                sig[where] = signatures(x / np.abs(x).max(axis=1, keepdims=True), tables, bits)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel()), tables).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat], ["node", "sig"])

    signed = materialize(nodes.select("node", "vector").mapInArrow(trimmed(sign), "node long, sig array<int>").join(nodes, "node"), "signatures")
    light = signed.select("node", "label", F.size("vector").alias("dim"), F.posexplode("sig").alias("t", "key"))
    sizes = light.groupBy("label", "dim", "t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # only keys that vectors share are worth moving a vector for
    shared = light.join(sizes, ["label", "dim", "t", "key"]).groupBy("node").agg(F.collect_list(F.struct("t", "key", F.ceil(F.col("n") / block).alias("blocks"))).alias("at"))
    spread = signed.join(shared, "node").select("node", "label", "vector", "weight", "sig", F.explode("at").alias("at"))
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("node", "at.t"), F.col("at.blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("at.blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    spread = spread.select(
        F.xxhash64("label", F.size("vector"), "at.t", "at.key", low, high).alias("g"),
        "node",
        F.hash("label").alias("label"),
        "vector",
        "weight",
        "sig",
        F.col("at.t").alias("t"),
        (F.col("mine") == high).alias("right"),
        (F.col("mine") == low).alias("left"),
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "g"):
            g, node, label, weight, t = (table.column(c).to_numpy() for c in ("g", "node", "label", "weight", "t"))
            left, right = (table.column(c).to_numpy() for c in ("left", "right"))
            sig = np.array(table.column("sig").combine_chunks().flatten().to_numpy()).reshape(len(g), -1)
            vectors = table.column("vector").combine_chunks()
            dims = vectors.value_lengths().to_numpy()
            begin = np.concatenate([[0], np.cumsum(dims)])
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            cut = np.flatnonzero(np.diff(g)) + 1
            out: list[tuple[np.ndarray, ...]] = []
            for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(g)]])):
                if b - a < 2 or dims[a:b].min() != dims[a:b].max():
                    continue
                x = flat[begin[a] : begin[b]].reshape(b - a, -1)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
                across = (left[a:b][:, None] & right[a:b][None, :]) | (right[a:b][:, None] & left[a:b][None, :])
                mask = (x @ x.T >= threshold) & across & (label[a:b][:, None] == label[a:b][None, :])
                np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                first = t[a]
                s = sig[a:b, :first]
                if first:
                    for i in np.flatnonzero(mask.any(axis=1)):
                        js = np.flatnonzero(mask[i])
                        mask[i, js[(s[i] == s[js]).any(axis=1)]] = False
                    if not mask.any():
                        continue
                hit = mask.any(axis=1)
                out.append((node[a:b][hit], (mask @ weight[a:b])[hit], node[a:b][_star(mask)][hit]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["node", "n", "peer"])

    return spread.repartition("g").sortWithinPartitions("g").mapInArrow(trimmed(compare), "node long, n long, peer long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, tables: int | None = None, bits: int | None = None, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """One row per vector: id, n_links, component_id (its own id if it has no link), kept. ``bits`` follow from
    the number of different vectors and ``tables`` from bits and threshold, unless they are given."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fit = F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(fit, F.transform("vector", lambda x: x + F.lit(0.0).cast("float"))))
    nodes = materialize(rows.where("vector is not null").groupBy("label", "vector").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("weight")), "nodes")
    bits = bits or key_bits(nodes.count())
    tables = tables or table_count(threshold, bits)
    found = materialize(link_counts(nodes, threshold, tables, bits, block), "links")
    same = nodes.join(rows.where("vector is not null"), ["label", "vector"]).where("id <> node").select(F.col("id").alias("node"), F.col("node").alias("peer"))
    component = connected_components(found.select("node", "peer").where("node <> peer").union(same))
    counts = nodes.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").select("label", "vector", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = rows.join(counts, ["label", "vector"], "left").join(component, F.col("id") == F.col("node"), "left")
    n, least = F.coalesce("n_links", F.lit(0)).cast("long"), F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), n.alias("n_links"), least.alias("component_id"), F.coalesce(F.col("id") == least, F.lit(False)).alias("kept"))
