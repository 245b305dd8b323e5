"""Near copies by Jaccard similarity of word shingles (the pipeline's near-duplicate stage).

Two texts are linked if their sets of ``size``-word shingles have a Jaccard similarity of ``similarity``
or more. Candidates come from SimHash pigeonring (fingerprints within a few bits) and from MinHash bands,
which also find the pairs whose fingerprints lie further apart than a ring can be selective for: with 40
bands of 7 rows a pair at 0.8 meets with probability 0.9999. Candidates only join groups; within a group
the shingle sets themselves decide, so every link is exact.

Texts of the same words are one node. Texts without words are one node that nothing else links to.
Texts are merged with the chosen ids at every size, as these grow with the corpus: a broadcast would only
hide that join on small inputs. Shingle sets move once, and only those of texts in a group; groups of very many shingles are dealt out
by pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm import simhash
from logloom.llm.common import byte_slices, connected_components, materialize, sorted_groups, trimmed

BANDS, ROWS = 40, 7
#: Shingles of a text that are hashed at once, and shingles of a group from which it is dealt out.
CHUNK, BLOCK = 1 << 10, 2_000_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_MIX = np.random.default_rng(12).integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) << np.uint64(1) | np.uint64(1)


def shingle_set(data: np.ndarray, size: int, seed: int = 42) -> np.ndarray:
    """Distinct shingle hashes in order."""
    blocks = [b.view(np.uint64) for b in simhash.shingle_hashes(data, size, seed)]
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of MinHash rows; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), CHUNK):
        np.minimum(least, (shingles[at : at + CHUNK, None] * _ODD).min(axis=0), out=least)
    key = ((least.reshape(BANDS, ROWS) >> np.uint64(7)) * _MIX).sum(axis=1, dtype=np.uint64)
    return (key ^ key >> np.uint64(29)).view(np.int64)


def signatures(docs: DataFrame, size: int, seed: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, row (hash of its text), node (of its words), fp, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_slices(batch.column(2))
            nodes, prints, keys = [], [], []
            for i in range(batch.num_rows):
                text = data[at[i] : at[i + 1]]
                flat, starts, ends = simhash.words_joined(text)
                nodes.append(xxhash.xxh64_intdigest(flat[starts[0] : ends[-1]].tobytes() if len(starts) else b"", seed))
                prints.append(simhash.fingerprint(text, size, seed))
                keys.append(band_keys(shingle_set(text, size, seed)))
            offsets = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            whole = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *whole, lists], ["id", "row", "node", "fp", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(trimmed(run), f"id {kind}, row long, node long, fp long, keys array<long>")


def candidates(nodes: DataFrame, tau: int) -> DataFrame:
    """(a, b): links between ``nodes`` (node, fp, keys) that connect all that may be near copies."""
    each = nodes.select("node", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most")
    # a table of its own, so that the join with it can be split where a key is hot
    shared = materialize(shared.select("key", "least"), "bands")
    banded = each.join(shared, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    worded = nodes.where(F.size("keys") > 0)
    first = materialize(worded.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    same = worded.join(first, "fp").where("node <> least").select("node", "least")
    ring = simhash.links(first.select("fp"), tau)
    ring = ring.join(first.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    return materialize(banded.union(same).union(ring), "candidates")


def forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links of a spanning forest, as positions, of the sets linked by their Jaccard similarity.

    Breadth first: a set that was reached leaves the rest, so a dense group costs its size."""
    sizes = np.array([len(s) for s in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate([[0], np.cumsum(sizes)])
    mark = np.zeros(flat.max() + 1, bool)
    out: list[tuple[int, int]] = []
    rest, left = np.arange(len(sets)), flat
    while len(rest) > 1:
        queue, rest, left = [rest[0]], rest[1:], left[sizes[rest[0]] :]
        while queue and len(rest):
            x = queue.pop()
            mine = flat[at[x] : at[x + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[left], np.concatenate([[0], np.cumsum(sizes[rest])[:-1]]), dtype=np.int64)
            mark[mine] = False
            hit = both >= similarity * (sizes[x] + sizes[rest] - both) - 1e-9
            if hit.any():
                out += [(int(y), int(x)) for y in rest[hit]]
                queue += list(rest[hit])
                left, rest = left[np.repeat(~hit, sizes[rest])], rest[~hit]
    return out


def verified(texts: DataFrame, size: int, seed: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links between nodes of ``texts`` (node, component, text binary) that connect all near
    copies within a component."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_slices(batch.column(2))
            sets = [shingle_set(data[at[i] : at[i + 1]], size, seed) for i in range(batch.num_rows)]
            raw = pa.array([s.tobytes() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw, pa.array([len(s) for s in sets], pa.int64())], ["node", "component", "shingles", "n"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "g"):
            g, node = table.column("g").to_numpy(), table.column("node").to_numpy()
            edge = np.flatnonzero(np.diff(g)) + 1
            out: list[tuple[int, int]] = []
            for a, b in zip([0, *edge], [*edge, len(g)]):
                kept = a + np.unique(node[a:b], return_index=True)[1]
                if len(kept) > 1:
                    sets = [np.frombuffer(table.column("shingles")[int(i)].as_buffer(), np.uint64) for i in kept]
                    out += [(node[kept[x]], node[kept[y]]) for x, y in forest(sets, similarity)]
            if out:
                pairs = np.array(out, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    sets = materialize(texts.select("node", "component", "text").mapInArrow(trimmed(cut), "node long, component long, shingles binary, n long"), "shingles")
    sizes = sets.groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > block)
    large = materialize(sizes.select("component", F.ceil(F.col("n") / (block // 2)).alias("blocks")), "hotgroups")
    rows = sets.withColumn("g", F.col("component"))
    if large.head(1):
        # a hot group's rows go to every pair of its blocks, so all its pairs still meet
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = sets.join(large, "component", "left").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", other)
        rows = rows.withColumn("g", F.when(F.col("blocks").isNull(), F.col("component")).otherwise(F.xxhash64("component", F.least("mine", "other"), F.greatest("mine", "other"))))
    return rows.select("g", "node", "shingles").repartition("g").sortWithinPartitions("g", "node").mapInArrow(trimmed(join), "a long, b long")


def near_copies(docs: DataFrame, similarity: float = 0.8, size: int = 5, tau: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, row (hash of its text) and group, the same for all that links join."""
    rows = materialize(signatures(docs, size, seed, id_col, text_col), "signatures")
    nodes = materialize(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.min(F.struct("id", "row")).alias("at")), "nodes")
    grouped = connected_components(candidates(nodes, tau))
    chosen = materialize(nodes.join(grouped, "node").select("node", "component", F.col("at.id").alias("at_id"), F.col("at.row").alias("at_row")), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.join(chosen.hint("merge"), F.col("id").eqNullSafe(F.col("at_id")) & (F.col("row") == F.col("at_row")))
    # a table of its own: with the first step of the components in the same task, each task would hold two workers,
    # and all of an executor's workers stay for the stages after this one
    linked = connected_components(materialize(verified(texts, size, seed, similarity), "links"))
    return rows.select("id", "row", "node").join(linked, "node", "left").select("id", "row", F.coalesce("component", "node").alias("group"))


def one_of_each(docs: DataFrame, similarity: float = 0.8, size: int = 5, tau: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near copies, with all columns: that of the smallest id."""
    groups = materialize(near_copies(docs, similarity, size, tau, seed, id_col, text_col), "groups")
    return simhash.one_row(docs, groups, id_col, text_col)
