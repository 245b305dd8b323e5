"""SimHash near-duplicates by pigeonring filtering (operator 9).

A fingerprint has 64 bits, each the majority of that bit over the hashes of the text's shingles,
repeats included. Two fingerprints that differ in at most ``tau`` bits, cut into a ring of m = tau + 1
segments, have a segment from which every chain of l segments differs in at most l * tau / m bits. So
the segment is equal and with the next one differs in one bit at most: fingerprints meet on the key
(segment, its bits, the next segment's bits with at most one flipped), where longer chains are
tested before the full Hamming distance.

Equal fingerprints are one node, so copies cost nothing. Within a key only the links of a spanning
forest leave a task; keys with very many fingerprints are dealt out by pairs of blocks. Null and
empty texts and texts of white space have the fingerprint zero, which links like any other.
Rows whose id is null get a fingerprint and the component of their group (null if all ids are).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import byte_slices, connected_components, materialize, partitions, sorted_groups, trimmed

#: Hashes that are counted at once.
CHUNK = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_joined(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with one blank between words, and where each word starts and ends."""
    blank = _BLANK[data]
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    out = _LOWER[data[keep]]
    gap = blank[keep]
    out[gap] = 0x20
    edge = np.diff(np.concatenate([[1], gap.view(np.int8), [1]]))
    return out, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def shingle_hashes(data: np.ndarray, size: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles in order, in blocks; of the whole sequence if it has fewer words."""
    flat, starts, ends = words_joined(data)
    if not len(starts):
        return
    step = min(size, len(starts))
    raw, digest = flat.tobytes(), xxhash.xxh64_digest
    first, last = starts[: len(starts) - step + 1].tolist(), ends[step - 1 :].tolist()
    for at in range(0, len(first), CHUNK):
        yield np.frombuffer(b"".join([digest(raw[a:b], seed) for a, b in zip(first[at : at + CHUNK], last[at : at + CHUNK])]), np.uint8)


def fingerprint(data: np.ndarray, size: int = 4, seed: int = 42) -> int:
    counts, n = np.zeros(64, np.int64), 0
    for block in shingle_hashes(data, size, seed):
        rows = block.reshape(-1, 8)
        n += len(rows)
        for at in range(0, len(rows), 1 << 14):
            counts += np.unpackbits(rows[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, row (xxhash64 of the text) and fp, the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_slices(batch.column(2))
            found = [fingerprint(data[at[i] : at[i + 1]], size, seed) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(found, np.uint64).view(np.int64))], ["id", "row", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), F.col(text_col).cast("binary").alias("text")).mapInArrow(trimmed(run), f"id {kind}, row long, fp long")


class Ring:
    """The ring of segments for a threshold, and its keys."""

    def __init__(self, tau: int, bits: int = 64):
        self.tau, self.m = tau, tau + 1
        cut = [round(i * bits / self.m) for i in range(self.m + 1)]
        self.at, self.width = cut[:-1], np.diff(cut).tolist()
        self.mask = [np.uint64(((1 << w) - 1) << a) for a, w in zip(self.at, self.width)]
        self.budget = [(i + 1) * tau // self.m for i in range(self.m)]

    def segment(self, fp: np.ndarray, i: int) -> np.ndarray:
        i %= self.m
        return (fp >> np.uint64(self.at[i])) & np.uint64((1 << self.width[i]) - 1)

    def keys(self, fp: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """Keys of the fingerprints, and whether the next segment has a bit flipped in them."""
        for i in range(self.m):
            base = np.uint64(i << 56) | self.segment(fp, i) << np.uint64(28) | self.segment(fp, i + 1)
            yield base, False
            if self.budget[1] >= 1:
                for b in range(self.width[(i + 1) % self.m]):
                    yield base ^ np.uint64(1 << b), True

    def near(self, x: np.uint64, others: np.ndarray, i: int) -> np.ndarray:
        """Which of ``others`` pass every chain from segment i and then the full distance."""
        diff = others ^ x
        found = np.arange(len(others))
        total = np.zeros(len(others), np.int64)
        for l, most in enumerate(self.budget):
            total = total + np.bitwise_count(diff & self.mask[(i + l) % self.m])
            ok = total <= most
            diff, found, total = diff[ok], found[ok], total[ok]
            if not len(found):
                return found
        return found[np.bitwise_count(diff) <= self.tau]


def forest(fps: np.ndarray, ring: Ring, i: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of distinct fingerprints that share a key of segment i.

    Breadth first: a fingerprint that was reached leaves the rest, so a dense group costs its size."""
    out: list[tuple[int, int]] = []
    rest = fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = ring.near(x, rest, i)
            if len(hit):
                out += [(int(y), int(x)) for y in rest[hit]]
                queue += list(rest[hit])
                rest = np.delete(rest, hit)
    return out


def links(distinct: DataFrame, tau: int = 4, block: int = 20_000) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect all within ``tau`` bits."""
    ring = Ring(tau)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for key, flipped in ring.keys(fp):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(len(fp), flipped))], ["key", "fp", "flipped"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "g"):
            g, fp, key = (table.column(c).to_numpy() for c in ("g", "fp", "key"))
            whole = table.column("whole").to_numpy()
            cut = np.flatnonzero(np.diff(g)) + 1
            start, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(g)]])
            worth = (stop - start > 1) & (np.add.reduceat(whole, start) > 0)
            out: list[tuple[int, int]] = []
            for a, b in zip(start[worth], stop[worth]):
                out += forest(np.unique(fp[a:b].view(np.uint64)), ring, int(key[a].view(np.uint64) >> np.uint64(56)))
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    # each row becomes many, so rows that fit one task are dealt out first; by another expression than the
    # fingerprints came by, as Spark drops an exchange that repeats one, and joins small partitions of the first
    dealt = distinct.select("fp").repartition(partitions(distinct.sparkSession), F.xxhash64("fp"))
    spread_out = dealt.mapInArrow(trimmed(spread), "key long, fp long, flipped boolean").withColumn("whole", (~F.col("flipped")).cast("long")).drop("flipped")
    sizes = spread_out.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    large = materialize(sizes.select("key", F.ceil(F.col("n") / (block // 2)).alias("blocks")), "hotkeys")
    rows = spread_out.withColumn("g", F.col("key"))
    if large.head(1):
        # a hot key's rows go to every pair of its blocks, so all its pairs still meet
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        rows = spread_out.join(large, "key", "left").withColumn("mine", mine).withColumn("other", other)
        rows = rows.withColumn("g", F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))).drop("blocks", "mine", "other")
    return rows.repartition("g").sortWithinPartitions("g", "key").mapInArrow(trimmed(join), "a long, b long")


def near_duplicates(docs: DataFrame, tau: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, fp (long) and component_id, the smallest id reachable over links; also row
    (xxhash64 of the text) and group, a number that rows share if links join them, whatever their ids."""
    prints = materialize(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    component = connected_components(links(distinct.select("fp"), tau))
    member = distinct.join(component.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("component"))
    smallest = member.groupBy("component").agg(F.min("least_id").alias("component_id"))
    classes = member.select("fp", "component").join(smallest, "component").select("fp", "component_id", F.col("component").alias("group"))
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id", "row", "group")


def one_row(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``docs`` of each group, with all columns: the smallest id's (null after all), then the
    smallest text hash's. ``groups``: id, row (xxhash64 of the text) and group of every row of ``docs``."""
    at = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("at")
    # a table of its own, so that the join with it can be split where a group is hot
    first = materialize(groups.groupBy("group").agg(at), "first")
    here = F.col("id").eqNullSafe(F.col("at.id")) & (F.col("row") == F.col("at.row"))
    placed = groups.join(first, "group").select(F.col("id").alias("id_"), F.col("row").alias("row_"), here.alias("here_"))
    placed = materialize(placed.groupBy("id_", "row_", "here_").agg(F.count(F.lit(1)).alias("n_")).where("not here_ or n_ > 1"), "placed")

    def same(df: DataFrame, other: DataFrame) -> Column:
        return df[id_col].eqNullSafe(other["id_"]) & (F.xxhash64(df[text_col]) == other["row_"])

    # those that go are the smaller part, often small enough to be sent to the texts
    gone, again = placed.where("not here_").select("id_", "row_"), placed.where("here_").select("id_", "row_")
    kept = docs.join(gone, same(docs, gone), "left_anti")
    if not again.head(1):
        return kept
    once, more = kept.join(again, same(kept, again), "left_anti"), kept.join(again, same(kept, again), "left_semi")
    return once.union(more.dropDuplicates([id_col, text_col]))


def one_of_each(docs: DataFrame, tau: int = 4, size: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group, with all columns: that of the smallest id (null after all)."""
    groups = materialize(near_duplicates(docs, tau, size, seed, id_col, text_col), "groups")
    return one_row(docs, groups.select(F.col(id_col).alias("id"), "row", "group"), id_col, text_col)
