"""Katz backoff language model over words (operator 7).

Order two: P(w | h) is the Good-Turing discounted share of the pair if training has it, and otherwise
alpha(h) times the discounted share of w, where alpha gives exactly the mass that the discounts freed:
(1 - sum of seen P(w | h)) / (1 - sum of P(w) over the words seen after h). Words that training lacks
are one class with the mass that unigram discounts free; a context that training lacks has alpha 1.
Counts up to ``K`` are discounted by Good-Turing, larger ones by a constant so small that every context
keeps some mass; where counts of counts are too few, absolute discounting stands in.

Counts are whole-corpus tables in partitions. Texts are gathered in blocks (a table in the shared
folder). Each block sends its distinct words with counts to the partition of their hash range and gets
back, for each, a number and the corpus count. It then sends its pairs, summed by document, to the
slice of the context; contexts with a large share of all tokens are dealt out by pair, and their
alphas are put together from partial sums. There are as many slices as the counted bytes of text ask for,
so that what a task holds doesn't grow with the corpus. Every partition scores the pairs it holds by recursion
(pair, else alpha and word) and sends sums per document back to the block. Payloads are packed columns.

Null and empty texts have the end token alone. Null ids are never held out. Repeated rows count each.
An empty table gives no rows; without training text every token is unknown and scores log10(1) = 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import byte_slices, materialize, partitions, sorted_groups, trimmed
from logloom.llm.simhash import words_joined

#: Counts up to this one are discounted by Good-Turing.
K = 5
#: What larger counts give up, and the discount where counts of counts don't suffice.
SMALL, ABSOLUTE = 0.01, 0.5
#: Bytes of text in a block; a longer text is a block by itself.
BLOCK = 8 << 20
#: Bytes of text that are cut into words at once.
CHUNK = 1 << 20
#: Slices of a table for each shuffle partition, at least.
SLICES = 4
#: Bytes of text whose words, and whose pairs, make up a slice at most.
WORD_SLICE, PAIR_SLICE = 256 << 20, 16 << 20
END = np.uint64(2**64 - 1)
_TABLE = np.random.default_rng(20).integers(0, 2**63, (64, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hash of each word (64 bytes at a time, chained)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    begin = np.concatenate([[0], starts]).astype(np.int32)
    where = np.arange(len(flat), dtype=np.int32) - np.repeat(begin, np.diff(np.append(begin, len(flat))))
    value = _TABLE[where & 63, flat]
    long = where >= 64
    if long.any():
        value[long] *= (where[long] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value, dtype=np.uint64)])
    h = sums[ends] - sums[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return np.minimum(h, END - np.uint64(1))


def packed(x: np.ndarray) -> bytes:
    """Numbers as compressed byte planes."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def packed_sorted(x: np.ndarray) -> bytes:
    return packed(np.diff(x, prepend=x.dtype.type(0)))


def unpacked_sorted(data: bytes, kind: str) -> np.ndarray:
    return np.cumsum(unpacked(data, kind), dtype=kind)


def discounts(n: list[int]) -> np.ndarray:
    """d_0 .. d_K from n, the numbers of things seen once, twice, ... K + 1 times."""
    out = np.zeros(K + 1)
    top = (K + 1) * n[K] / n[0] if n[0] else 1.0
    for r in range(1, K + 1):
        d = (((r + 1) * n[r] / n[r - 1]) / r - top) / (1 - top) if n[r - 1] and top < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - ABSOLUTE) / r
    return out


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts less what their discounts take."""
    count = np.asarray(count, np.float64)
    return np.where(count <= K, d[np.minimum(count, K).astype(np.int64)] * count, count - SMALL)


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c[c > 0], K + 2), minlength=K + 3)[1 : K + 2].tolist()


class Unigrams:
    """Shares of single words from corpus totals; all that a task needs beside its words' counts."""

    def __init__(self, tokens: int, types: int, n: list[int]):
        self.tokens, self.types, self.d = tokens, types, discounts(n)
        small = sum((r + 1) * n[r] for r in range(K))
        freed = sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, K + 1)) + SMALL * (types - sum(n[:K]) if tokens > small else 0)
        self.unknown = freed / tokens if tokens else 1.0

    def share(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) / max(self.tokens, 1), self.unknown)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + (self.types + 1.0)))


def blocks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """(blk, ids, held, sizes, data): texts gathered in blocks, in the order of the input's splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        gathered: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids = pa.concat_arrays([g[0] for g in gathered])
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(g[3] for g in gathered))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, pa.concat_arrays([g[1] for g in gathered]), pa.array(np.concatenate([g[2] for g in gathered])))]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([data], pa.binary())], ["blk", "ids", "held", "sizes", "data"])

        for batch in batches:
            data, at = byte_slices(batch.column(2))
            first = 0
            while first < batch.num_rows:
                last = max(int(np.searchsorted(at, at[first] + BLOCK - size, "right")) - 1, first + 1)
                part = batch.slice(first, last - first)
                gathered.append((part.column(0), part.column(1), np.diff(at[first : last + 1]), data[at[first] : at[last]].tobytes()))
                size += int(at[last] - at[first])
                first = last
                if size >= BLOCK or first < batch.num_rows:
                    yield block()
                    gathered, size = [], 0
        if gathered:
            yield block()

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(trimmed(run), f"blk long, ids array<{kind}>, held array<boolean>, sizes array<long>, data binary")


def tokens(data: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a block: the hash of every token, ends included, and the document that it is in. Texts are
    read about CHUNK bytes at a time, as what is kept of a byte meanwhile is many times its size."""
    text = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)])
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    a = 0
    while a < len(sizes):
        b = max(int(np.searchsorted(at, at[a] + CHUNK, "right")) - 1, a + 1)
        parts.append(_tokens(text[at[a] : at[b]], sizes[a:b], a))
        a = b
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _tokens(text: np.ndarray, sizes: np.ndarray, first_doc: int) -> tuple[np.ndarray, np.ndarray]:
    # a blank after each text, so that no word crosses texts
    ends = np.cumsum(sizes + 1)
    spaced = np.full(len(text) + len(sizes), 0x20, np.uint8)
    last = np.zeros(len(spaced), bool)
    last[ends - 1] = True
    spaced[~last] = text
    blank = (spaced == 0x20) | ((spaced >= 0x09) & (spaced <= 0x0D))
    first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    flat, starts, stops = words_joined(spaced)
    words = np.append(word_hashes(flat, starts, stops), np.full(len(sizes), END))
    doc = np.append(np.searchsorted(ends, first, "right"), np.arange(len(sizes))).astype(np.int32)
    order = np.argsort(doc, kind="stable")
    return words[order], doc[order] + np.int32(first_doc)


def _slices(keys: np.ndarray, n: int) -> np.ndarray:
    """Borders of n equal ranges of 64-bit keys in sorted keys."""
    return np.searchsorted(keys, np.array([(i << 64) // n for i in range(1, n)], np.uint64)).tolist()


def count_words(held: DataFrame, n_slices: int) -> DataFrame:
    """held: ``blocks``. Rows for each block and slice (blk, r, numbers, train, every), packed columns in
    the order of the block's hashes, and one for each slice (blk null) with ``stats``."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blk, out_held, sizes, data = (batch.column(k)[i] for k in range(4))
                word, doc = tokens(data.as_py(), np.array(sizes.values))
                trains = ~np.array(out_held.values)
                keys, which = np.unique(word, return_inverse=True)
                every = np.bincount(which, minlength=len(keys))
                train = np.bincount(which[trains[doc]], minlength=len(keys))
                cut = [0, *_slices(keys, n_slices), len(keys)]
                rows = [(r, packed_sorted(keys[a:b]), packed(train[a:b].astype(np.uint32)), packed(every[a:b].astype(np.uint32))) for r, (a, b) in enumerate(zip(cut, cut[1:])) if b > a]
                r, k, t, e = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([blk.as_py()] * len(r)), pa.array(r, pa.int64()), pa.array(k, pa.binary()), pa.array(t, pa.binary()), pa.array(e, pa.binary())], ["blk", "r", "keys", "train", "every"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "r"):
            rs = table.column("r").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(rs)) + 1, [len(rs)]])
            for a, b in zip(cut, cut[1:]):
                part = table.slice(a, b - a)
                keys = [unpacked_sorted(x.as_py(), "<u8") for x in part.column("keys")]
                _, which = np.unique(np.concatenate(keys), return_inverse=True)
                total = lambda c: np.bincount(which, np.concatenate([unpacked(x.as_py(), "<u4") for x in part.column(c)])).astype(np.int64)
                train, every = total("train"), total("every")
                at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
                own = [which[x:y] for x, y in zip(at, at[1:])]
                stats = [len(train), int(train.sum()), int((train > 0).sum()), int(every.sum()), *counts_of_counts(train)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*part.column("blk").to_pylist(), None], pa.int64()),
                        pa.array([int(rs[a])] * (len(own) + 1)),
                        pa.array([*(packed_sorted(o.astype(np.int64)) for o in own), None], pa.binary()),
                        pa.array([*(packed(train[o].astype("<i8")) for o in own), None], pa.binary()),
                        pa.array([*(packed(every[o].astype("<i8")) for o in own), None], pa.binary()),
                        pa.array([*([None] * len(own)), stats], pa.list_(pa.int64())),
                    ],
                    ["blk", "r", "numbers", "train", "every", "stats"],
                )

    asked = held.select("blk", "held", "sizes", "data").mapInArrow(trimmed(ask), "blk long, r long, keys binary, train binary, every binary")
    return asked.repartition(-(-n_slices // SLICES), "r").sortWithinPartitions("r").mapInArrow(trimmed(answer), "blk long, r long, numbers binary, train binary, every binary, stats array<long>")


PAYLOAD = "r long, blk long, h binary, w binary, share binary, doc binary, n binary, context binary, ids binary, n_docs long, n_tokens binary, n_known binary, base binary"


def send_pairs(joined: DataFrame, offsets: np.ndarray, uni: Unigrams, n_slices: int, hot: int) -> DataFrame:
    """joined: blk, held, sizes, data, counts (the block's answers). Rows of PAYLOAD: for each slice the
    block's pairs, and one row with what it knows by itself (slices from 2 * n_slices on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PAYLOAD.split(", ")]
        kinds = [pa.int64() if " long" in x else pa.binary() for x in PAYLOAD.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                blk, held, sizes, data, counts = (batch.column(k)[i] for k in range(5))
                blk, n_docs = blk.as_py(), len(sizes)
                word, doc = tokens(data.as_py(), np.array(sizes.values))
                trains = ~np.array(held.values)
                keys, w = np.unique(word, return_inverse=True)
                del word
                answers = sorted(counts.as_py(), key=lambda x: x["r"])
                number = np.concatenate([unpacked_sorted(x["numbers"], "<i8") + offsets[x["r"]] for x in answers])
                train = np.concatenate([unpacked(x["train"], "<i8") for x in answers])
                every = np.concatenate([unpacked(x["every"], "<i8") for x in answers])
                # the start of a text is the last context
                number, train, every = np.append(number, offsets[-1]), np.append(train, uni_starts), np.append(every, uni_all_starts)
                slice_of = (number // width).astype(np.int32)
                h = np.concatenate([[len(keys)], w[:-1]])
                h[np.concatenate([[True], doc[1:] != doc[:-1]])] = len(keys)
                c = train[w]
                sums = lambda x: np.bincount(doc, x, minlength=n_docs)
                own = {"r": 2 * n_slices + blk % n_slices, "blk": blk, "n_docs": n_docs, "n_tokens": packed(np.bincount(doc, minlength=n_docs)), "n_known": packed(sums(c > 0).astype(np.int64)), "base": packed(sums(uni.base(c)))}
                rows = [own]
                b1, b2 = max(int(n_docs - 1).bit_length(), 1), max(len(keys).bit_length(), 1)
                if 2 * b2 + b1 > 64:
                    raise ValueError("a block is too large")
                code, n = np.unique((h.astype(np.uint64) << np.uint64(b1 + b2)) | (w.astype(np.uint64) << np.uint64(b1)) | doc.astype(np.uint64), return_counts=True)
                del h, w, c, doc
                d, ww, hh = (code & np.uint64((1 << b1) - 1)).astype(np.int32), ((code >> np.uint64(b1)) & np.uint64((1 << b2) - 1)).astype(np.int32), (code >> np.uint64(b1 + b2)).astype(np.int32)
                del code
                n = np.where(trains[d], n, -n).astype("<i4")
                wide = every[hh] >= hot
                r = slice_of[hh]
                mixed = ((number[hh[wide]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ number[ww[wide]].astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                r[wide] = n_slices + ((mixed >> np.uint64(33)) % np.uint64(n_slices)).astype(np.int32)
                order = np.argsort(r, kind="stable").astype(np.int32)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(r[order])) + 1, [len(order)]])
                for x, y in zip(cut, cut[1:]):
                    o = order[x:y]
                    if not len(o):
                        continue
                    rows.append(
                        {
                            "r": int(r[o[0]]),
                            "blk": blk,
                            "h": packed_sorted(number[hh[o]]),
                            "w": packed(number[ww[o]].astype("<u4" if offsets[-1] < 1 << 32 else "<u8")),
                            "share": packed(train[ww[o]].astype("<u4" if uni.tokens < 1 << 32 else "<u8")),
                            "doc": packed(d[o].astype("<u4")),
                            "n": packed(n[o]),
                            "context": packed(train[hh[o]].astype("<i8")) if r[o[0]] >= n_slices else None,
                        }
                    )
                    if len(rows) >= 64:
                        yield pa.RecordBatch.from_arrays([pa.array([q.get(c) for q in rows], k) for c, k in zip(names, kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([q.get(c) for q in rows], k) for c, k in zip(names, kinds)], names)

    uni_starts, uni_all_starts = uni.starts, uni.all_starts
    # numbers follow the hashes' order: equal ranges of them, the start of a text being the last
    width = int(offsets[-1]) // n_slices + 1
    return joined.select("blk", "held", "sizes", "data", "counts").mapInArrow(trimmed(run), PAYLOAD)


def _pairs_of(part: pa.Table, wide_numbers: bool, wide_tokens: bool) -> dict[str, np.ndarray]:
    """Columns of one slice, over all blocks; ``at`` is the payload row of each pair."""
    get = lambda c, f: [f(x.as_py()) for x in part.column(c)]
    h = get("h", lambda x: unpacked_sorted(x, "<i8"))
    out = {"h": np.concatenate(h), "at": np.repeat(np.arange(len(h)), [len(x) for x in h])}
    for c, kind in (("w", "<u8" if wide_numbers else "<u4"), ("share", "<u8" if wide_tokens else "<u4"), ("doc", "<u4"), ("n", "<i4")):
        out[c] = np.concatenate(get(c, lambda x, kind=kind: unpacked(x, kind))).astype(np.int64)
    if part.column("context").null_count == 0:
        out["context"] = np.concatenate(get("context", lambda x: unpacked(x, "<i8")))
    return out


def _table(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: order of distinct ones (first places), the distinct pair of each, its training count."""
    order = np.lexsort((p["w"], p["h"]))
    h, w = p["h"][order], p["w"][order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which, np.bincount(which, np.maximum(p["n"], 0)).astype(np.int64)


def _each_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    for table in sorted_groups(batches, "r"):
        rs = table.column("r").to_numpy()
        cut = np.concatenate([[0], np.flatnonzero(np.diff(rs)) + 1, [len(rs)]])
        for a, b in zip(cut, cut[1:]):
            yield int(rs[a]), table.slice(a, b - a)


SCORED = "blk long, doc binary, score binary, late_doc binary, late_h binary, late_n binary, n_docs long, n_tokens binary, n_known binary, base binary, h long, freed double, seen double"


def score_pairs(sent: DataFrame, uni: Unigrams, offsets: np.ndarray, n_slices: int) -> DataFrame:
    """One row for each task and block: sums of log10 probabilities by document and, for contexts dealt
    out, the tokens that wait for their alpha. One row for each task and such context (blk null): what
    the task's pairs leave of its mass. There are fewer such contexts than one over their share."""
    wide = (bool(offsets[-1] >= 1 << 32), uni.tokens >= 1 << 32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(K + 1, np.int64)
        for r, part in _each_slice(batches):
            if r < 2 * n_slices:
                n += counts_of_counts(_table(_pairs_of(part, *wide))[2])
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in n], [f"n{k}" for k in range(K + 1)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCORED.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64()}[x.split()[1]] for x in SCORED.split(", ")]
        make = lambda rows: pa.RecordBatch.from_arrays([pa.array([q.get(c) for q in rows], k) for c, k in zip(names, kinds)], names)
        sums: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        waiting: dict[int, list[np.ndarray]] = {}
        mass: dict[int, np.ndarray] = {}
        for r, part in _each_slice(batches):
            if r >= 2 * n_slices:
                yield make([{c: part.column(c)[i].as_py() for c in ("blk", "n_docs", "n_tokens", "n_known", "base")} for i in range(part.num_rows)])
                continue
            d = discounts([part.column(f"n{k}")[0].as_py() for k in range(K + 1)])
            p = _pairs_of(part, *wide)
            first, which, c = _table(p)
            contexts, of = np.unique(p["h"][first], return_inverse=True)
            total = np.zeros(len(contexts), np.int64)
            if r >= n_slices:
                total[of] = p["context"][first]
            else:
                total = np.bincount(of, c, minlength=len(contexts)).astype(np.int64)
            share = uni.share(p["share"][first])
            # P(w | h) of pairs that training has, and what they leave to all others
            given = discounted(c, d) / np.maximum(total[of], 1)
            used = np.bincount(of, np.where(c > 0, given, 0), minlength=len(contexts))
            # words that training lacks are one class, never seen
            seen = np.bincount(of, np.where(c > 0, share, 0), minlength=len(contexts))
            alpha = np.where(total > 0, (1 - used) / (1 - seen), 1.0)
            with np.errstate(divide="ignore"):
                log = np.where(c > 0, np.log10(np.where(c > 0, given, 1)), np.log10(share) + (np.log10(alpha)[of] if r < n_slices else 0))
            times = np.abs(p["n"])
            value = log[which] * times
            blks = part.column("blk").to_numpy()
            for x in np.unique(p["at"]):
                mine = p["at"] == x
                docs_, back = np.unique(p["doc"][mine], return_inverse=True)
                sums.setdefault(int(blks[x]), []).append((docs_, np.bincount(back, value[mine])))
            if r >= n_slices:
                for h, u, s in zip(contexts.tolist(), used, seen):
                    mass[h] = mass.get(h, 0) + np.array([u, s])
                late = np.flatnonzero((c[which] == 0) & (total[of][which] > 0))
                for x in np.unique(p["at"][late]):
                    mine = late[p["at"][late] == x]
                    waiting.setdefault(int(blks[x]), []).append(np.stack([p["doc"][mine], p["h"][mine], times[mine]]))
        yield make([{"h": h, "freed": float(u), "seen": float(s)} for h, (u, s) in mass.items()])
        for blk, parts in sums.items():
            docs_, back = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            row = {"blk": blk, "doc": packed_sorted(docs_.astype(np.int64)), "score": packed(np.bincount(back, np.concatenate([y for _, y in parts])))}
            if blk in waiting:
                row |= dict(zip(("late_doc", "late_h", "late_n"), map(packed, np.concatenate(waiting[blk], axis=1).astype(np.int64))))
            yield make([row])

    dealt = sent.repartition(-(-n_slices // SLICES), "r")
    fields = ", ".join(f"n{k} long" for k in range(K + 1))
    totals = dealt.sortWithinPartitions("r").mapInArrow(trimmed(count), fields).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(K + 1)))
    # one row of totals goes to every task; the pairs' exchange is used for both
    return dealt.crossJoin(F.broadcast(totals)).sortWithinPartitions("r").mapInArrow(trimmed(score), SCORED)


def put_together(scored: DataFrame, held: DataFrame) -> DataFrame:
    """Scores and counts of every document from the sums of all slices."""
    left = scored.where("blk is null").groupBy("h").agg((1 - F.sum("freed")).alias("left"), (1 - F.sum("seen")).alias("unseen"))
    # at most one over the share of contexts that are dealt out
    alphas = {r["h"]: np.log10(r["left"] / r["unseen"]) for r in left.collect()}
    parts = scored.where("blk is not null").groupBy("blk").agg(
        F.collect_list(F.when(F.col("doc").isNotNull(), F.struct("doc", "score", "late_doc", "late_h", "late_n"))).alias("sums"),
        F.max("n_tokens").alias("n_tokens"), F.max("n_known").alias("n_known"), F.max("base").alias("base"),
    )
    rows = held.select("blk", "ids", "held").join(parts, "blk").select("ids", "held", "sums", "n_tokens", "n_known", "base")
    kind = held.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, held_, sums, n_tokens, n_known, base = (batch.column(k)[i] for k in range(6))
                score = np.zeros(len(ids))
                for x in sums.as_py():
                    score[unpacked_sorted(x["doc"], "<i8")] += unpacked(x["score"], "<f8")
                    if x["late_doc"] is not None:
                        h, where = np.unique(unpacked(x["late_h"], "<i8"), return_inverse=True)
                        alpha = np.array([alphas[k] for k in h.tolist()])[where]
                        score += np.bincount(unpacked(x["late_doc"], "<i8"), alpha * unpacked(x["late_n"], "<i8"), minlength=len(score))
                cols = [ids.values, held_.values, *(pa.array(unpacked(x.as_py(), k)) for x, k in ((n_tokens, "<i8"), (n_known, "<i8"), (base, "<f8"))), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(trimmed(run), f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", hot_share: float | None = None) -> DataFrame:
    """Trains on documents for which ``held`` isn't true and scores all. One row per document: id,
    held_out, n_tokens, n_known, train_tokens, base_score, score. ``hot_share``: the share of all tokens
    from which a context is dealt out by pair (default: that of an even shuffle partition)."""
    gathered = materialize(blocks(docs, id_col, text_col, held), "blocks")
    starts = F.size(F.filter("held", lambda x: ~x)).cast("long")
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = gathered.agg(F.sum(F.size("held").cast("long")).alias("n"), F.sum(starts).alias("t"), F.sum(total).alias("bytes")).first()
    least = SLICES * partitions(docs.sparkSession)
    n_words, n_slices = (max(least, -(-(whole["bytes"] or 0) // most)) for most in (WORD_SLICE, PAIR_SLICE))
    counted = materialize(count_words(gathered, n_words), "words")
    stats = {r["r"]: r["stats"] for r in counted.where("blk is null").select("r", "stats").collect()}
    size = np.zeros(n_words + 1, np.int64)
    for r, s in stats.items():
        size[r + 1] = s[0]
    offsets = np.cumsum(size)
    sums = np.sum([s[1:] for s in stats.values()], axis=0).tolist() if stats else [0, 0, 0, *[0] * (K + 1)]
    uni = Unigrams(sums[0], sums[1], sums[3:])
    uni.starts, uni.all_starts = whole["t"] or 0, whole["n"] or 0
    hot = max(2, int((hot_share if hot_share is not None else SLICES / n_slices) * sums[2]))
    answers = counted.where("blk is not null").groupBy("blk").agg(F.collect_list(F.struct("r", "numbers", "train", "every")).alias("counts"))
    joined = gathered.select("blk", "held", "sizes", "data").join(answers, "blk")
    scored = materialize(score_pairs(send_pairs(joined, offsets, uni, n_slices, hot), uni, offsets, n_slices), "scored")
    out = put_together(scored, gathered)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(sums[0]).cast("long").alias("train_tokens"), "base_score", "score")
