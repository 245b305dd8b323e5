"""Removal of repeated byte strings with sparse suffix arrays (operator 3).

A string of ``least`` bytes that starts at two places holds the same anchor at the same distance in
both: the leftmost smallest hash of its 16-byte grams. So text is cut into runs of string starts that
share an anchor, equal strings always have anchors of equal hash, and only runs whose anchor hash
occurs again are candidates. Runs with equal bytes are one entry with a count.

The entries of an anchor hash are put in suffix order from the anchor on, and in the order of their
reversed prefixes, each with the longest common prefixes of neighbours. Among entries that agree to
the left, the longest-previous-factor array says how far each agrees to the right with one at an earlier
position: the previous and next smaller positions in suffix order hold its longest earlier match. A
match of at least ``least`` bytes in total covers both sides. With ``keep="first"`` these arrays decide
(an entry is removed as far as an earlier one matches, and the first copy stays); with ``keep="none"``
their two-sided form does, which takes neighbours at any position, and every copy goes. Strings are
judged on the input, never on what is left of it.

Null and empty texts and texts below ``least`` bytes lose nothing. Rows that repeat id and text are
copies of each other, and all of them go (with ``keep="first"`` they stay alike). Null ids are
allowed. A long text is read in overlapping tiles; an anchor with very many different entries is
dealt out by blocks of starts and the hash of what the strings of a block have in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import byte_slices, discard, materialize, sorted_groups, trimmed

#: Bytes of the grams that can be anchors, and of a tile of text.
GRAM, TILE = 16, 1 << 20
_LOW = np.uint64((1 << 24) - 1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Different entries of one anchor beyond which it is dealt out.
HOT = 20_000
#: String starts in a block of a hot anchor.
PIECE = 16


def gram_hashes(x: np.ndarray) -> np.ndarray:
    n = len(x) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    padded = np.concatenate([x, np.zeros(8, np.uint8)])
    words = np.ndarray((len(x),), "<u8", padded.data, strides=(1,))
    h = words[:n] * np.uint64(_BASE)
    h ^= h >> np.uint64(29)
    h += words[8 : 8 + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def window_minima(v: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w consecutive values, from minima that run to and from block borders."""
    m = len(v) - w + 1
    if m <= 0:
        return v[:0]
    k = -(-len(v) // w)
    p = np.full(k * w, np.uint64(2**64 - 1))
    p[: len(v)] = v
    p = p.reshape(k, w)
    after = np.minimum.accumulate(p, axis=1).ravel()
    before = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(before[:m], after[w - 1 : w - 1 + m])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefix:
    """Hash of any range of a tile from prefix sums of its gram hashes."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _powers(_BASE, len(h)), dtype=np.uint64)])
        self.inverse = _powers(_INVERSE, len(h) + 1)

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of the bytes start to stop, by their grams."""
        x = (self.sums[stop - GRAM + 1] - self.sums[start]) * self.inverse[start]
        x ^= x >> np.uint64(31)
        return x * np.uint64(0x94D049BB133111EB)


def runs(x: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of a tile that holds texts which end at ``ends``: key, segment hash, start, starts in the run,
    and the anchor's distance from the first start."""
    h = gram_hashes(x)
    low = window_minima((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), least - GRAM + 1)
    at = (low & _LOW).astype(np.int64)
    m = len(at)
    stop = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:m]
    inside = np.arange(m) + least <= stop
    new = np.ones(m, bool)
    new[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1]) | (stop[1:] != stop[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.concatenate([start, [m]]))
    good = inside[start]
    start, length = start[good], length[good]
    anchor = at[start]
    rel = anchor - start
    seg = Prefix(h)(start, start + length - 1 + least) ^ (rel.astype(np.uint64) << np.uint64(40)) ^ (length.astype(np.uint64) << np.uint64(52))
    return h[anchor], seg, start, length, rel


def tiles(data: np.ndarray, at: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Buffers of whole texts, or of overlapping parts of a long one: bytes, ends, rows and shifts."""
    first, n = 0, len(at) - 1
    while first < n:
        last = max(int(np.searchsorted(at, at[first] + TILE, "right")) - 1, first + 1)
        if at[last] - at[first] <= TILE:
            yield data[at[first] : at[last]], at[first + 1 : last + 1] - at[first], np.arange(first, last), np.zeros(last - first, np.int64)
        else:
            size = int(at[last] - at[first])
            for shift in range(0, max(size - least + 1, 1), TILE):
                part = data[at[first] + shift : min(at[first] + shift + TILE + least - 1, at[last])]
                yield part, np.array([len(part)]), np.array([first]), np.array([shift])
        first = last


def candidate_runs(docs: DataFrame, least: int) -> DataFrame:
    """docs: id, h (hash of the text), text binary. Rows key, seg, id, h, start, length, rel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_slices(batch.column(2))
            for part, ends, rows, shifts in tiles(data, at, least):
                if len(part) < least:
                    continue
                key, seg, start, length, rel = runs(part, ends, least)
                which = np.searchsorted(ends, start, "right")
                begin = np.concatenate([[0], ends])[which]
                row = pa.array(rows[which])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key.view(np.int64)),
                        pa.array(seg.view(np.int64)),
                        batch.column(0).take(row),
                        batch.column(1).take(row),
                        pa.array(start - begin + shifts[which]),
                        pa.array(length.astype(np.int32)),
                        pa.array(rel.astype(np.int32)),
                    ],
                    ["key", "seg", "id", "h", "start", "length", "rel"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(trimmed(run), f"key long, seg long, id {kind}, h long, start long, length int, rel int")


def shared_contexts(docs: DataFrame, width: int) -> DataFrame:
    """docs: id, h, text binary. Rows id, h, shared: how many anchors of a text stand in ``width`` bytes that
    also occur elsewhere. What it counts is a repeat of ``width`` bytes; every repeat of ``width`` and a
    third more bytes holds such an anchor whole. Only hashes move."""
    before, every = width * 2 // 5, width // 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_slices(batch.column(2))
            for part, ends, rows, _ in tiles(data, at, 2 * width):
                if len(part) < width:
                    continue
                h = gram_hashes(part)
                low = window_minima((h & ~_LOW) | np.arange(len(h), dtype=np.uint64), every)
                start = np.unique((low & _LOW).astype(np.int64)) - before
                which = np.searchsorted(ends, start + before, "right")
                inside = (start >= np.concatenate([[0], ends])[which]) & (start + width <= ends[which])
                start, which = start[inside], which[inside]
                row = pa.array(rows[which])
                yield pa.RecordBatch.from_arrays([pa.array(Prefix(h)(start, start + width).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row)], ["key", "id", "h"])

    kind = docs.schema["id"].dataType.simpleString()
    found = materialize(docs.mapInArrow(trimmed(run), f"key long, id {kind}, h long"), "contexts")
    # a table of its own, so that the join with it can be split where a key is hot
    keys = materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    return found.join(keys, "key").groupBy("id", "h").agg(F.count(F.lit(1)).alias("shared"))


def neighbour_prefixes(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the items and the common prefix length of each one with the next in that order."""
    if len(items) == 2:
        a, b = (np.frombuffer(x, np.uint8, min(map(len, items))) for x in items)
        other = a != b
        return np.array([0, 1] if items[0] <= items[1] else [1, 0]), np.array([int(other.argmax()) if other.any() else len(a)])
    order = sorted(range(len(items)), key=items.__getitem__)
    common = np.zeros(max(len(items) - 1, 0), np.int64)
    wide = max(map(len, items)) + 1
    for at in range(0, len(common), 4096):
        part = [items[i] for i in order[at : at + 4097]]
        # the padding differs from row to row, so that nothing agrees beyond the shorter one
        grid = np.zeros((len(part), wide), np.int16)
        for k, s in enumerate(part):
            grid[k, : len(s)] = np.frombuffer(s, np.uint8)
            grid[k, len(s) :] = -1 - (k & 1)
        common[at : at + len(part) - 1] = (grid[1:] != grid[:-1]).argmax(axis=1)
    return np.array(order), common


def previous_factors(common: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Longest previous factors: how far each item agrees with any at a smaller position. Items are in
    suffix order, ``common`` holds the agreement of each one with the next.

    Items leave a linked list from the largest position down, so what stands around an item when it
    leaves are the previous and next smaller positions in suffix order; its neighbours then agree as far
    as both agreed with it."""
    n = len(position)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    # agreement with the live item before; the ends agree with nothing
    agree = [0, *common.tolist(), 0]
    out = [0] * n
    for i in np.argsort(position)[::-1].tolist():
        b, a = before[i], after[i]
        out[i] = max(agree[i], agree[a])
        agree[a] = min(agree[i], agree[a])
        if a < n:
            before[a] = b
        if b >= 0:
            after[b] = a
    return np.array(out, np.int64)


def either_factors(common: np.ndarray) -> np.ndarray:
    """The two-sided form: how far each item agrees with any other, so with a neighbour in suffix order."""
    edged = np.concatenate([[0], common, [0]])
    return np.maximum(edged[:-1], edged[1:])


class RangeMinima:
    """Smallest of any range of a list, from minima over powers of two."""

    def __init__(self, v: np.ndarray):
        self.rows = [v]
        while 2 << (len(self.rows) - 1) <= len(v):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.int64)
        power = np.frexp((stop - start).astype(np.float64))[1] - 1
        for k, row in enumerate(self.rows):
            here = power == k
            out[here] = np.minimum(row[start[here]], row[stop[here] - (1 << k)])
        return out


def covered(prefixes: list[bytes], suffixes: list[bytes], least: int, position: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For entries with ``prefixes`` (reversed) before and ``suffixes`` from the anchor: how many bytes
    to the left and right of the anchor a matching entry covers (0, 0: none). ``position``: only
    entries at a smaller position count.

    Entries that agree for v bytes to the left are a class. Within each class, in suffix order, the
    longest factors give how far to the right an entry agrees with another (an earlier) one; together
    with v that is a match. Classes change only where neighbours in the order of the prefixes agree for
    v bytes and no more, so only these levels are looked at."""
    n = len(suffixes)
    right_order, right = neighbour_prefixes(suffixes)
    left_order, left = neighbour_prefixes(prefixes)
    low, high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n == 2:
        if left[0] + right[0] >= least:
            hit = slice(None) if position is None else int(position.argmax())
            low[hit], high[hit] = left[0], right[0]
        return low, high
    minima = RangeMinima(right)
    rank = np.empty(n, np.int64)
    rank[right_order] = np.arange(n)
    for v in np.unique(left)[::-1]:
        if v + right.max() < least:
            break
        which = np.empty(n, np.int64)
        which[left_order] = np.concatenate([[0], np.cumsum(left < v)])
        order = np.lexsort((rank, which))
        same = np.flatnonzero(which[order[1:]] == which[order[:-1]])
        common = np.zeros(n - 1, np.int64)
        common[same] = minima(rank[order[same]], rank[order[same + 1]])
        factor = either_factors(common) if position is None else previous_factors(common, position[order])
        # entries of a class share the anchor at least; without a factor an entry is alone in its class
        hit = (v + factor >= least) & (factor > 0)
        low[order[hit]] = np.maximum(low[order[hit]], v)
        high[order[hit]] = np.maximum(high[order[hit]], factor[hit])
    return low, high


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame, least: int, keep: str, hot_entries: int = HOT) -> DataFrame:
    """docs: id, h, text binary. Rows id, h, spans array<struct<a,b>> for documents that lose bytes."""
    first = keep == "first"
    found = materialize(candidate_runs(docs, least), "runs")
    # a table of its own, so that the join with it can be split where a key is hot
    keys = materialize(found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "keys")
    again = materialize(found.join(keys, "key"), "candidates")
    for done in (found, keys):
        discard(done)
    here = F.struct("id", "start", "h")
    entries = materialize(again.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("n"), F.min(here).alias("at"), F.first("length").alias("length"), F.first("rel").alias("rel")), "entries")
    # an entry alone under its key has met only copies of itself and needs no bytes
    many = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("different")).where("different > 1"), "keys")
    asked = entries.join(many, "key").select(F.col("at.id").alias("id"), F.col("at.h").alias("h"), F.struct("key", "seg", F.col("at.start").alias("start"), "length", "rel", (F.col("different") > hot_entries).alias("hot")).alias("e"))
    asked = asked.groupBy("id", "h").agg(F.collect_list("e").alias("entries"))
    held = docs.withColumnRenamed("id", "id_").withColumnRenamed("h", "h_")
    held = held.join(asked, F.col("id_").eqNullSafe(F.col("id")) & (F.col("h_") == F.col("h"))).select("id", "h", "text", "entries")
    kind = docs.schema["id"].dataType.simpleString()
    schema = f"g long, key long, seg long, id {kind}, start long, rel int, data binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["g", "key", "seg", "id", "start", "rel", "data"]
        for batch in batches:
            data, at = byte_slices(batch.column(2))
            lists = batch.column(3)
            flat = lists.flatten()
            key, seg, start, length, rel, hot = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            base = at[row] + start
            out: list[tuple] = []
            size = 0
            for i in range(len(row)):
                if not hot[i]:
                    out.append((key[i], key[i], seg[i], row[i], start[i], rel[i], data[base[i] : base[i] + length[i] + least - 1].tobytes()))
                    size += len(out[-1][-1])
                else:
                    # starts a multiple of PIECE before the anchor begin a block, in every entry alike
                    s = 0
                    while s < length[i]:
                        e = min(int(length[i]), s + 1 + (int(rel[i]) - s - 1) % PIECE if rel[i] > s else s + 1)
                        block = data[base[i] + s : base[i] + e + least - 1].tobytes()
                        top = (int(rel[i]) - s + PIECE - 1) // PIECE
                        core = data[base[i] + rel[i] - (top - 1) * PIECE - 1 : base[i] + rel[i] - top * PIECE + least].tobytes() if top else block
                        g = hash((int(key[i]), top, _digest(core)))
                        out.append((g, key[i], seg[i], row[i], start[i] + s, rel[i] - s, block))
                        size += len(block)
                        s = e
                if size > 8 << 20:
                    yield _batch(out, batch.column(0), names)
                    out, size = [], 0
            if out:
                yield _batch(out, batch.column(0), names)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(batches, "g"):
            g = table.column("g").to_numpy()
            key, seg, start, rel = (table.column(c).to_numpy() for c in ("key", "seg", "start", "rel"))
            ids, data = table.column("id").to_pylist() if first else None, table.column("data").combine_chunks()
            stop = np.concatenate([np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            out = []
            a = 0
            for b in stop:
                # repeated rows bring an entry twice, so each is taken once
                _, one = np.unique(np.stack([seg[a:b], start[a:b] if first else rel[a:b]]), axis=1, return_index=True)
                one = a + one
                if len(one) > 1:
                    items = [data[int(i)].as_py() for i in one]
                    position = None
                    if first:
                        ranks = sorted(range(len(one)), key=lambda k: (ids[one[k]] is not None, ids[one[k]], start[one[k]] + rel[one[k]]))
                        position = np.empty(len(one), np.int64)
                        position[ranks] = np.arange(len(one))
                    low, high = covered([s[: rel[i]][::-1] for s, i in zip(items, one)], [s[rel[i] :] for s, i in zip(items, one)], least, position)
                    hit = high > 0
                    if hit.any():
                        out.append((key[one][hit], seg[one][hit], low[hit].astype(np.int64), high[hit].astype(np.int64)))
                a = b
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["key", "seg", "low", "high"])

    matched = held.mapInArrow(trimmed(cut), schema).repartition("g").sortWithinPartitions("g").mapInArrow(trimmed(match), "key long, seg long, low long, high long")
    matched = materialize(matched, "matches")
    copies = entries.where("n > 1").select("key", "seg", F.col("at").alias("first_at"))
    ran = again.select("key", "seg", "id", "h", "start", (F.col("start") + F.col("rel")).alias("anchor"), (F.col("start") + F.col("length") + (least - 1)).alias("stop"))
    whole = ran.join(copies, ["key", "seg"])
    if first:
        whole = whole.where(~F.struct("id", "start", "h").eqNullSafe(F.col("first_at")))
    # what later copies of an entry lose is all of it, so partial matches are for its first place
    partial = ran.join(matched, ["key", "seg"]).select("id", "h", (F.col("anchor") - F.col("low")).alias("a"), (F.col("anchor") + F.col("high")).alias("b"))
    spans = whole.select("id", "h", F.col("start").alias("a"), F.col("stop").alias("b")).union(partial)
    return spans.groupBy("id", "h").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


def _batch(rows: list[tuple], ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    g, key, seg, row, start, rel, data = zip(*rows)
    numbers = lambda x, t: pa.array(np.array(x, t))
    return pa.RecordBatch.from_arrays(
        [numbers(g, np.int64), numbers(key, np.int64), numbers(seg, np.int64), ids.take(numbers(row, np.int64)), numbers(start, np.int64), numbers(rel, np.int32), pa.array(data, pa.binary())], names
    )


def rows_columns(id_col: str, text: Column) -> list[Column]:
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text")]


def remove_repeats(docs: DataFrame, least: int = 400, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", hot_entries: int = HOT, carry: bool = False, report: int | None = None) -> DataFrame:
    """One row per document: id, n_bytes, spans (merged, start and stop in bytes) and kept (binary);
    with ``carry`` also ``row``, a struct of all columns but the text; with ``report`` also ``shared``, in how
    many places the text repeats ``report`` bytes, which may be fewer than are removed."""
    if least < 2 * GRAM or keep not in ("none", "first"):
        raise ValueError("least must be 32 or more, keep 'none' or 'first'")
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(*rows_columns(id_col, text))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] if carry else []
    whole = docs.select(*rows_columns(id_col, text), F.struct(*others).alias("row")) if carry else rows
    spans = repeated_spans(rows, least, keep, hot_entries).select(F.col("id").alias("id_"), F.col("h").alias("h_"), "spans")
    if report:
        shared = shared_contexts(rows, report)
        spans = spans.join(shared, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "full")
        spans = spans.select(F.coalesce("id_", "id").alias("id_"), F.coalesce("h_", "h").alias("h_"), "spans", "shared")
    more = (["row"] if carry else []) + (["shared"] if report else [])
    joined = whole.join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left").select("id", "text", "spans", *more)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sizes, merged, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    runs_ = _merged([(s["a"], s["b"]) for s in found]) if found else []
                    cuts = [0, *(x for r in runs_ for x in r), len(text)]
                    sizes.append(len(text))
                    merged.append([{"start": a, "stop": b} for a, b in runs_])
                    kept.append(b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2])) if runs_ else text)
                spans_ = pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
                columns = [part.column(0), pa.array(sizes, pa.int64()), spans_, pa.array(kept, pa.binary()), *(part.column(3 + k) for k in range(len(more)))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "spans", "kept", *more])

    kind = docs.schema[id_col].dataType.simpleString()
    kinds = "".join(f", {c} {joined.schema[c].dataType.simpleString()}" for c in more)
    return joined.mapInArrow(trimmed(strip), f"id {kind}, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary{kinds}").withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, least: int, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """The rows of ``docs`` with later copies of repeated strings cut from their text, all columns kept.

    Bytes of a character that is cut through go too; ``size_col`` is counted again. Rows of which
    nothing but white space is left go."""
    out = remove_repeats(docs, least, "first", id_col, text_col, carry=True)
    text = F.when(F.size("spans") > 0, valid_text(F.col("kept"))).otherwise(F.col("kept").cast("string")).alias("text_")
    done = out.select("row", text, (F.size("spans") > 0).alias("cut_")).where("not cut_ or length(trim(both from regexp_replace(text_, '[\\\\s]+', ' '))) > 0")
    kinds = dict(docs.dtypes)
    new = {text_col: F.col("text_")}
    if size_col in docs.columns:
        new[size_col] = F.when(F.col("cut_"), F.char_length("text_")).otherwise(F.col(f"row.`{size_col}`")).cast(kinds[size_col])
    return done.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def valid_text(data: Column) -> Column:
    """Bytes as text, without bytes that are no whole character."""
    return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("\ufffd"), F.lit(""))
