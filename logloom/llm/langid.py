"""Language identification with error-correcting output codes (operator 5).

Every language gets a binary codeword. For each bit a binary classifier over hashed byte trigrams
decides which half a text belongs to; its weights are log ratios of the two halves' smoothed trigram
shares, counted over all labelled rows. Decoding sums a logistic loss of the bits against every
codeword, each bit weighted by how far apart its halves lie, and takes the nearest; a text whose two
nearest codewords are almost equally far is flagged ambiguous. Decoding also rejects: a text whose bits
agree with its nearest codeword far less than texts of that language do is in none of the languages.

Null text, empty text and text without a letter: ``und``, score 0, not ambiguous. No labelled row at
all: every text is ``und``. One language only: that language. Ties go to the first label in order.
Very long texts are scored whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import trimmed

#: Hash space of the trigrams.
SLOTS = 1 << 16
#: Languages up to which the code is exhaustive; beyond it columns are drawn and the best kept.
EXHAUSTIVE = 6
UNKNOWN = "und"
#: Trigrams that are decoded together for the agreement.
STRETCH = 256
#: Bytes of folded text that are looked up at once; what is kept of a byte meanwhile is many times its size.
CHUNK = 1 << 20
_LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a blank; bytes of other characters stay.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def slots(data: np.ndarray) -> np.ndarray:
    """Slot of the trigram that begins at each byte but the last two."""
    x = data.astype(np.uint32)
    mixed = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA77)) ^ (x[2:] * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return mixed >> np.uint32(16)


def folded(text: str) -> bytes:
    return b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" "


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k x bits matrix of -1 and 1; rows differ in many bits, no column is constant or repeated."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= EXHAUSTIVE:
        columns = [[1] + [1 if (c >> i) & 1 else -1 for i in range(k - 1)] for c in range((1 << (k - 1)) - 1)]
        return np.array(columns, np.int8).T
    bits = int(np.ceil(10 * np.log2(k)))
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        code = code[:, np.abs(code.sum(axis=1 - 1)) < k]
        nearest = min(int((code[a] != code[b]).sum()) for a, b in combinations(range(k), 2))
        if nearest > far:
            best, far = code, nearest
    return best


@dataclass
class Model:
    """What decoding needs; its size is bits x SLOTS whatever the corpus."""

    labels: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray
    #: Of each label, how far a trigram of its labelled texts agrees with its codeword on average.
    usual: np.ndarray
    #: Of each slot, the log of its share in the labelled texts over an even one; and its mean over these.
    common: np.ndarray
    usual_common: float


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts trigrams of all given rows by language. Only languages x SLOTS sums reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                texts.setdefault(lang, []).append(folded(text.as_py()))
            for lang, parts in texts.items():
                data = np.frombuffer(b"".join(parts), np.uint8)
                sums = seen.setdefault(lang, np.zeros(SLOTS, np.int64))
                for at in range(0, max(len(data) - 2, 0), CHUNK):
                    sums += np.bincount(slots(data[at : at + CHUNK + 2]), minlength=SLOTS)
        for lang, sums in seen.items():
            where = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where, pa.int32()), pa.array(sums[where])], ["lang", "slot", "n"])

    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(trimmed(count), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = counts.column("lang").to_pylist()
    labels = sorted(set(langs))
    code = codewords(len(labels))
    table = np.zeros((len(labels), SLOTS))
    at = {x: i for i, x in enumerate(labels)}
    table[[at[x] for x in langs], counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    share = (table + 0.5) / (table.sum(axis=1, keepdims=True) + 0.5 * SLOTS)
    weights = np.zeros((code.shape[1] if len(labels) else 0, SLOTS), np.float32)
    apart = np.ones(len(weights))
    for b in range(len(weights)):
        if len(labels) > 1:
            yes, no = share[code[:, b] > 0].mean(axis=0), share[code[:, b] < 0].mean(axis=0)
            ratio = np.log(yes) - np.log(no)
            weights[b], apart[b] = ratio, float(((yes - no) * ratio).sum())
    bit_weight = apart / apart.mean() if len(apart) else apart
    table[:, slots(np.full(3, 0x20, np.uint8))] = 0
    mean = table @ weights.T.astype(float) / np.maximum(table.sum(axis=1, keepdims=True), 1)
    return Model(labels, code, weights, bit_weight, (mean * code * bit_weight).sum(axis=1), *_common(share, table))


def _common(share: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, float]:
    if not len(share):
        return np.zeros(SLOTS, np.float32), 0.0
    common = np.log(share.mean(axis=0) * SLOTS).astype(np.float32)
    common[slots(np.full(3, 0x20, np.uint8))] = 0
    return common, float((table @ common).sum() / max(table.sum(), 1))


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of bit margins: the nearest label's index, its score and the gap to the next one's."""
    loss = np.stack([(np.logaddexp(0, -margins * row) * model.bit_weight).sum(axis=1) for row in model.code.astype(float)], axis=1)
    like = np.exp(loss.min(axis=1, keepdims=True) - loss)
    like /= like.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    ordered = np.sort(like, axis=1)
    return best, ordered[:, -1], ordered[:, -1] - (ordered[:, -2] if like.shape[1] > 1 else 0)


def classify(column: pa.Array, m: Model, evidence: int, ambiguous_below: float) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Labels, scores, ambiguity, agreement, commonness and number of trigrams with a letter, of a column of texts. The
    agreement is that of each STRETCH with its nearest codeword, as a share of what is usual for the label (1 if
    the model has one label only), so that a text in two languages agrees like one in either. The commonness
    is how frequent its trigrams are in the labelled texts of whatever language, as a share of what is usual there."""
    n = len(column)
    sums, sizes, lettered, filled, agreed = np.zeros((n, len(m.weights))), np.zeros(n), np.zeros(n, bool), np.zeros(n), np.zeros(n)
    shared = np.zeros(n)
    known = len(m.usual) > 1 and bool((m.usual > 0).all())
    towards = m.code * m.bit_weight / m.usual[:, None] if known else None

    def add(parts: list[bytes], rows: list[int]) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8)
        idx = slots(data)
        starts = np.minimum(np.cumsum([0, *map(len, parts)])[:-1], len(idx) - 1)
        near = np.concatenate([np.arange(a, max(z, a + 1), STRETCH) for a, z in zip(starts, [*starts[1:], len(idx)])])
        parted = np.zeros((len(near), len(m.weights)))
        for b, w in enumerate(m.weights):
            # a trigram across two parts has blanks at the seam and counts little
            np.add.at(sums[:, b], rows, np.add.reduceat(found := w[idx], starts, dtype=np.float64))
            parted[:, b] = np.add.reduceat(found, near, dtype=np.float64)
        np.add.at(sizes, rows, list(map(len, parts)))
        held = data != 0x20
        np.add.at(filled, rows, np.add.reduceat(held[:-2] | held[1:-1] | held[2:], starts, dtype=np.int64))
        np.add.at(shared, rows, np.add.reduceat(m.common[idx], starts, dtype=np.float64))
        if known:
            owner = np.repeat(rows, [len(range(a, max(z, a + 1), STRETCH)) for a, z in zip(starts, [*starts[1:], len(idx)])])
            np.add.at(agreed, owner, (parted @ towards.T).max(axis=1))

    parts, rows, size = [], [], 0
    for row, text in enumerate(column):
        text = text.as_py()
        if not text or not _LETTER.search(text):
            continue
        lettered[row] = True
        data = folded(text)
        for at in range(0, len(data), CHUNK):
            parts.append(data[at : at + CHUNK])
            rows.append(row)
            size += len(parts[-1])
            if size >= CHUNK:
                add(parts, rows)
                parts, rows, size = [], [], 0
    if size > 2:
        add(parts, rows)
    margins = sums / np.maximum(sizes, 1)[:, None] * np.minimum(sizes, evidence)[:, None]
    best, score, gap = decode(margins, m)
    names = [m.labels[i] if ok else UNKNOWN for i, ok in zip(best, lettered)]
    share = agreed / np.maximum(filled, 1) if known else np.ones(n)
    return names, np.where(lettered, score, 0.0), lettered & (gap < ambiguous_below), share, shared / np.maximum(filled, 1) / (m.usual_common or 1.0), filled


#: A bit's margin is its mean log ratio times the number of trigrams, this many at most, so that long
#: texts don't saturate; a text is ambiguous if its two best labels' scores are closer than the other.
EVIDENCE, AMBIGUOUS = 400, 0.1


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", evidence: int = EVIDENCE, ambiguous_below: float = AMBIGUOUS) -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1), ambiguous."""
    if not len(model.weights):
        return docs.select(F.col(id_col).alias("id"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score, ambiguous, *_ = classify(batch.column(1), shared.value, evidence, ambiguous_below)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(ambiguous)], ["id", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, lang_pred string, score double, ambiguous boolean")


#: A text is in none of the languages if it agrees less than FAR of what is usual and its trigrams are less than
#: COMMON as frequent (what all languages hold agrees with none), or if it holds fewer than LEAST trigrams with a
#: letter (one letter alone is no evidence). No labelled row of the test tables lies below.
FAR, COMMON, LEAST = 0.3, 0.5, 4


def identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that decoding finds in one or several of the languages, with all their columns."""
    if not len(model.weights):
        return docs.where(F.lit(False))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, _, _, share, common, filled = classify(batch.column(batch.schema.get_field_index(text_col)), shared.value, EVIDENCE, AMBIGUOUS)
            yield batch.filter(pa.array((np.array(names) != UNKNOWN) & ((share >= FAR) | (common >= COMMON)) & (filled >= LEAST)))

    return docs.mapInArrow(trimmed(run), docs.schema)
