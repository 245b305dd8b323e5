"""Packing by power-of-two decomposition (operator 6).

A document's ids are cut into pieces whose lengths are the whole maximum and then the binary digits
of the rest, longest first. Each piece is a sequence by itself, so no sequence crosses documents and
none needs padding; pieces of one length form a bucket, and a batch takes one bucket. The cut needs
no other document: the operator is one narrow stage and a hot source or a long text moves nothing.

Null text is empty and still has its end id. Repeated rows are packed once each.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import trimmed

#: Bytes of ids that a worker gathers before it hands a batch on.
FLUSH = 8 << 20
#: The two libraries split texts of these characters alike; others go through tokenizers.
LATIN = re.compile("[^\x00-ɏ]")


class Encoder:
    """Ids of the tokenizer file. Its merges run in tiktoken over the same vocabulary's rank file
    (about seven times as fast, same ids); texts with characters beyond Latin go through tokenizers."""

    def __init__(self, json_path: str, ranks_path: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.json_path, self.fast = json_path, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.json_path)
        found.encode_special_tokens = True
        return found

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None and not LATIN.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def encoder(json_path: str, ranks_path: str | None) -> Encoder:
    return Encoder(json_path, ranks_path)


def binary_lengths(n: int, most: int) -> list[int]:
    """``most`` as often as it fits, then the binary digits of the rest from the largest."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(
    docs: DataFrame, json_path: str, ranks_path: str | None = None, most: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    bucket (log2 of the length), sequence_id (unique) and offset (0: a piece fills its sequence)."""
    if most & (most - 1) or most < 1:
        raise ValueError("the longest sequence must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(json_path, ranks_path)
        names = ["row", "start", "length", "ids", "doc_tokens"]

        def made(ids: pa.Array, rows: list, held: list) -> pa.RecordBatch:
            start, length, data, total = zip(*held)
            cols = [ids.take(pa.array(rows)), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary()), pa.array(total, pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            rows: list[int] = []
            held: list[tuple] = []
            size = 0
            for row, text in enumerate(batch.column(1)):
                text = text.as_py()
                ids = np.append(model.ids(text) if text else np.zeros(0, "<u4"), np.array([end_id], "<u4")).tobytes()
                n, at = len(ids) // 4, 0
                for length in binary_lengths(n, most):
                    held.append((at, length, ids[4 * at : 4 * (at + length)], n))
                    rows.append(row)
                    at += length
                size += len(ids)
                if size >= FLUSH:
                    yield made(batch.column(0), rows, held)
                    rows, held, size = [], [], 0
            if held:
                yield made(batch.column(0), rows, held)

    kind = docs.schema[id_col].dataType.simpleString()
    pieces = docs.select(F.col(id_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"row {kind}, start long, length long, ids binary, doc_tokens long")
    return pieces.select(
        F.col("row").alias(id_col),
        "start",
        "length",
        "ids",
        "doc_tokens",
        F.log2("length").cast("int").alias("bucket"),
        # a task that is run again reads the same split in the same order and so gives the same ids
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
