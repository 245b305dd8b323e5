"""Byte-level BPE over Arrow batches (operator 10).

The ranks become a model of the tokenizers library: bytes are written as printable characters and
each rank is a merge. A text is cut by the published pattern, every distinct piece is encoded once
per batch memo, and ids are joined again. Decoding maps ids to characters and the characters back to
bytes; a character whose bytes lie in several tokens comes out whole because bytes are joined first.

Null text is empty: no ids and empty bytes. A text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import trimmed

#: Entries of a worker's memo; it starts anew when full, so its memory is bounded.
MEMO = 400_000
#: Stands for no byte.
SEPARATOR = "\x01"
#: Pieces longer than this are merged one by one, outside the library and the memo.
LONG = 96


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b], spare = chr(spare), spare + 1
    return table


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge_exactly(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Always the lowest rank next, leftmost first; O(n log n) for a piece of n bytes."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        j = nxt[i]
        if j < n and (rank := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], nxt[i] = False, end[j], nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class ByteBPE:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from ahocorasick import Automaton
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        self.ranks = read_ranks(path)
        self.find = regex.compile(pattern).findall
        # where a token can be made of x + y and of y + z in x + y + z, the library's merges have an
        # order of their own and the ranks don't; pieces that hold such a string are merged exactly
        self.overlaps = Automaton()
        for token in self.ranks:
            for k in range(1, len(token)):
                x, y, z = token[:k], token[k:], token[len(token) - k :]
                if token.startswith(y) and x in self.ranks and y in self.ranks and z in self.ranks:
                    self.overlaps.add_word((token + z).decode("latin-1"), True)
        self.overlaps.make_automaton()
        characters = byte_characters()
        self.table = {b: c for b, c in enumerate(characters)}
        write = lambda token: "".join(map(characters.__getitem__, token))
        merges = [
            (write(token[:k]), write(token[k:]))
            for token, _ in sorted(self.ranks.items(), key=lambda x: x[1])
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        self.library = Tokenizer(BPE(vocab={write(t): r for t, r in self.ranks.items()}, merges=merges, cache_capacity=0))
        # a character that stands for no byte separates pieces, so that one call encodes many
        self.library.pre_tokenizer = pre_tokenizers.Split(SEPARATOR, "removed")
        back = {c: b for b, c in enumerate(characters)}
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for text, i in self.library.get_vocab().items():
            self.bytes_of[i] = bytes(map(back.__getitem__, text))
        self.memo: dict[str, tuple[int, ...]] = {}

    def learn(self, pieces: list[str]) -> None:
        """Put the ids of distinct pieces into the memo."""
        ask: list[str] = []
        written: list[str] = []
        memo, ranks, has = self.memo, self.ranks, self.overlaps.iter
        for piece in pieces:
            raw = piece.encode()
            known = ranks.get(raw)
            if known is not None:
                memo[piece] = (known,)
                continue
            plain = raw.decode("latin-1")
            if next(has(plain), None):
                memo[piece] = tuple(merge_exactly(raw, ranks))
            else:
                ask.append(piece)
                written.append(plain.translate(self.table))
        for at in range(0, len(ask), 512):
            got = self.library.encode(SEPARATOR.join(written[at : at + 512]), add_special_tokens=False)
            ids, of = got.ids, np.array(got.word_ids, np.int64)
            cut = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(ids)]
            for piece, a, b in zip(ask[at : at + 512], cut, cut[1:]):
                memo[piece] = tuple(ids[a:b])

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        split = [self.find(t) for t in texts]
        fresh = set(chain.from_iterable(split)).difference(self.memo)
        if len(self.memo) + len(fresh) > MEMO:
            self.memo.clear()
            fresh = set(chain.from_iterable(split))
        self.learn([p for p in fresh if len(p) <= LONG])
        known = self.memo.__getitem__
        out = []
        for pieces in split:
            try:
                out.append(list(chain.from_iterable(map(known, pieces))))
            except KeyError:
                out.append(list(chain.from_iterable(known(p) if len(p) <= LONG else merge_exactly(p.encode(), self.ranks) for p in pieces)))
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def offsets(self, ids: list[int]) -> list[tuple[int, int]]:
        """Code points that each token touches; a token inside a character touches that character."""
        data = self.decode_bytes(ids)
        starts = np.frombuffer(data, np.uint8) & 0xC0 != 0x80
        before = np.concatenate([[0], np.cumsum(starts)])
        out, at = [], 0
        for i in ids:
            stop = at + len(self.bytes_of[i])
            first = before[at] if at < len(data) and starts[at] else before[at] - 1
            out.append((int(max(first, 0)), int(before[stop])))
            at = stop
        return out

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode(self, ids) -> str:
        """Text of ids; bytes of a character cut at either end become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def bpe(path: str) -> ByteBPE:
    """One model for each Python worker and rank file."""
    return ByteBPE(path)


def encode_column(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``ids`` array<int>, and ``decoded`` binary made from the ids again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = model.encode_many([t or "" for t in part.column(1).to_pylist()])
                lists = pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()),
                    pa.array(np.fromiter(chain.from_iterable(ids), np.int32)),
                )
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(map(model.decode_bytes, ids), pa.binary())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), f"id {kind}, ids array<int>, decoded binary")


def decode_column(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """One row per row: the id and ``text`` decoded from its ids (null ids: null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path)
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(trimmed(run), f"id {kind}, text string")
