"""Vector bin packing of tokenized examples into training sequences.

A sequence has three limits at once: tokens, segments (pieces of examples in it) and loss-bearing tokens. Sequences are filled one after the other from a pool of
open pieces by the dot-product heuristic: of the pieces that still fit, the one whose needs, each as a share of its limit, have the largest dot product with
what the sequence has left of each limit. So a sequence with many tokens and few segments left takes a long piece, and one that is short of loss takes a
prompt-heavy piece.

Plain documents may be cut anywhere: what is as long as a sequence is cut off first, and a sequence that no piece fits is filled up with the beginning of the
largest one. What a task has left at its end goes into sequences whose lengths are powers of two. Examples (``cut=False``) stay whole unless they exceed a limit alone.

Scale: one pass over the input's partitions, without a shuffle: each task fills sequences of its own from a pool of at most ``POOL`` pieces, so memory does not
depend on the rows, on equal rows or on a key's rows. Sequence ids are the partition's number times 2^33 plus a number in it; a task that runs again for a
lost executor makes the same sequences from the same rows. Rows that come from a shuffle should be written or checkpointed before.

Defined results: a null or empty text is its closing id alone; equal rows are packed each for itself; rows that share an id or have none keep it; an empty
table gives no rows; extra columns are left out; very long texts are encoded whole and held as ids of 4 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import ByteTokens, batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The id that closes each example.
END = 0
#: Open pieces of a task.
POOL = 1_024


@dataclass(frozen=True)
class Limits:
    """Most tokens, segments and loss-bearing tokens of a sequence."""

    tokens: int = 1_024
    segments: int = 256
    loss: int = 1_024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError("limits must be positive")


@dataclass
class Piece:
    """Part of an example: its row, place, ids, and how many of the ids up to each one bear loss (None: all but the closing one)."""

    row: object
    total: int
    start: int
    ids: np.ndarray
    before: np.ndarray | None = None

    def loss(self, n: int) -> int:
        """Loss-bearing ones of the first ``n`` ids."""
        if self.before is None:
            return n - (self.start + n == self.total)
        return int(self.before[self.start + n] - self.before[self.start])

    def fits(self, n: int, loss: int) -> int:
        """How many ids, ``n`` at most, bear no more than ``loss``."""
        if self.loss(n) <= loss:
            return n
        if self.before is None:
            return loss
        own = self.before[self.start : self.start + n + 1]
        return int(np.searchsorted(own, own[0] + loss, side="right")) - 1

    def split(self, n: int) -> tuple[Piece, Piece | None]:
        first = Piece(self.row, self.total, self.start, self.ids[:n], self.before)
        return first, Piece(self.row, self.total, self.start + n, self.ids[n:], self.before) if n < len(self.ids) else None


class Packer:
    """Pieces in, finished sequences (lists of pieces) out."""

    def __init__(self, limits: Limits, cut: bool = True, pool: int = POOL):
        self.limits, self.cut = limits, cut
        self.pieces: list[Piece | None] = [None] * (pool + 1)
        self.need = np.full((pool + 1, 3), np.inf)  # tokens, segments, loss; infinite where there is no piece
        self.free, self.held = list(range(pool, -1, -1)), 0

    def _keep(self, p: Piece) -> None:
        at = self.free.pop()
        self.pieces[at], self.need[at] = p, (len(p.ids), 1, p.loss(len(p.ids)))
        self.held += len(p.ids)

    def _take(self, at: int) -> Piece:
        p, self.pieces[at] = self.pieces[at], None
        self.need[at] = np.inf
        self.free.append(at)
        self.held -= len(p.ids)
        return p

    def add(self, p: Piece) -> Iterator[list[Piece]]:
        most = self.limits
        while p is not None and (len(p.ids) >= most.tokens or p.loss(len(p.ids)) > most.loss):
            first, p = p.split(max(1, p.fits(min(len(p.ids), most.tokens), most.loss)))
            if len(first.ids) == most.tokens or not self.cut:
                yield [first]
            else:
                yield from self._open(first)
        if p is not None:
            yield from self._open(p)

    def _open(self, p: Piece) -> Iterator[list[Piece]]:
        self._keep(p)
        if len(self.free) == 0:
            while len(self.free) * 2 < len(self.pieces):
                yield self._filled(self.limits.tokens)

    def rest(self) -> Iterator[list[Piece]]:
        while self.held:
            room = self.limits.tokens
            if self.cut and self.held < room:
                room = 1 << (self.held.bit_length() - 1)
            yield self._filled(room)

    def _filled(self, tokens: int) -> list[Piece]:
        most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        left, out = np.array([tokens, most[1], most[2]], float), []
        share = np.where(np.isinf(self.need), 0.0, self.need) / most
        live = (self.need <= left).all(axis=1)
        while left[0] and left[1]:
            value = np.where(live, share @ (left / most), -1.0)
            at = int(np.argmax(value))
            if value[at] < 0:
                break
            left -= self.need[at]
            out.append(self._take(at))
            live &= (self.need <= left).all(axis=1)
        if self.cut and left[0] and left[1] and self.held:
            at = int(np.argmax(np.where(np.isinf(self.need[:, 0]), -1.0, self.need[:, 0])))
            n = self.pieces[at].fits(int(min(left[0], len(self.pieces[at].ids))), int(left[2]))
            if n:
                first, more = self._take(at).split(n)
                out.append(first)
                if more is not None:
                    self._keep(more)
        return out


@lru_cache(2)
def _tokens(path: str) -> ByteTokens:
    return ByteTokens(path, special=True)


_PIECES = ("start", "length", "doc_tokens", "sequence_id", "offset")


def _rows(found: Iterator[list[Piece]], base: int, kind: pa.DataType, name: str) -> Iterator[pa.RecordBatch]:
    """Finished sequences as rows, in batches."""
    keys, ids, numbers, n = [], [], [], 0

    def batch() -> pa.RecordBatch:
        own = np.array(numbers, np.int64).reshape(-1, len(_PIECES))
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array(own[:, i]) for i in range(len(_PIECES))], pa.array(ids, pa.binary())], [name, *_PIECES, "ids"])

    for sequence in found:
        offset = 0
        for p in sequence:
            keys.append(p.row)
            ids.append(p.ids.tobytes())
            numbers.append((p.start, len(p.ids), p.total, base + n, offset))
            offset += len(p.ids)
        n += 1
        if len(keys) >= 2_000:
            yield batch()
            keys, ids, numbers = [], [], []
    if keys:
        yield batch()


def _packed(limits: Limits, path: str, cut: bool, name: str):
    def pieces(columns: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
        tokens = _tokens(path)
        for b in columns:
            rows, texts = b.column(0), b.column(1)
            at = 0
            if pa.types.is_list(texts.type):  # parts of an example with their loss
                for row, parts in zip(rows.to_pylist(), texts.to_pylist(), strict=True):
                    parts = [(p["text"] or "", bool(p["loss"])) for p in parts or [] if p is not None]
                    found = [np.array(x, np.uint32) for x in tokens.encode([t for t, _ in parts])]
                    ids = np.concatenate([*found, np.array([END], np.uint32)])
                    bears = np.concatenate([*(np.full(len(x), loss) for x, (_, loss) in zip(found, parts, strict=True)), [bool(parts and parts[-1][1])], []]).astype(bool)
                    yield Piece(row, len(ids), 0, ids, np.concatenate([[0], np.cumsum(bears)]))
                continue
            for few in batches(t or "" for t in texts.to_pylist()):
                for x in tokens.encode(few):
                    x.append(END)
                    ids = np.array(x, np.uint32)
                    yield Piece(rows[at].as_py(), len(ids), 0, ids)
                    at += 1

    def run(columns: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, cut)

        def sequences() -> Iterator[list[Piece]]:
            for p in pieces(columns):
                yield from packer.add(p)
            yield from packer.rest()

        columns = iter(columns)
        first = next(columns, None)
        if first is not None:
            kind, rest = first.schema.field(0).type, columns
            columns = (b for part in ([first], rest) for b in part)
            yield from _rows(sequences(), TaskContext.get().partitionId() << 33, kind, name)

    return run


def pack(rows: DataFrame, *, id: str = "doc_id", text: str = "text", limits: Limits = Limits(), tokenizer: str = TOKENIZER, cut: bool = True) -> DataFrame:  # noqa: A002, B008
    """Pieces of the examples: id, start (ids of the example before it), length, doc_tokens (all ids with the closing one), sequence_id, offset in its
    sequence, ids (binary, 32-bit little-endian).

    ``text`` is a column of texts, whose ids all bear loss but for the closing one, or an array of structs (text, loss): parts such as the turns of a
    conversation, whose ids bear loss as ``loss`` says; the closing id goes with the last part.
    """
    kind = rows.schema[id].dataType.simpleString()
    numbers = ", ".join(f"{c} long" for c in _PIECES)
    return rows.select(id, text).mapInArrow(_packed(limits, tokenizer, cut, id), f"`{id}` {kind}, {numbers}, ids binary")


def report(packed: DataFrame) -> DataFrame:
    """The pieces with the checksum of their ids in their place."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
