"""Packs examples into sequences under limits on tokens, segments and loss-bearing tokens.

Vector bin packing: the piece placed next is the one, of those that fit, with the greatest dot
product of its sizes with what the open sequence has left, both as shares of the limits and
weighted by how much of each limit the waiting pieces ask for. Examples are cut: whole
sequences come off the front of those over a limit, only the rest is placed; a gap that nothing
fits is filled from the largest waiting piece; and what a sequence still lacks is spared by
cutting it into lengths that are powers of two, which need no padding.

Each task packs the examples that it reads, with a bounded number of them waiting; nothing is
shuffled, and every task leaves at most a dozen short sequences. A sequence's number holds
its task's, so a task that is run again gives the same numbers for the same rows.

Defined cases: a null or empty text is one piece, of the end id; a null id is kept; repeated
rows are examples of their own; a text of any length is cut into as many pieces as it needs; an
example without tokens has one piece of length 0, alone; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, slices_of
from tidemark.llm.records import encoder


class Limits(NamedTuple):
    """Of a sequence, and how packing works: ``waiting`` pieces are held by a task, and no piece
    shorter than ``least`` is cut to fill a gap."""

    tokens: int = 4096
    segments: int = 512
    loss: int = 4096
    waiting: int = 2048
    least: int = 8


class Piece(NamedTuple):
    """Tokens [start, start + length) of an example."""

    example: int
    start: int
    length: int
    loss: int


class Examples:
    """The examples that a packer still needs, by number: ids, and which of them bear loss."""

    def __init__(self):
        self.held: dict[int, list] = {}

    def add(self, number: int, key, ids: np.ndarray, mask: np.ndarray | None) -> None:
        sums = None if mask is None else np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        self.held[number] = [key, ids, sums, 0, len(ids), len(ids)]  # first token held, tokens, tokens not yet placed

    def forget(self, number: int, start: int) -> None:
        """Tokens before ``start`` are placed: don't hold them."""
        held = self.held[number]
        at = start - held[3]
        held[1], held[2], held[3] = held[1][at:].copy(), None if held[2] is None else held[2][at:].copy(), start

    def tokens(self, number: int) -> int:
        return self.held[number][4]

    def piece(self, number: int, start: int, length: int) -> Piece:
        _, _, sums, base, *_ = self.held[number]
        return Piece(number, start, length, length if sums is None else int(sums[start - base + length] - sums[start - base]))

    def fitting(self, number: int, start: int, tokens: int, loss: int) -> int:
        """How many tokens from ``start`` on fit."""
        _, _, sums, base, n, _ = self.held[number]
        if sums is None:
            return min(tokens, loss, n - start)
        at = start - base
        return min(tokens, n - start, int(np.searchsorted(sums, sums[at] + loss, "right")) - 1 - at)

    def placed(self, piece: Piece) -> tuple:
        """Key, ids of the piece and tokens of its example, which is given up with its last piece."""
        held = self.held[piece.example]
        key, ids, _, base, n, _ = held
        held[5] -= piece.length
        if not held[5]:
            del self.held[piece.example]
        return key, ids[piece.start - base : piece.start - base + piece.length], n


#: Sizes of a place in the pool that holds no piece.
NOWHERE = 1e18


class Packer:
    """Sequences, as lists of pieces, from examples that come in any number."""

    def __init__(self, limits: Limits, examples: Examples):
        if min(limits.tokens, limits.segments, limits.loss, limits.waiting, limits.least) < 1:
            raise ValueError("limits are 1 at least")
        self.limits, self.examples = limits, examples
        self.full = np.array([limits.tokens, limits.segments, limits.loss], np.float64)
        self.pool: list[Piece | None] = []
        self.sizes = np.zeros((2 * limits.waiting, 3))
        self.free: list[int] = []
        self.count = 0

    def add(self, number: int) -> Iterator[list[Piece]]:
        """Takes an example; yields the sequences that get ready."""
        n, start = self.examples.tokens(number), 0
        while True:
            take = self.examples.fitting(number, start, self.limits.tokens, self.limits.loss)
            if start + take == n:
                break
            take = max(take, 1)
            yield from self._cut([self.examples.piece(number, start, take)])
            start += take
        rest = self.examples.piece(number, start, n - start)
        if start:
            self.examples.forget(number, start)
        if rest.length in (0, self.limits.tokens):
            yield [rest]
        else:
            self._wait(rest)
        if self.count >= self.limits.waiting:
            yield from self._pack(self.limits.waiting // 2)

    def finish(self) -> Iterator[list[Piece]]:
        yield from self._pack(0)

    def _wait(self, piece: Piece) -> None:
        if self.free:
            at = self.free.pop()
            self.pool[at] = piece
        else:
            at = len(self.pool)
            self.pool.append(piece)
        self.sizes[at] = (piece.length, 1, piece.loss)
        self.count += 1

    def _take(self, at: int) -> Piece:
        piece, self.pool[at] = self.pool[at], None
        self.sizes[at] = NOWHERE
        self.free.append(at)
        self.count -= 1
        return piece

    def _pack(self, until: int) -> Iterator[list[Piece]]:
        while self.count > until:
            n = len(self.pool)
            sizes = self.sizes[:n]
            shares = sizes / self.full
            weights = shares[sizes[:, 1] == 1].mean(0)
            left, sequence = self.full.copy(), []
            while True:
                score = shares @ (weights * left / self.full)
                score[(sizes > left).any(1)] = -1
                at = int(np.argmax(score))
                if score[at] < 0:
                    break
                left -= sizes[at]
                sequence.append(self._take(at))
                if left[0] < 1 or left[1] < 1:
                    break
            yield from self._cut(self._filled(sequence, left))

    def _filled(self, sequence: list[Piece], left: np.ndarray) -> list[Piece]:
        """Fills a gap from the front of the largest waiting piece."""
        if min(left[0], left[2]) >= self.limits.least and left[1] >= 1 and self.count:
            n = len(self.pool)
            at = int(np.argmax(np.where(self.sizes[:n, 1] == 1, self.sizes[:n, 0], -1)))
            piece = self.pool[at]
            take = self.examples.fitting(piece.example, piece.start, int(left[0]), int(left[2]))
            if self.limits.least <= take <= piece.length - self.limits.least:
                self._take(at)
                sequence.append(self.examples.piece(piece.example, piece.start, take))
                self._wait(self.examples.piece(piece.example, piece.start + take, piece.length - take))
        return sequence

    def _cut(self, sequence: list[Piece]) -> Iterator[list[Piece]]:
        """The sequence, or its tokens in sequences whose lengths are powers of two if too many would be padded."""
        length = sum(p.length for p in sequence)
        if length & (length - 1) == 0 or self.limits.tokens - length < self.limits.least:
            yield sequence
            return
        pieces = sequence[::-1]
        for bit in reversed(range(length.bit_length())):
            part, room = [], length & 1 << bit
            while room:
                piece = pieces.pop()
                if piece.length > room:
                    pieces.append(self.examples.piece(piece.example, piece.start + room, piece.length - room))
                    piece = self.examples.piece(piece.example, piece.start, room)
                part.append(piece)
                room -= piece.length
            if part:
                yield part


PLACED = "start long, length long, ids binary, example_tokens long, sequence_id long, offset long"


def pack(examples: DataFrame, id_col: str, ids_col: str = "ids", mask_col: str | None = None, limits: Limits | None = None) -> DataFrame:
    """Examples of token ids (32-bit little-endian, as bytes), of which ``mask_col`` says by a byte for
    each token whether it bears loss (null: all do). Returns a row for each piece: the id, start, length,
    ids, example_tokens, and where it lies: sequence_id and offset.

    Pieces of one task lie in its own sequences; limits hold for each.
    """
    rows = examples.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"), *([F.col(mask_col).alias("_mask")] if mask_col else []))
    return _packed(rows, lambda part: _given(part, bool(mask_col)), 1, limits or Limits()).withColumnRenamed("_id", id_col)


def _given(part: pa.RecordBatch, masked: bool) -> Iterator[tuple]:
    masks = part.column(2).to_pylist() if masked else [None] * len(part)
    for ids, mask in zip(part.column(1).to_pylist(), masks, strict=True):
        tokens = np.frombuffer(ids or b"", "<u4")
        mask = None if mask is None else np.frombuffer(mask, np.uint8) != 0
        if mask is not None and len(mask) != len(tokens):
            raise ValueError("a mask has a byte for each token")
        yield tokens, mask


def pack_texts(docs: DataFrame, tokenizer_file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", limits: Limits | None = None) -> DataFrame:
    """``pack`` for texts, encoded whole where they are read; all tokens bear loss."""

    def encoded(part: pa.RecordBatch) -> Iterator[tuple]:
        enc = encoder(tokenizer_file, end_id)
        for ids in enc.encode(part.column(1)):
            yield np.frombuffer(ids, enc.dtype), None

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return _packed(rows, encoded, 1, limits or Limits()).withColumnRenamed("_id", id_col)


def _packed(rows: DataFrame, read, by_size_of: int, limits: Limits) -> DataFrame:
    def run(batches):
        from pyspark import TaskContext

        examples, number, out = Examples(), 0, _Out(TaskContext.get().partitionId())
        packer = Packer(limits, examples)
        for batch in batches:
            out.id_type = batch.schema.field(0).type
            for part in slices_of(batch, by_size_of, 4_000_000):
                for key, (ids, mask) in zip(part.column(0).to_pylist(), read(part), strict=True):
                    examples.add(number, key, ids, mask)
                    for sequence in packer.add(number):
                        yield from out.put(sequence, examples)
                    number += 1
        for sequence in packer.finish():
            yield from out.put(sequence, examples)
        yield from out.flush()

    return small_batches(rows).mapInArrow(run, f"_id {rows.schema['_id'].dataType.simpleString()}, {PLACED}")


class _Out:
    """Rows of placed pieces, in batches of some megabytes."""

    def __init__(self, task: int):
        self.task, self.sequences, self.rows, self.size, self.id_type = task, 0, [], 0, None

    def put(self, sequence: list[Piece], examples: Examples) -> Iterator[pa.RecordBatch]:
        offset, sequence_id = 0, self.task << 32 | self.sequences
        self.sequences += 1
        for p in sequence:
            key, ids, n = examples.placed(p)
            data = ids.astype("<u4").tobytes()
            self.rows.append((key, p.start, p.length, data, n, sequence_id, offset))
            offset += p.length
            self.size += len(data) + 64
        if self.size > 4_000_000:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            kinds = [self.id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["_id", *(c.split()[0] for c in PLACED.split(", "))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), kinds, strict=True)], names=names)
            self.rows, self.size = [], 0
