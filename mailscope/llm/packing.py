"""Packing token sequences as vector bin packing.

A sequence has limits on tokens, on segments (pieces of examples) and on loss-bearing tokens. One sequence is open
at a time. The next example is the one that fits whose demands have the largest dot product with what is left of
each limit, so a sequence with much room for tokens and little for segments takes long examples. When nothing fits,
an example may be cut to fill the rest. Every partition packs its own rows from a pool of bounded size; nothing is
shuffled, and a partition leaves one sequence at most that is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.llm.batches import map_batches
from mailscope.llm.tokens import encoder

#: Examples in a partition's pool, and rows taken from Spark at a time.
POOL, ROWS = 4096, 1024
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
)


@dataclass(frozen=True)
class Limits:
    """Of one sequence. `cut`: whether examples may be cut; longer ones than a sequence always are. What a partition
    has over is laid out in sequences of falling powers of two, `smallest` at least, which need no padding."""

    tokens: int = 2048
    segments: int = 512
    loss: int = 2048
    cut: bool = True
    smallest: int = 16


@dataclass(frozen=True)
class Piece:
    """`ids` and their loss flags (None: all bear loss) from `start` on in example `doc_id` of `total` tokens."""

    doc_id: int | None
    start: int
    total: int
    ids: np.ndarray
    loss: np.ndarray | None

    @property
    def demand(self) -> tuple[int, int]:
        return len(self.ids), len(self.ids) if self.loss is None else int(self.loss.sum())

    def split(self, at: int) -> tuple[Piece, Piece]:
        first, rest = (None, None) if self.loss is None else (self.loss[:at], self.loss[at:])
        return (
            Piece(self.doc_id, self.start, self.total, self.ids[:at], first),
            Piece(self.doc_id, self.start + at, self.total, self.ids[at:], rest),
        )

    def head(self, tokens: int, loss: int) -> int:
        """How many tokens from the front stay within both."""
        if self.loss is None:
            return min(tokens, loss, len(self.ids))
        within = np.searchsorted(np.cumsum(self.loss), loss, "right")
        return int(min(tokens, within, len(self.ids)))


class Pool:
    """Pieces by demand; equal demands share an entry, so a choice looks at each demand once, and at those in the pool only:
    the last entry takes the place of one that is used up."""

    def __init__(self) -> None:
        self._slot: dict[tuple[int, int], int] = {}
        self._stacks: list[list[Piece]] = []
        self._tokens, self._loss, self._count = (np.zeros(256, np.int64) for _ in range(3))
        self.size = 0

    def add(self, piece: Piece) -> None:
        slot = self._slot.setdefault(piece.demand, len(self._stacks))
        if slot == len(self._stacks):
            self._stacks.append([])
            if slot == len(self._count):
                grown = (np.concatenate([a, np.zeros_like(a)]) for a in (self._tokens, self._loss, self._count))
                self._tokens, self._loss, self._count = grown
            self._tokens[slot], self._loss[slot] = piece.demand
        self._stacks[slot].append(piece)
        self._count[slot] += 1
        self.size += 1

    def take(self, left: tuple[int, int], limits: Limits) -> Piece | None:
        """The piece that fits into `left` (tokens, loss) with the largest dot product of shares of the limits.

        Every piece takes one segment, so segments bear on whether a piece fits, not on which."""
        used = len(self._stacks)
        tokens, loss = self._tokens[:used], self._loss[:used]
        fits = np.flatnonzero((tokens <= left[0]) & (loss <= left[1]))
        if not len(fits):
            return None
        worth = tokens[fits] * (left[0] / limits.tokens**2) + loss[fits] * (left[1] / limits.loss**2)
        return self._pop(int(fits[worth.argmax()]))

    def longest(self) -> Piece | None:
        used = len(self._stacks)
        if not self.size:
            return None
        return self._pop(int(self._tokens[:used].argmax()))

    def _pop(self, slot: int) -> Piece:
        self._count[slot] -= 1
        self.size -= 1
        piece = self._stacks[slot].pop()
        if not self._stacks[slot]:
            del self._slot[piece.demand]
            last = len(self._stacks) - 1
            moved = self._stacks.pop()
            if slot != last:
                self._stacks[slot] = moved
                self._slot[moved[0].demand] = slot
                for numbers in (self._tokens, self._loss, self._count):
                    numbers[slot] = numbers[last]
        return piece

    def __iter__(self) -> Iterator[Piece]:
        return (piece for stack in self._stacks for piece in stack)


def _fill(pool: Pool, limits: Limits, room: int) -> list[Piece]:
    """One sequence of at most `room` tokens."""
    sequence: list[Piece] = []
    tokens, loss = room, limits.loss
    while tokens and len(sequence) < limits.segments and pool.size:
        piece = pool.take((tokens, loss), limits)
        if piece is None:
            if not limits.cut and sequence:
                break
            whole = pool.longest()
            at = whole.head(tokens, loss)
            if not at:
                pool.add(whole)
                break
            piece, rest = whole.split(at)
            if len(rest.ids):
                pool.add(rest)
        sequence.append(piece)
        tokens -= piece.demand[0]
        loss -= piece.demand[1]
    return sequence


def sequences(pieces: Iterable[Piece], limits: Limits) -> Iterator[list[Piece]]:
    """Pack pieces from a pool that is kept full; what is over at the end goes into powers of two where that fits."""
    pool = Pool()
    for piece in pieces:
        while len(piece.ids) > limits.tokens or piece.demand[1] > limits.loss:
            full, piece = piece.split(piece.head(limits.tokens, limits.loss))
            yield [full]
        pool.add(piece)
        if pool.size >= POOL:  # refill after half is gone, so that choices stay wide
            while pool.size > POOL // 2:
                yield _fill(pool, limits, limits.tokens)
    over = sum(len(piece.ids) for piece in pool)
    while pool.size:
        room = limits.tokens
        if limits.cut and limits.smallest <= over < room:
            room = 1 << (over.bit_length() - 1)
        sequence = _fill(pool, limits, room)
        over -= sum(len(p.ids) for p in sequence)
        yield sequence


def _rows(pieces: Iterable[Piece], limits: Limits, with_ids: bool) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 40
    columns: list[list] = [[] for _ in range(8 + with_ids)]
    names = [c.split()[0] for c in SCHEMA.split(", ")] + ["ids"] * with_ids

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64()] * 8 + [pa.list_(pa.int64())] * with_ids
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        for c in columns:
            c.clear()
        return pa.RecordBatch.from_arrays(arrays, names=names)

    for number, sequence in enumerate(sequences(pieces, limits)):
        offset = 0
        for p in sequence:
            length, loss = p.demand
            row = (p.doc_id, p.start, length, zlib.crc32(p.ids.astype("<u4").tobytes()), p.total, first + number, offset, loss)
            for column, value in zip(columns, row + (p.ids,) * with_ids):
                column.append(value)
            offset += length
        if len(columns[0]) >= ROWS:
            yield batch()
    yield batch()


def pack_documents(
    documents: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 1, limits: Limits = Limits(), with_ids: bool = False
) -> DataFrame:
    """One row per piece: `doc_id`, `start` (ids of its document before it), `length`, `ids_crc32`, `doc_tokens`,
    `sequence_id`, `offset` (in its sequence), `loss_tokens`, and `ids` if asked for.

    A document's ids are those of its text and `end`; all bear loss. Null and empty texts are the `end` alone.
    Repeated rows each are packed; a null `doc_id` stays null. Other columns are ignored. No rows in, no rows out.
    Sequences are numbered within partitions of the input, so another split of the input numbers them otherwise.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).batch

        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist(), end)):
                    yield Piece(doc_id, 0, len(ids), ids, None)

        return _rows(pieces(), limits, with_ids)

    schema = SCHEMA + ", ids array<long>" * with_ids
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def pack_examples(examples: DataFrame, limits: Limits = Limits(cut=False), with_ids: bool = False) -> DataFrame:
    """Pack instruction data, given as `doc_id`, `ids` (array) and `loss` (array of 0 and 1, or null for all 1).

    Result as `pack_documents`. Without `cut`, only examples beyond a limit on their own are cut. Examples without
    ids, or with null ids, have no piece. A loss array is read as far as there are ids and taken as 0 beyond its end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[Piece]:
            for batch in batches:
                for doc_id, ids, loss in zip(*batch.columns):
                    found = np.array(ids.as_py() or [], np.uint32)
                    flags = None
                    if loss.is_valid:
                        flags = np.zeros(len(found), np.int64)
                        given = np.array(loss.as_py()[: len(found)], np.int64)
                        flags[: len(given)] = given
                    if len(found):
                        yield Piece(doc_id.as_py(), 0, len(found), found, flags)

        return _rows(pieces(), limits, with_ids)

    schema = SCHEMA + ", ids array<long>" * with_ids
    chosen = examples.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<long>"), F.col("loss").cast("array<int>"))
    return chosen.mapInArrow(run, schema)


def conversation_examples(formatted: DataFrame, tokenizer: str = "byte_bpe_50k.json", end: int = 1) -> DataFrame:
    """`doc_id`, `ids` and `loss` of formatted conversations (`conv_id`, `block`, `blocks`, `text`, `spans`), a row per block.

    What is to be learned and what stands between is encoded apart, so that no token is of both; `end` follows the last
    block and bears no loss. Empty texts have no ids but `end`. No rows in, no rows out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).batch
        for batch in batches:
            rows, cuts, learned = [], [], []
            for block, blocks, text, spans in zip(*batch.columns[1:]):
                text, at, first = text.as_py() or "", 0, len(cuts)
                for span in spans.as_py() or ():
                    cuts += [text[at : span["start"]], text[span["start"] : span["end"]]]
                    learned += [0, 1]
                    at = span["end"]
                cuts.append(text[at:])
                learned.append(0)
                rows.append((slice(first, len(cuts)), block.as_py() == blocks.as_py() - 1))
            found = list(encode(cuts))
            ids, loss = [], []
            for cut, last in rows:
                tail = [np.array([end] * last, np.uint32)]
                ids.append(np.concatenate(found[cut] + tail).astype(np.int64))
                loss.append(np.repeat(np.array(learned[cut] + [0], np.int32), [*map(len, found[cut]), len(tail[0])]))
            columns = [batch.column(0), pa.array(ids, pa.list_(pa.int64())), pa.array(loss, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "loss"])

    chosen = formatted.select("conv_id", "block", "blocks", "text", "spans")
    return map_batches(chosen, run, "doc_id long, ids array<long>, loss array<int>")


#: Limits of instruction data: fewer segments and less learned text than a sequence has room for.
INSTRUCTIONS = Limits(tokens=2048, segments=16, loss=1024, cut=False)


def pack_conversations(formatted: DataFrame, limits: Limits = INSTRUCTIONS) -> DataFrame:
    """Formatted conversations packed under all three limits; see :func:`pack_examples`."""
    return pack_examples(conversation_examples(formatted), limits)
