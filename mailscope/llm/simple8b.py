"""Token ids in Simple-8b words, written and read as blocks of whole documents.

A 64-bit word holds a selector in its top four bits and as many equal fields in the other 60 as the selector says.
Ids are coded in runs of 1024; a run begins with a word of its own, whose place is in the block's table, so that any
run can be decoded alone and all runs of a block at once. A value beyond 60 bits is an escape word and the value.

A block is its own unit: header, documents with their lengths, table, words. Blocks are rows of Parquet files that
Spark writes and commits, so they can be in any store and a task that is tried again leaves one copy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailscope.llm.scratch import scratch_path
from mailscope.llm.tokens import REMEMBERED_ALONE, encoder

#: Fixed values of the format. Selector 0 is the escape, 1 to 14 have fields of these widths, 15 is a word of zeros.
WIDTHS = (0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0)
COUNTS = np.array([1, *(60 // w for w in WIDTHS[1:15]), 120])
ESCAPE, ZEROS = 0, 15
MAGIC = b"S8B1"
HEADER = struct.Struct("<4sIIQQ")  # magic, documents, runs, ids, words
RUN = 1024
#: Ids after which a block is closed; a longer document is a block of its own.
BLOCK = 1 << 18


def _choices(padded: np.ndarray) -> np.ndarray:
    """The selector with most fields that can start at each value of each run; what follows a run's end is zeros."""
    best = np.full((len(padded), RUN), ESCAPE, np.uint8)
    fits = np.arange(best.size)  # narrower fields fit only where wider ones do
    largest = int(padded.max(initial=0))
    kind = np.uint64 if largest >> 32 else np.uint32  # half the memory to go through
    padded = padded.astype(kind)
    for selector in (*range(14, 0, -1), ZEROS):
        width, run = WIDTHS[selector], int(COUNTS[selector])
        if largest >> width:
            if len(fits) * run < padded.size // 2:
                row, at = np.divmod(fits, RUN)
                ok = (padded[row[:, None], at[:, None] + np.arange(run)] >> kind(width) == 0).all(1)
            else:
                large = np.zeros((len(padded), padded.shape[1] + 1), np.int16)
                np.cumsum(padded >> kind(width) != 0, axis=1, out=large[:, 1:])
                ok = (large[:, run : run + RUN] == large[:, :RUN]).reshape(-1)[fits]
            fits = fits[ok]
        if not len(fits):
            break
        best.reshape(-1)[fits] = selector
    return best


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of unsigned values and the table of each run's first word."""
    n = len(values)
    runs = -(-n // RUN)
    padded = np.zeros((runs, RUN + int(COUNTS.max())), np.uint64)
    padded[:, :RUN] = np.pad(values.astype(np.uint64), (0, runs * RUN - n)).reshape(runs, RUN)
    lengths = np.minimum(RUN, n - RUN * np.arange(runs))
    best = _choices(padded)
    at, found = np.zeros(runs, np.int64), []
    live = np.arange(runs)
    while len(live):  # all runs step from word to word together
        selectors = best[live, at[live]]
        found.append(np.stack([live, at[live], selectors]))
        at[live] += COUNTS[selectors]
        live = live[at[live] < lengths[live]]
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    run, start, selector = np.concatenate(found, axis=1)
    order = np.lexsort((start, run))
    run, start, selector = run[order], start[order], selector[order]
    places = np.cumsum(1 + (selector == ESCAPE)) - 1 - (selector == ESCAPE)
    words = np.zeros(len(selector) + int((selector == ESCAPE).sum()), np.uint64)
    for s in np.unique(selector):
        here = selector == s
        if s == ESCAPE:
            words[places[here] + 1] = padded[run[here], start[here]]
            continue
        fields = np.arange(COUNTS[s])
        taken = padded[run[here][:, None], start[here][:, None] + fields]
        shifted = taken << (fields * WIDTHS[s]).astype(np.uint64)
        words[places[here]] = np.bitwise_or.reduce(shifted, axis=1) | np.uint64(int(s) << 60)
    table = places[np.searchsorted(run, np.arange(runs))]
    return words, table.astype(np.uint32)


def decode(words: np.ndarray, table: np.ndarray, n: int) -> np.ndarray:
    """The values of `encode`, all runs at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selectors == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    counts = np.where(raw, 0, COUNTS[selectors])
    before = np.cumsum(counts) - counts
    run = np.searchsorted(table, np.arange(len(words)), "right") - 1
    start = before - before[table[run]]
    values = np.zeros(-(-n // RUN) * RUN, np.uint64)
    for s in np.unique(selectors[~raw]):
        here = np.flatnonzero((selectors == s) & ~raw)
        if s == ESCAPE:
            values[run[here] * RUN + start[here]] = words[here + 1]
            continue
        fields = np.arange(COUNTS[s])
        found = (words[here][:, None] >> (fields * WIDTHS[s]).astype(np.uint64)) & np.uint64((1 << WIDTHS[s]) - 1)
        inside = start[here][:, None] + fields < RUN
        values[(run[here][:, None] * RUN + start[here][:, None] + fields)[inside]] = found[inside]
    return values[:n]


def block(doc_ids: list[int | None], documents: list[np.ndarray]) -> bytes:
    """The bytes of a block."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    words, table = encode(ids)
    return b"".join([
        HEADER.pack(MAGIC, len(documents), len(table), len(ids), len(words)),
        np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([len(d) for d in documents], "<u8").tobytes(),
        table.astype("<u4").tobytes(), words.astype("<u8").tobytes(),
    ])


def unblock(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """Document ids and the ids of each document of a block."""
    magic, n_docs, n_runs, n_ids, n_words = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a block of token ids")
    at = HEADER.size

    def read(kind: str, count: int) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(data, kind, count, at)
        at += found.nbytes
        return found

    nulls, doc_ids, lengths = read("u1", n_docs), read("<i8", n_docs), read("<u8", n_docs)
    table, words = read("<u4", n_runs), read("<u8", n_words)
    ids = decode(words, table.astype(np.int64), n_ids)
    names = [None if null else int(d) for null, d in zip(nulls, doc_ids)]
    return names, np.split(ids, np.cumsum(lengths[:-1]).astype(np.int64)) if n_docs else []


BLOCKS = "shard int, block int, first_id long, n_ids long, data binary"


def write_tokens(documents: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end: int = 1) -> None:
    """Encode every whole text, with `end` after it, and write blocks in ascending `doc_id` to `path`, nulls first.

    A shard is a range of `doc_id`, numbered in their order; rows of one `doc_id` follow each other by text. Null and
    empty texts are the `end` alone. Other columns are ignored. No rows in, no blocks out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, shard = encoder(tokenizer, REMEMBERED_ALONE).batch, TaskContext.get().partitionId()
        doc_ids: list[int | None] = []
        found: list[np.ndarray] = []
        first = size = number = 0

        def row() -> pa.RecordBatch:
            columns = [[shard], [number], [first], [size], [block(doc_ids, found)]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(batch.column(1).to_pylist(), end)):
                doc_ids.append(doc_id)
                found.append(ids)
                size += len(found[-1])
                if size >= BLOCK:
                    yield row()
                    first, size, number = first + size, 0, number + 1
                    doc_ids.clear()
                    found.clear()
        if found:
            yield row()

    # Rows of one id, or of none, are dealt by their texts, so that no number of them meets in one task.
    chosen = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("_digest"))
    ordered = chosen.repartitionByRange("doc_id", "_digest").sortWithinPartitions("doc_id", "_digest", "text").drop("_digest")
    ordered.mapInArrow(run, BLOCKS).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document in the files: `doc_id`, `start` (ids of all documents before it), `n_tokens`, `ids_crc32`
    (of the ids as unsigned 32-bit little-endian numbers) and, if asked for, `ids`.

    Where a shard starts follows from the sizes in the files, one row per shard.
    """
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_ids"))
    shards = sizes.select(F.col("shard"), (F.sum("_ids").over(Window.orderBy("shard")) - F.col("_ids")).alias("_base"))
    placed = blocks.join(shards, "shard").select((F.col("_base") + F.col("first_id")).alias("start"), "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0), batch.column(1)):
                names, documents = unblock(data.as_py())
                lengths = np.array([len(d) for d in documents], np.int64)
                crcs = [zlib.crc32(d.astype("<u4").tobytes()) for d in documents]
                columns = [
                    pa.array(names, pa.int64()), pa.array(start.as_py() + np.cumsum(lengths) - lengths), pa.array(lengths), pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([d.astype(np.int64) for d in documents], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def round_trip(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = 1) -> DataFrame:
    """`write_tokens` to a new place in the shared folder, then `read_tokens` from it."""
    path = scratch_path(documents.sparkSession, "tokens")
    write_tokens(documents, path, tokenizer, end)
    return read_tokens(documents.sparkSession, path)
