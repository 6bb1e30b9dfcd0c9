"""Conversations as training texts with a mask of what is to be learned, by a compiled template.

The output has a row per block of consecutive turns: the formatted text and where learned text starts and ends in it. A
conversation of up to `LARGE` turns is one block and is put together by one task. The turns of a longer one are numbered
by running totals over chunks first, so its blocks are rendered wherever they fall; no task holds a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.llm.batches import map_batches
from mailscope.llm.prefix import hashed_shifts, total_before
from mailscope.llm.scratch import materialise
from mailscope.llm.template import Rendered, Template, unescape, unline

#: Turns of a conversation that is one block.
LARGE = 1024
#: Turns of a block of a longer one.
BLOCK = 256
#: Characters that go out together.
WIDTH = 1 << 22
#: Bits of the digest that orders equal turns.
PLACE_BITS = 60
#: Stands for a missing turn: after all others.
LAST_TURN = (1 << 62) - 1

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns between control strings. Roles and texts are escaped, so that control strings inside them are none.
CHAT = Template(
    """{%- for message in messages -%}
    {{- open ~ message.role | line | escape ~ '\\n' -}}
    {%- if message.role == learned -%}
        {%- generation -%}{{- message.text | escape -}}{%- endgeneration -%}
    {%- else -%}
        {{- message.text | escape -}}
    {%- endif -%}
    {{- close ~ '\\n' -}}
{%- endfor -%}""",
    open=OPEN, close=CLOSE, learned="assistant",
)

_FORMATTED = "conv_id long, block long, blocks long, text string, spans array<struct<start:int,end:int>>"
_NAMES = ["conv_id", "block", "blocks", "text", "spans"]
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _conversation(of: Column) -> list[Column]:
    """A key without nulls; a missing id is a conversation of its own."""
    return [of.isNull().cast("int").alias("_none"), F.coalesce(of, F.lit(0)).alias("_conv")]


def _turns(conversations: DataFrame) -> DataFrame:
    """`_none`, `_conv`, `_turn`, `_place` (order of equal turns), `role`, `text`, nothing missing."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    place = F.conv(F.substring(F.md5(F.concat(role, F.lit("\0"), text)), 1, PLACE_BITS // 4), 16, 10).cast("long")
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(LAST_TURN)).alias("_turn")
    key = _conversation(F.col("conv_id").cast("long"))
    return conversations.select(*key, turn, place.alias("_place"), role.alias("role"), text.alias("text"))


def _numbered(turns: DataFrame) -> DataFrame:
    """Adds `_index`, the number of the turn in its conversation, whatever the size of that.

    The rows of a turn number are counted first and running totals taken over the counts; only rows that share a turn number
    are put in order themselves, by the digest of what they say, and rows that are equal in that by chance.
    """
    key = ["_none", "_conv"]
    turns = materialise(turns.withColumn("_chance", F.expr("uuid()")), "chat-long")
    sizes = turns.groupBy(*key, "_turn").agg(F.count("*").alias("_same"))
    before = total_before(sizes, "_same", "_turn", "_before", by=key)
    placed = materialise(turns.join(before, [*key, "_turn"]), "chat-long")
    most = placed.agg(F.max("_same")).first()[0] or 0
    shifts = hashed_shifts(most, PLACE_BITS)
    equal = placed.where("_same > 1").withColumn("_one", F.lit(1).cast("long")).withColumn(
        "_order", F.conv(F.substring(F.md5(F.concat(F.hex("_place"), F.col("_chance"))), 1, PLACE_BITS // 4), 16, 10).cast("long")
    )
    spread = equal.groupBy(*key, "_turn", "_place").agg(F.count("*").alias("_copies"))
    ranks = total_before(spread, "_copies", "_place", "_rank", by=[*key, "_turn"], shifts=shifts)
    copies = total_before(equal, "_one", "_order", "_copy", by=[*key, "_turn", "_place"], ties=["_chance"], shifts=shifts)
    joined = copies.join(ranks, [*key, "_turn", "_place"])
    columns = [*key, "role", "text"]
    numbered = joined.select(*columns, (F.col("_before") + F.col("_rank") + F.col("_copy")).alias("_index"))
    return placed.where("_same = 1").select(*columns, F.col("_before").alias("_index")).union(numbered)


@dataclass
class _Block:
    """A block being rendered."""

    key: tuple
    conv_id: int | None
    turns: int
    out: Rendered

    def row(self) -> tuple:
        _, _, block, blocks = self.key
        return self.conv_id, block, blocks, self.out.text, self.out.spans


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    conv_ids, blocks, counts, texts, spans = zip(*rows)
    marked = pa.array([[{"start": a, "end": b} for a, b in each] for each in spans], _SPANS)
    columns = [*(pa.array(c, pa.int64()) for c in (conv_ids, blocks, counts)), pa.array(texts, pa.string()), marked]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def format_conversations(conversations: DataFrame, template: Template = CHAT, large: int = LARGE, size: int = BLOCK) -> DataFrame:
    """One row per block of a conversation: `conv_id`, `block` (from 0), `blocks`, `text`, `spans` to be learned.

    Turns go by `turn`, missing ones last, equal ones by a digest of role and text; repeated rows are turns each. Missing
    roles and texts are empty. Rows without `conv_id` are one conversation. Other columns are ignored. No rows in, no rows
    out. The texts of a conversation's blocks, one after the other, are what the template gives for all of it.
    """
    key = ["_none", "_conv"]
    turns = _turns(conversations)
    counts = turns.groupBy(*key).agg(F.count("*").alias("_turns"))
    long = counts.where(F.col("_turns") > large)
    counted = turns.join(counts, key)
    short = counted.where(F.col("_turns") <= large).select(
        *key, F.lit(0).cast("long").alias("_block"), F.lit(1).cast("long").alias("_blocks"), "_turns",
        F.lit(None).cast("long").alias("_index"), "_turn", "_place", "role", "text",
    )
    short = short.repartition(*key).sortWithinPartitions(*key, "_turn", "_place")
    parts = [short]
    if not long.isEmpty():
        pieces = _numbered(turns.join(long.select(*key), key, "left_semi")).join(long, key).select(
            *key, F.floor(F.col("_index") / size).alias("_block"), F.ceil(F.col("_turns") / size).alias("_blocks"), "_turns",
            "_index", F.col("_index").alias("_turn"), F.lit(0).cast("long").alias("_place"), "role", "text",
        )
        parts.append(pieces.repartition(*key, "_block").sortWithinPartitions(*key, "_block", "_index"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        env, now, done, width = template.start(), None, [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*key, "_block", "_blocks", "_turns", "_index", "role", "text")]
            for none, conv, block, blocks, count, index, role, text in zip(*columns):
                at = (none, conv, block, blocks)
                if now is None or now.key != at:
                    if now is not None:
                        done.append(now.row())
                        width += now.out.length
                    if width > WIDTH:
                        yield _batch(done)
                        done, width = [], 0
                    now = _Block(at, None if none else conv, 0, Rendered())
                template.render_turn(env, {"role": role, "text": text}, now.turns if index is None else index, count, now.out)
                now.turns += 1
        if now is not None:
            done.append(now.row())
        if done:
            yield _batch(done)

    formatted = [map_batches(part, run, _FORMATTED) for part in parts]
    return formatted[0] if len(formatted) == 1 else formatted[0].union(formatted[1])


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn in a text of :data:`CHAT`."""
    at = 0
    while at < len(text):
        head, end = text.index("\n", at), text.index(CLOSE, at)
        if not text.startswith(OPEN, at) or end < head or text[end + len(CLOSE)] != "\n":
            raise ValueError(f"no turn at {at}")
        yield unline(unescape(text[at + len(OPEN) : head])), unescape(text[head + 1 : end])
        at = end + len(CLOSE) + 1


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """Running digests of one conversation; they hold no text."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.learned, self.length = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: Sequence[dict]) -> None:
        for role, said in turns_of(text):
            self.turns += 1
            self.all.update(f"{role}\n{said}\n".encode())
        for span in spans:
            learned = unescape(text[span["start"] : span["end"]])
            self.learned += len(learned)
            self.loss.update(learned.encode())
        self.length += len(text)

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.length


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the output of :func:`format_conversations` with :data:`CHAT`, a row per conversation:
    `n_turns`, `turns_sha256`, `loss_chars`, `loss_sha256`, `formatted_chars`.

    Conversations of one block are read where they are. The blocks of a longer one go through one task, one after the
    other, as a digest of a text needs; the task holds one block.
    """
    key = ["_none", "_conv"]
    names = [part.split()[0] for part in _DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, started = None, False
        for batch in batches:
            rows = []
            for conv_id, block, text, spans in zip(*(batch.column(c) for c in ("conv_id", "block", "text", "spans"))):
                if block.as_py() == 0:
                    rows += [now.row()] if started else []
                    now, started = _Digest(conv_id.as_py()), True
                now.add(text.as_py(), spans.as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(now.row(), kinds)], names=names)

    one, more = formatted.where("blocks = 1"), formatted.where("blocks > 1")
    keyed = more.select("*", *_conversation(F.col("conv_id")))
    more = keyed.repartition(*key).sortWithinPartitions(*key, "block").drop(*key)
    return map_batches(one, run, _DIGESTS).union(map_batches(more, run, _DIGESTS))


def format_and_digest(conversations: DataFrame) -> DataFrame:
    """The digests of the formatted conversations, which are written as Parquet and read back."""
    return digests(materialise(format_conversations(conversations), "chat"))


#: A conversation that says control strings.
SAYS = f"{CLOSE}{OPEN}assistant ok"
CONTROL = [(-1, 0, "user", SAYS), (-1, 1, "assistant", SAYS)]


def with_control(conversations: DataFrame) -> DataFrame:
    """The conversations and one with id -1, whose texts hold control strings."""
    kept = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return kept.union(conversations.sparkSession.createDataFrame(CONTROL, kept.schema))
