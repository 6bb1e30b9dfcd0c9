"""Mixing sources to target weights with a low-discrepancy schedule.

Every source's documents are shuffled by a hash and laid end to end; the stream of words is cut into blocks of
equal length. The schedule is a sequence of slots, each for one block. Slot k goes to the source in whose part of
the unit interval the golden-ratio point frac(k * phi) falls, the parts being as wide as the sources' targets, so
any stretch of the schedule holds the sources in nearly the wanted proportions. The rank of a slot within its
source says which block it takes: ranks run through the stream again and again, so a source that is wanted more
than once is repeated evenly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscope.llm.prefix import hashed_shifts, total_before
from mailscope.llm.scratch import materialise
from mailscope.llm.words import word_count

#: Bits of a document's place in the shuffle: 15 hexadecimal digits, so that it stays a positive LONG.
KEY_BITS = 60
#: frac(phi) and frac(2 ** 20 * phi): with both, k * phi keeps its fraction exact to 2 ** -32 for k below 2 ** 40.
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.6077874097403610
#: Cells by which points find their part of the unit interval.
CELLS = 1024


@dataclass(frozen=True)
class MixPlan:
    """weights: by the rank of the source, repeating. share: wanted size over the size of all sources.
    repeats: how often a source may be taken at most. block: words in a block."""

    weights: Sequence[int] = (3, 1, 2)
    share: float = 1.5
    repeats: int = 2
    block: int = 256


def source_targets(sized: DataFrame, plan: MixPlan) -> DataFrame:
    """One row per source: `source`, `src` (its rank by code point, null last), `source_size`, `target` (DOUBLE).

    Targets are in proportion to weights; one that would exceed `repeats` times its source stops there and what is
    over is shared among the others. With sources ordered by how soon they fill up, the common level follows from
    running sums; the windows run over one row per source.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    weight = F.element_at(F.array(*map(F.lit, plan.weights)), ((F.col("src") - 1) % len(plan.weights) + 1).cast("int"))
    capped = ranked.withColumn("_w", weight.cast("double")).withColumn(
        "_cap", (F.col("source_size") * plan.repeats).cast("double")
    )
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "src")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wanted = F.sum("source_size").over(everything) * F.lit(plan.share)
    level = (wanted - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    leveled = capped.withColumn("_level", level).withColumn("_order", F.row_number().over(filling))
    reached = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct("_order", "_level"))
    leveled = leveled.withColumn("_reached", F.min(reached).over(everything))
    common = F.coalesce(F.col("_reached._level") * F.col("_w"), F.col("_cap"))
    return leveled.select("source", "src", "source_size", F.least("_cap", common).alias("target"))


def _slots_needed(plan: MixPlan) -> tuple[Column, Column]:
    """Blocks of a source and slots until its target is met, from `source_size` and `wanted`."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    blocks = F.ceil(F.col("source_size") / F.lit(plan.block)).cast("long")
    full = F.floor(F.col("wanted") / size).cast("long")
    rest = F.ceil((F.col("wanted") % size) / F.lit(plan.block)).cast("long")
    return blocks, full * blocks + rest


def schedule(targets: DataFrame, plan: MixPlan) -> DataFrame:
    """Slots: `position`, `src`, `rank`, `block`, `epoch`, and `until`, the words of the epoch's stream that count.

    A source gets as many slots as its target needs: the few that the points give it beyond that stay unfilled, the
    few that they leave out come at the end.
    """
    blocks, slots = _slots_needed(plan)
    sized = targets.withColumn("wanted", F.floor("target").cast("long")).withColumn("_blocks", blocks).withColumn("_slots", slots)
    by_src = Window.orderBy("src")
    part = sized.withColumn("_lo", F.sum("_slots").over(by_src) - F.col("_slots"))
    total = part.agg(F.sum("_slots")).first()[0] or 0
    ends = part.filter("_slots > 0").select(
        "src", "source_size", "wanted", "_blocks", "_slots",
        (F.col("_lo") / F.lit(float(max(total, 1)))).alias("_lo"),
        ((F.col("_lo") + F.col("_slots")) / F.lit(float(max(total, 1)))).alias("_hi"),
    )
    cells = ends.select("src", "_lo", "_hi", F.explode(F.sequence(
        F.floor(F.col("_lo") * CELLS), F.least(F.floor(F.col("_hi") * CELLS), F.lit(CELLS - 1).cast("long"))
    )).alias("_cell"))
    k = F.col("position")
    point = F.pmod(F.shiftright(k, 20) * F.lit(GOLDEN_20) + (k % (1 << 20)) * F.lit(GOLDEN), F.lit(1.0))
    points = (
        targets.sparkSession.range(total).select(F.col("id").alias("position"))
        .withColumn("_u", point).withColumn("_cell", F.floor(F.col("_u") * CELLS))
    )
    placed = points.join(cells, "_cell").filter("_lo <= _u and _u < _hi").select("position", "src", F.lit(1).cast("long").alias("_one"))
    ranked = total_before(placed, "_one", "position", "rank", by=["src"]).drop("_one")
    given = placed.groupBy("src").agg(F.sum("_one").alias("_given"))
    left = ends.join(given, "src", "left").withColumn("_given", F.coalesce("_given", F.lit(0))).filter("_given < _slots")
    late = left.select("src", F.explode(F.sequence(F.col("_given"), F.col("_slots") - 1)).alias("rank"))
    late = late.select((F.lit(total) + F.col("rank") * F.lit(CELLS) + F.col("src")).alias("position"), "src", "rank")
    filled = ranked.select("position", "src", "rank").unionByName(late).join(ends, "src").filter("rank < _slots")
    epoch = F.floor(F.col("rank") / F.col("_blocks")).cast("long")
    return filled.select(
        "position", "src", "rank", (F.col("rank") % F.col("_blocks")).alias("block"), epoch.alias("epoch"),
        (F.col("wanted") - epoch * F.col("source_size")).alias("until"),
    )


def laid_out(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """`sized` (`row`, `source`, `size`) with its source's columns and `start`, the words before it in the shuffled
    stream of its source. Written, since the blocks and the result both need it."""
    keyed = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    place = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    keyed = keyed.withColumn("_place", place)
    shifts = hashed_shifts(sized.count(), KEY_BITS)
    streamed = total_before(keyed, "size", "_place", "start", by=["src"], ties=["doc_id", "size"], shifts=shifts)
    return materialise(streamed.drop("_place"), "mix-streams")


def pieces(streams: DataFrame, slots: DataFrame, plan: MixPlan) -> DataFrame:
    """The mix: `position`, `epoch`, `doc_id`, `src`, `start` and the words `[first, first + length)` of the document."""
    last = F.col("start") + F.col("size") - 1
    cut = streams.filter("size > 0").select("doc_id", "src", "start", "size", F.explode(F.sequence(
        F.floor(F.col("start") / plan.block), F.floor(last / plan.block)
    )).alias("block"))
    low = F.greatest("start", F.col("block") * plan.block)
    high = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * plan.block)
    cut = cut.withColumn("_low", low).withColumn("_high", high)
    taken = slots.join(cut, ["src", "block"]).withColumn("length", F.least("_high", "until") - F.col("_low")).filter("length > 0")
    return taken.select("position", "epoch", "src", "doc_id", "start", (F.col("_low") - F.col("start")).alias("first"), "length")


def mix(documents: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """One row per document: `doc_id`, `source`, `size`, `source_size`, `target`, `taken` (words, repeats counted).

    Null text has no words and a null source is a source of its own, the last. Repeated rows each count. Other
    columns are ignored. No rows in, no rows out. Every source's `taken` adds up to its target, rounded down; no
    document is taken more than `repeats` times.
    """
    sized = materialise(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    targets = materialise(source_targets(sized, plan), "mix-targets")
    streams = laid_out(sized, targets)
    taken = pieces(streams, schedule(targets, plan), plan).groupBy("src", "start").agg(F.sum("length").alias("_taken"))
    joined = streams.join(taken.withColumn("_some", F.lit(True)), ["src", "start"], "left")
    amount = F.when(F.col("size") > 0, F.coalesce("_taken", F.lit(0))).otherwise(0).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", amount.alias("taken"))


def mixed_documents(documents: DataFrame, plan: MixPlan = MixPlan()) -> DataFrame:
    """The mix as whole documents, all columns: each as many times as its taken words, rounded, hold it.

    Only the document at which a source's target is met is taken in part; it is in or out by the half. Documents
    without words are out. Rows of one `doc_id` and size share what is taken of them, evenly.
    """
    amounts = mix(documents, plan).filter("taken > 0").groupBy("doc_id", "source", "size").agg(
        F.sum("taken").alias("_taken"), F.count("*").alias("_rows")
    ).select(
        F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.round(F.col("_taken") / F.col("_rows") / F.col("size")).cast("int").alias("_copies"),
    )
    rows = documents.select(
        F.struct(*documents.columns).alias("it"), "doc_id", "source", word_count(F.col("text")).alias("_words")
    )
    joined = rows.join(amounts, (
        F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("source").eqNullSafe(F.col("_source"))
        & (F.col("_words") == F.col("_size"))
    ))
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_copies")))).select("it.*")
