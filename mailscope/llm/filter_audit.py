"""What each filter removes, for every order in which the filters could run.

A document's failures are a mask with a bit per filter. Spark counts the masks of each part, at most `2 ** n` rows
however many documents there are. A part's counts become a decision diagram: a level per filter, an edge for passing
and one for failing, equal subgraphs shared, the weight of a node being the documents below it. The filters' order is
the order of the levels, so the next order takes one swap of two adjacent levels, and the path on which everything
passes gives the steps of an order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property
from math import factorial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailscope.llm.batches import map_batches
from mailscope.llm.scratch import materialise

#: Parts whose rows are put out together.
PARTS = 32
UPPER, SIGNS = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|"

#: Documents, good ones, toxic ones.
Weight = tuple[int, ...]


class Text:
    """A text as filters look at it; a missing one is empty."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.data = self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        """Between spaces and the five control characters from tab to carriage return."""
        return self.data.split()

    def count(self, characters: bytes) -> int:
        """How often one of these ASCII characters occurs."""
        return len(self.data) - len(self.data.translate(None, characters))


@dataclass(frozen=True)
class Filter:
    """A letter and the condition of failing."""

    letter: str
    fails: Callable[[Text], bool]


#: The filters of the audit; the letter of `DUPLICATES` follows them.
FILTERS = (
    Filter("A", lambda t: len(t.words) < 200),
    Filter("B", lambda t: 100 * len(set(t.words)) < 50 * len(t.words)),
    Filter("C", lambda t: 100 * t.count(UPPER) > 2 * len(t.text)),
    Filter("D", lambda t: t.count(SIGNS) > 0),
)
#: Fails a document whose text is that of a document with a smaller `doc_id`.
DUPLICATES = "E"


class Node:
    """`low` is where the filter passes, `high` where it fails; at the bottom both are weights."""

    __slots__ = ("high", "low", "weight")

    def __init__(self, low: Node | Weight, high: Node | Weight):
        self.low, self.high = low, high
        self.weight = tuple(a + b for a, b in zip(_weight(low), _weight(high)))


def _weight(node: Node | Weight) -> Weight:
    return node.weight if isinstance(node, Node) else node


class Diagram:
    """A decision diagram of weights by mask; every path has all levels.

    Bit `i` of a mask belongs to `letters[i]`. `order` has the letters from the top level down.
    """

    def __init__(self, letters: Sequence[str], weights: Mapping[int, Weight], zero: Weight = (0, 0, 0)):
        self.order = list(letters)
        self._nodes: list[dict] = [{} for _ in letters]
        self._leaves: dict[Weight, Weight] = {}

        def grown(level: int, mask: int) -> Node | Weight:
            if level == len(letters):
                found = weights.get(mask, zero)
                return self._leaves.setdefault(found, found)
            return self._shared(level, grown(level + 1, mask), grown(level + 1, mask | 1 << level))

        self.root = grown(0, 0)

    def _shared(self, level: int, low: Node | Weight, high: Node | Weight) -> Node:
        """The one node of this level with these edges."""
        key = (id(low), id(high))
        found = self._nodes[level].get(key)
        if found is None:
            found = self._nodes[level][key] = Node(low, high)
        return found

    @property
    def sizes(self) -> list[int]:
        """Nodes per level."""
        return [len(level) for level in self._nodes]

    def swap(self, level: int) -> None:
        """Exchange this level and the next. Nodes above and below stay as they are, weights too."""
        upper = list(self._nodes[level].values())
        self._nodes[level], self._nodes[level + 1] = {}, {}
        for node in upper:
            low, high = node.low, node.high
            node.low = self._shared(level + 1, low.low, high.low)
            node.high = self._shared(level + 1, low.high, high.high)
            self._nodes[level][id(node.low), id(node.high)] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[str, Weight, Weight]]:
        """Along the path on which all filters pass: the letter, what passes and what fails there."""
        node = self.root
        for letter in self.order:
            yield letter, _weight(node.low), _weight(node.high)
            node = node.low


def swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next, one after the other, so that every order of `n` levels comes up once.

    The last item walks through each order of the others, to and fro; these change one swap at a time as well.
    """
    if n < 2:
        return
    inner = swaps(n - 1)
    downwards = True
    while True:
        yield from range(n - 2, -1, -1) if downwards else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + 1 if downwards else step  # the item that walks now stands above the others, or below them
        downwards = not downwards


def every_order(diagram: Diagram) -> dict[str, list[tuple[str, Weight, Weight]]]:
    """The steps of all orders; leaves the diagram in another order."""
    found = {"".join(diagram.order): list(diagram.steps())}
    for level in swaps(len(diagram.order)):
        diagram.swap(level)
        found["".join(diagram.order)] = list(diagram.steps())
    return found


COLUMNS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def part_rows(part: str, letters: Sequence[str], weights: Mapping[int, Weight]) -> list[tuple]:
    """All rows of one part, as in :data:`COLUMNS`."""
    orders = every_order(Diagram(letters, weights))
    assert len(orders) == factorial(len(letters))
    fails, alone, shapley = {}, {}, dict.fromkeys(letters, 0)
    for steps in orders.values():
        for letter, _, lost in steps:
            shapley[letter] += lost[0]
        fails[steps[0][0]] = steps[0][2][0]
        alone[steps[-1][0]] = steps[-1][2][0]
    return [
        (part, order, n, kept[0], lost[0], fails[at] - lost[0], alone[at], lost[1], lost[2], shapley[at])
        for order, steps in orders.items()
        for n, (at, kept, lost) in enumerate(steps, start=1)
    ]


def failures(documents: DataFrame, filters: Sequence[Filter] = FILTERS) -> DataFrame:
    """`doc_id`, `part`, `mask` of the filters on texts, and `t1`, `t2`, which tell texts apart."""
    kind = "doc_id long, part string, mask int, t1 long, t2 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, first, second = [], [], []
            for value in batch.column(2):
                text = Text(value.as_py())
                masks.append(sum(f.fails(text) << bit for bit, f in enumerate(filters)))
                digest = xxhash.xxh3_128_digest(text.data)
                first.append(int.from_bytes(digest[:8], signed=True))
                second.append(int.from_bytes(digest[8:], signed=True))
            columns = [*batch.columns[:2], pa.array(masks, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "mask", "t1", "t2"])

    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    return map_batches(documents.select(F.col("doc_id").cast("long"), part, "text"), run, kind)


def mask_counts(documents: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS) -> DataFrame:
    """`part`, `mask`, `n`, `good`, `toxic`: documents by part and failures, repeated texts as the highest bit."""
    masked = materialise(failures(documents, filters), "audit-masks")
    copies = masked.groupBy("t1", "t2").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    # Keys in a struct: both sides are then shuffled for the join, and a text with very many copies can be split.
    copies = copies.select(F.struct("t1", "t2").alias("_text"), "_least")
    later = F.coalesce(F.col("doc_id") > F.col("_least"), F.lit(False)).cast("int")
    whole = (F.col("mask") + later * F.lit(1 << len(filters))).alias("mask")
    judged = masked.join(copies, F.struct("t1", "t2") == F.col("_text"), "left").select("doc_id", "part", whole)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("good", "toxic")]
    return judged.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), *sums)


def audit(documents: DataFrame, labels: DataFrame, filters: Sequence[Filter] = FILTERS, duplicates: str = DUPLICATES) -> DataFrame:
    """One row per part, order of the filters and step, zeros included: see :data:`COLUMNS`.

    A part is a value of `source`, a missing one the empty string. A missing text is empty. `redundant` fail the
    step's filter but are gone already, `unique_fails` fail no other, `shapley` adds up `removed` over all orders.
    Of equal texts, all but those with the smallest `doc_id` fail as duplicates, removed or not; a row without `doc_id`
    never does, and no row does so because of it. Repeated rows count each. A document is good (toxic) if one of its rows
    in `labels` says so; rows of `labels` without a document, and other columns, are ignored. No documents, no rows.
    """
    letters = [*(f.letter for f in filters), duplicates]
    cell = F.struct("mask", "n", "good", "toxic")
    cells = mask_counts(documents, labels, filters).groupBy("part").agg(F.collect_list(cell).alias("cells"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in COLUMNS.split(", ")]
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                rows = []
                for part in batch.slice(at, PARTS).to_pylist():
                    weights = {c["mask"]: (c["n"], c["good"], c["toxic"]) for c in part["cells"]}
                    rows += part_rows(part["part"], letters, weights)
                kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cells.mapInArrow(run, COLUMNS)
