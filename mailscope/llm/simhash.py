"""Near-duplicates by SimHash, linked through the pigeonring principle.

A fingerprint's 64 bits are a ring of four segments of 16. If two fingerprints differ in at most three bits, then
from some segment on, every run of 1, 2, 3 and 4 consecutive segments holds at most 0, 1, 2 and 3 of the
differences: its share of the budget, rounded down. The first two conditions make the join key: the segment itself
and the next one but for one of its `parts`, since a single difference leaves all other parts as they are. The
rest of the chain prunes candidates before the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailscope.llm.batches import map_batches
from mailscope.llm.components import components
from mailscope.llm.rows import row_digest
from mailscope.llm.scratch import materialise

BITS, SEGMENTS, RADIUS = 64, 4, 3
WIDTH = BITS // SEGMENTS
#: Words hashed at a time; longer texts are added up piece by piece.
PIECE = 1 << 18
#: Keys with up to so many fingerprints are joined with themselves; larger ones are searched as a group.
SMALL = 16
#: Fingerprints in a group at most; larger groups are split on further bits, which loses no link. Twelve free bits
#: leave no more than this, so splitting ends.
GROUP = 4096


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, highest bit first."""
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
    whole = len(bits) // 255 * 255  # so many bits still add up in a byte
    counts = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return counts


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of a text, repeats included, as a signed 64-bit number; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six white-space characters only
    if not words:
        return 0
    width = min(shingle, len(words))
    total, counts = len(words) - width + 1, np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, total, PIECE):
        part = words[at : at + PIECE + width - 1]
        lengths = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(lengths + 1) - 1
        joined, starts = b" ".join(part), ends - lengths
        spans = zip(starts[: len(part) - width + 1].tolist(), ends[width - 1 :].tolist())
        counts += _bit_counts(np.fromiter((digest(joined[s:e], 42) for s, e in spans), np.uint64, len(part) - width + 1))
    return int(np.packbits(2 * counts > total).view(">u8")[0].astype(np.int64))


def fingerprints(documents: DataFrame, shingle: int = 3, carried: Sequence[str] = ()) -> DataFrame:
    """`doc_id`, the LONG columns `carried`, and `fp`, the fingerprint as LONG, one row per document."""
    names = ["doc_id", *carried, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(0))
            prints = np.fromiter((fingerprint(t, shingle) for t in texts), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints)], names=names)

    chosen = documents.select("text", F.col("doc_id").cast("long"), *carried)
    return map_batches(chosen, run, ", ".join(f"{name} long" for name in names))


def _rotated(fp: Column, segment: int) -> Column:
    """The ring turned so that `segment` comes first."""
    turn = WIDTH * segment
    return fp if turn == 0 else F.shiftleft(fp, turn).bitwiseOR(F.shiftrightunsigned(fp, BITS - turn))


def parts_for(distinct: int) -> int:
    """Into how many parts the second segment is cut: more distinct fingerprints want longer keys (24, 28, 30 bits).

    Every choice finds the same links."""
    return 2 if distinct <= 1 << 24 else 4 if distinct <= 1 << 28 else 8


def _keys(nodes: DataFrame, parts: int) -> DataFrame:
    """`fp` under each of its `4 * parts` keys: `key`, `segment`, and `free`, the bits that the key leaves open."""
    found, step = [], WIDTH // parts
    for segment in range(SEGMENTS):
        for part in range(parts):
            open_bits = ((1 << step) - 1) << (BITS - WIDTH - step * (part + 1))
            free = open_bits | ((1 << (BITS - 2 * WIDTH)) - 1)
            fixed = _rotated(F.col("fp"), segment).bitwiseAND(F.lit(_signed(~free)))
            back = _turned_back(free, segment)
            key = F.xxhash64(fixed, F.lit(segment), F.lit(part))
            found.append(F.struct(key.alias("key"), F.lit(segment).alias("segment"), F.lit(_signed(back)).alias("free")))
    return nodes.select("fp", F.inline(F.array(*found)))


def _signed(bits: int) -> int:
    bits &= (1 << BITS) - 1
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _turned_back(bits: int, segment: int) -> int:
    turn = WIDTH * segment
    return ((bits >> turn) | (bits << (BITS - turn))) & ((1 << BITS) - 1)


def _chain_holds(a: Column, b: Column, segment: Column) -> Column:
    """Pigeonring test from the key's segment on, then all bits: runs of 1 to 4 segments within 0 to 3 differences."""
    apart = F.coalesce(*[F.when(segment == s, _rotated(a, s).bitwiseXOR(_rotated(b, s))) for s in range(SEGMENTS)])
    holds = F.lit(True)
    for run in range(1, SEGMENTS + 1):
        budget = RADIUS * run // SEGMENTS
        holds = holds & (F.bit_count(F.shiftrightunsigned(apart, BITS - WIDTH * run)) <= budget)
    return holds


def _with_size(keyed: DataFrame) -> DataFrame:
    """Rows whose key has company, with the number of fingerprints under it."""
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    return keyed.join(sizes, "key")


def _split(groups: DataFrame) -> DataFrame:
    """Split groups by pigeonhole: of four parts of the free bits, three differences leave one as it is.

    Each fingerprint goes to four smaller groups; a pair within the radius stays together in at least one. The masks
    that come to the driver follow from the keys' layout, at most `4 * parts * 4 ** level`, whatever the data.
    """
    masks = []
    for (free,) in groups.select("free").distinct().collect():
        bits = [1 << n for n in range(BITS) if free >> n & 1]
        masks += [(free, i, _signed(sum(bits[i::4]))) for i in range(4)]
    parts = groups.sparkSession.createDataFrame(masks, "free long, part int, fixed long")
    key = F.xxhash64("key", "part", F.col("fp").bitwiseAND(F.col("fixed")))
    rest = F.col("free").bitwiseAND(F.bitwise_not("fixed"))
    return groups.join(parts, "free").select("fp", "segment", key.alias("key"), rest.alias("free"))


def _tree(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of all pairs within the radius, by breadth-first search over the bits."""
    left, right, rest = [], [], prints.view(np.uint64)  # the bits of a signed number would be counted in its absolute value
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= RADIUS
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
                rest = rest[~near]
    none = np.zeros(0, np.uint64)
    return np.concatenate(left or [none]).view(np.int64), np.concatenate(right or [none]).view(np.int64)


def links(nodes: DataFrame) -> DataFrame:
    """`a`, `b`: links between distinct fingerprints (`fp`), enough of them to connect all that are within the radius.

    Under a key with few fingerprints every pair within the radius is a link. Larger groups are searched within one
    task of bounded size and give a spanning forest, so a ball of thousands of near copies does not become millions
    of pairs.
    """
    keyed = _with_size(materialise(_keys(nodes, parts_for(nodes.count())), "simhash-keys"))
    small = keyed.filter(F.col("size") <= SMALL).select("key", "fp", "segment")
    other = small.select("key", F.col("fp").alias("other"))
    pairs = small.join(other, "key").filter(F.col("fp") < F.col("other"))
    pairs = pairs.filter(_chain_holds(F.col("fp"), F.col("other"), F.col("segment")))
    found = [pairs.select(F.col("fp").alias("a"), F.col("other").alias("b"))]

    large = materialise(keyed.filter(F.col("size") > SMALL), "simhash-groups")
    while True:
        searched = large.filter(F.col("size") <= GROUP)
        found.append(searched.groupBy("key").applyInPandas(_search, "a long, b long"))
        too_large = large.filter(F.col("size") > GROUP)
        if too_large.isEmpty():
            break
        large = materialise(_with_size(_split(too_large)), "simhash-groups")
    result = found[0]
    for more in found[1:]:
        result = result.union(more)
    return result


def _search(group):
    import pandas as pd

    left, right = _tree(np.unique(group["fp"].to_numpy(np.int64)))
    return pd.DataFrame({"a": left, "b": right})


def _labelled(prints: DataFrame) -> DataFrame:
    """`fp` and `component`, for every distinct fingerprint."""
    nodes = materialise(prints.select("fp").distinct(), "simhash-nodes")
    joined = components(links(nodes)).withColumnRenamed("node", "fp")
    return nodes.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """One row per document: `doc_id`, `fingerprint` (16 hexadecimal digits) and `component_id`, the smallest
    `doc_id` reachable through fingerprints that differ in at most three bits, the document's own included.

    Null and empty texts, and texts of white space, have fingerprint zero and are linked like any other. Fewer words
    than a shingle make one shingle. Repeated rows each get a row. A null `doc_id` is a document that gives no
    name to its component; a component of such only has a null id. Other columns are ignored. No rows in, no rows out.
    """
    prints = materialise(fingerprints(documents, shingle), "simhash-prints")
    labelled = _labelled(prints)
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("_least")).join(labelled, "fp")
    named = labelled.join(least.groupBy("component").agg(F.min("_least").alias("component_id")), "component")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named.select("fp", "component_id"), "fp").select("doc_id", digits, "component_id")


def keep_one(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """The documents, all columns, one of each group that :func:`near_duplicates` puts together: that with the smallest
    `doc_id`, one without only if there is no other; of rows that agree in it, the first by a digest of the whole row.

    Texts without words are one group. Equal rows are one. The digest also finds the rows again, so that only
    fingerprints and no copy of the corpus is written. No rows in, no rows out.
    """
    rows = documents.select(F.struct(*documents.columns).alias("it"), *row_digest(documents, "d1", "d2"))
    chosen = rows.select("it.text", "it.doc_id", "d1", "d2")
    prints = materialise(fingerprints(chosen, shingle, ["d1", "d2"]), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "d1", "d2")).alias("first")
    least = prints.groupBy("fp").agg(first).join(_labelled(prints), "fp")
    kept = least.groupBy("component").agg(F.min("first").alias("first")).select("first.d1", "first.d2")
    return rows.join(kept, ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"]).select("it.*")
