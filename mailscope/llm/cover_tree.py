"""Exact top-k search by inner product with two cover trees, one of the queries and one of the data.

Within a block both sides are indexed by nested covers: every node has a point as its centre and all its points within
its radius, and the next level covers them by centres that keep half that distance. For two nodes with centres q and
r and radii a and b no inner product exceeds <q, r> + a |r| + b |q| + a b; if that is below the worst k-th score
among the node's queries, the pair is dropped with all that hangs on it.

Across blocks the same rule holds between a query and a cell: the data is dealt to the nearest of a few pivots, every
cell is cut into blocks of bounded size, a query first meets its own cell and then only the cells that can still
hold something better than its k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailscope.llm.scratch import materialise

#: Results per query, and which rows are queries: those whose id is divisible by this.
TOP, QUERY_EVERY = 5, 50
#: Rows of data and queries in a block at most (about, as rows are dealt by a hash).
BLOCK, QUERIES = 2048, 1024
#: Rows from which pivots are chosen, and pivots at most.
SAMPLE, PIVOTS = 256, 64
#: Points of a node that is not covered further; points scored at a time.
LEAF, CHUNK = 24, 1024
#: For rounding in bounds.
SLACK = 1e-6


@dataclass(frozen=True)
class Level:
    """Nodes of one level: `centres` (places of points), `parents` (in the level above), `radii`."""

    centres: np.ndarray
    parents: np.ndarray
    radii: np.ndarray


def cover_tree(points: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """Levels from the root down and the node of the last level that each point is in.

    A node with few points, or with equal ones only, stays as it is on all further levels."""
    size = (points * points).sum(1)
    between = np.sqrt((size[:, None] + size[None] - 2 * (points @ points.T)).clip(0))
    far = between[0]
    levels = [Level(np.array([0]), np.array([0]), np.array([far.max()]))]
    node = np.zeros(len(points), np.int64)
    scale = far.max() / 2
    while True:
        sizes = np.bincount(node, minlength=len(levels[-1].centres))
        open_nodes = (sizes > LEAF) & (levels[-1].radii > 0)
        if not open_nodes.any():
            return levels, node
        centres, parents, radii = [], [], []
        below = np.empty_like(node)
        order = np.argsort(node, kind="stable")
        for number, own in enumerate(np.split(order, np.cumsum(sizes)[:-1])):
            if not open_nodes[number]:
                below[own] = len(centres)
                centres.append(levels[-1].centres[number])
                parents.append(number)
                radii.append(levels[-1].radii[number])
                continue
            rest, centre = own, levels[-1].centres[number]
            while len(rest):
                apart = between[centre, rest]
                near = apart <= scale
                below[rest[near]] = len(centres)
                centres.append(centre)
                parents.append(number)
                radii.append(apart[near].max())
                rest = rest[~near]
                centre = rest[0] if len(rest) else centre
        levels.append(Level(np.array(centres), np.array(parents), np.array(radii)))
        node, scale = below, scale / 2


def _bounds(q: np.ndarray, a: np.ndarray, r: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bound of inner products between two sets of nodes."""
    q_size, r_size = np.sqrt((q * q).sum(1)), np.sqrt((r * r).sum(1))
    top = (q_size + a)[:, None] * (r_size + b)[None]
    return q @ r.T + a[:, None] * r_size[None] + b[None] * q_size[:, None] + a[:, None] * b[None] + SLACK * (top + 1)


def _scores(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits the nearest long."""
    largest = np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * q.shape[1]
    if largest < 2**53:
        return (q @ r.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)
    return np.clip(whole(q) @ whole(r).T, -(2**63), 2**63 - 1).astype(np.int64)


def search(
    q_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, r_ids: np.ndarray, points: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its best `k` of `points` with at least `floor`: place of the query, id and score.

    A point with the query's own id is no candidate. Ties go to smaller ids."""
    q_levels, q_node = cover_tree(queries)
    r_levels, r_node = cover_tree(points)
    kth = floor.astype(float)
    best: list[list[tuple[int, int]]] = [[] for _ in queries]  # (-score, id)

    def worst(node: np.ndarray, count: int) -> np.ndarray:
        low = np.full(count, np.inf)
        np.minimum.at(low, node, kth)
        return low

    q_up = [q_node]
    for level in reversed(q_levels[1:]):
        q_up.append(level.parents[q_up[-1]])
    q_up.reverse()
    alive = np.ones((1, 1), bool)
    for depth in range(max(len(q_levels), len(r_levels))):
        at_q, at_r = min(depth, len(q_levels) - 1), min(depth, len(r_levels) - 1)
        q, r = q_levels[at_q], r_levels[at_r]
        if depth:
            if at_q == depth:
                alive = alive[q.parents]
            if at_r == depth:
                alive = alive[:, r.parents]
        bound = _bounds(queries[q.centres], q.radii, points[r.centres], r.radii)
        alive = alive & (bound >= worst(q_up[at_q], len(q.centres))[:, None])

    sizes, by_node = np.bincount(r_node, minlength=len(r.centres)), np.argsort(r_node, kind="stable")
    starts = np.cumsum(sizes) - sizes
    for number in range(len(q.centres)):
        own = np.flatnonzero(q_node == number)
        todo = np.flatnonzero(alive[number])
        todo = todo[np.argsort(-bound[number, todo])]
        while len(todo):
            todo = todo[bound[number, todo] >= kth[own].min()]
            ends = np.cumsum(sizes[todo])
            taken = int(np.searchsorted(ends, CHUNK)) + 1
            now, ends = todo[:taken], ends[:taken]
            todo = todo[taken:]
            if not len(now):
                break
            places = by_node[np.repeat(starts[now] - ends + sizes[now], sizes[now]) + np.arange(ends[-1])]
            for i, row in zip(own, _scores(queries[own], points[places])):
                good = np.flatnonzero((row >= kth[i]) & (r_ids[places] != q_ids[i]))
                if not len(good):
                    continue
                if len(good) > 4 * k:  # keep what can be among the best k
                    good = good[row[good] >= np.partition(row[good], -k)[-k]]
                merged = sorted(best[i] + list(zip((-row[good]).tolist(), r_ids[places[good]].tolist())))[:k]
                best[i] = merged
                if len(merged) == k:
                    kth[i] = max(kth[i], -merged[-1][0])
    found = [(i, rid, -score) for i, b in enumerate(best) for score, rid in b]
    columns = np.array(found, np.int64).reshape(-1, 3).T
    return columns[0], columns[1], columns[2]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1).astype(float)


def _whole(column: pa.Array, width: int) -> np.ndarray:
    """floor(256 x) of each component; shorter vectors end in zeros."""
    lengths = np.array([len(v) for v in column])
    flat = np.floor(256.0 * column.flatten().to_numpy(zero_copy_only=False).astype(float))
    rows = np.zeros((len(column), width))
    rows[np.arange(width)[None] < lengths[:, None]] = flat
    return rows


def _spread(sample: np.ndarray) -> np.ndarray:
    """Pivots, each the farthest from those before it, so that any number of first ones is spread out."""
    chosen, apart = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(PIVOTS, len(sample)):
        apart = np.minimum(apart, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if apart.max() == 0:
            break
        chosen.append(int(apart.argmax()))
    return sample[chosen]


def _arrow(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, max(rows.shape[1], 1), dtype=np.int32)[: len(rows) + 1], rows.reshape(-1))


def _dealt(cell: str, sizes: dict[int, int], limit: int) -> Column:
    """The block of a row: its cell and, where the cell is larger than a block, one of several by a hash."""
    parts = F.element_at(F.array(*[F.lit(-(-sizes.get(c, 1) // limit)) for c in range(PIVOTS)]), F.col(cell) + 1)
    return F.col(cell).cast("long") * (1 << 32) + F.pmod(F.xxhash64("vec_id", "v"), parts)


def _searched(data: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """`probes` (`key`, `query_id`, `v`, `floor`, `q_block`, `block`) against the blocks of `data`. A block of data goes
    only to the blocks of queries that want it."""
    pairs = probes.select(F.col("block").alias("_block"), F.col("q_block").alias("_q_block")).distinct()
    met = data.join(pairs, F.col("block") == F.col("_block"))
    sides = met.select(F.col("_block").alias("block"), F.col("_q_block").alias("q_block"), "vec_id", "v").groupBy("block", "q_block")

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["key", "query_id", "vec_id", "score"]
        if not len(points) or not len(queries):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        keys, ids = queries.column("key").to_numpy(), queries.column("query_id").to_numpy()
        place, found, score = search(
            ids, _matrix(queries.column("v")), queries.column("floor").to_numpy(),
            points.column("vec_id").to_numpy(), _matrix(points.column("v")), k,
        )
        return pa.table(dict(zip(names, (keys[place], ids[place], found, score))))

    return sides.cogroup(probes.groupBy("block", "q_block")).applyInArrow(run, "key long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = TOP, every: int = QUERY_EVERY, vector: str = "embedding") -> DataFrame:
    """For each row whose `vec_id` is divisible by `every`, its `k` best others: `query_id`, `rank` (from 1), `vec_id`,
    `score`, the inner product of floor(256 x). Ties go to the smaller `vec_id`; fewer rows give fewer results.

    Null vectors, vectors with null or non-finite components and rows without `vec_id` take no part. Of different
    lengths, the shorter count as ending in zeros. Rows with the query's `vec_id` are its own. Equal query rows give
    one result; equal data rows each count. Scores beyond a LONG are the nearest one. Other columns are ignored.
    """
    spark = vectors.sparkSession
    finite = F.forall(F.col("_v"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    given = vectors.select(F.col("vec_id").cast("long"), F.col(vector).cast("array<double>").alias("_v"))
    given = given.filter(F.col("vec_id").isNotNull() & F.col("_v").isNotNull() & finite)
    is_query = F.col("vec_id") % every == 0
    rows, width, asked = given.agg(F.count("*"), F.max(F.size("_v")), F.count_if(is_query)).first()
    if not rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    sample = given.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("_v").toArrow().column(0).combine_chunks()
    pivots = _spread(_whole(sample, width))
    n_cells, n_sides = min(len(pivots), max(1, rows // BLOCK)), min(len(pivots), max(1, asked // QUERIES))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _whole(batch.column(1), width)
            apart = np.stack([((points - p) ** 2).sum(1) for p in pivots[: max(n_cells, n_sides)]], axis=1)
            cell = apart[:, :n_cells].argmin(1)
            out = np.sqrt(apart[np.arange(len(points)), cell])
            yield _arrow(
                [batch.column(0), _lists(points), cell.astype(np.int32), apart[:, :n_sides].argmin(1).astype(np.int32), out],
                ["vec_id", "v", "cell", "side", "apart"],
            )

    data = materialise(given.mapInArrow(assign, "vec_id long, v array<double>, cell int, side int, apart double"), "vectors")
    asking = data.filter(is_query).withColumn("key", F.xxhash64("vec_id", "v")).dropDuplicates(["key", "vec_id"])
    cells = {r.cell: r for r in data.groupBy("cell").agg(F.count("*").alias("n"), F.max("apart").alias("radius")).collect()}
    sides = {r.side: r.n for r in asking.groupBy("side").agg(F.count("*").alias("n")).collect()}
    sizes = {c: r.n for c, r in cells.items()}
    parts = {c: -(-n // BLOCK) for c, n in sizes.items()}
    blocked = data.withColumn("block", _dealt("cell", sizes, BLOCK))
    probes = asking.withColumn("q_block", _dealt("side", sides, QUERIES)).select("key", F.col("vec_id").alias("query_id"), "v", "cell", "q_block")

    def blocks_of(wanted: np.ndarray) -> list[int]:
        return [int(c) << 32 | part for c in np.flatnonzero(wanted) for part in range(parts.get(int(c), 0))]

    def aimed(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            radii = np.array([cells[c].radius if c in cells else -np.inf for c in range(n_cells)])
            for batch in batches:
                at = np.arange(n_cells)[None] == batch.column("cell").to_numpy()[:, None]
                if not home:
                    q = _matrix(batch.column("v"))
                    floor = batch.column("floor").to_numpy()[:, None]
                    at = ~at & (_bounds(q, np.zeros(len(q)), pivots[:n_cells], radii.clip(0)) >= floor)
                yield _arrow([*batch.columns, pa.array([blocks_of(row) for row in at], pa.list_(pa.int64()))], [*batch.schema.names, "blocks"])

        return run

    def against(asked_with_floor: DataFrame, home: bool) -> DataFrame:
        chosen = asked_with_floor.select("key", "query_id", "v", "cell", "q_block", "floor")
        schema = "key long, query_id long, v array<double>, cell int, q_block long, floor double, blocks array<long>"
        aims = chosen.mapInArrow(aimed(home), schema).withColumn("block", F.explode("blocks"))
        return _searched(blocked, aims.select("key", "query_id", "v", "floor", "q_block", "block"), k)

    order = Window.partitionBy("key", "query_id").orderBy(F.desc("score"), "vec_id")

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    own = materialise(ranked(against(probes.withColumn("floor", F.lit(float("-inf"))), True)), "own-cell")
    kth = own.filter(F.col("rank") == k).select("key", "query_id", F.col("score").cast("double").alias("floor"))
    bounded = probes.join(kth, ["key", "query_id"], "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = own.drop("rank").unionByName(against(bounded, False))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
