"""How far the sources of a language are apart in their words, and which words set a source apart.

`CountVectorizer` finds the terms that enough documents of their language have, and every document becomes a sparse vector
of counts over them. A term is counted under its language, so that one vocabulary serves all languages and none mixes
with another. The sums of the vectors of each group (a language and a source) are all that is compared, and whether few
or many documents have a term is all that is asked of the rest; so a task adds up the documents of a language that it has at
hand, with a vector for each source over terms that stand there once, and keeps of their number what decides. Two groups share
the value of a term that neither holds, and a term's values by count are known from how many terms have that count; only
terms that both hold are looked at one by one.

The vectorizer's vocabulary passes through the driver and is broadcast, so terms are dealt by hash into as many cells as
keep every vocabulary within a bound; each cell is a table of its own with a vectorizer of its own.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.feature import CountVectorizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailscope.llm.batches import map_batches
from mailscope.llm.scratch import materialise, scratch_path

#: Bytes of terms and vectors that are looked up together; each time costs a table of the vocabulary.
WIDTH = 1 << 24
#: Different terms of batches and languages that a task adds up before they go out; more by those of one batch.
TOGETHER = 1 << 19
#: Counts of terms in documents that a task adds up before they go out; more by those of one batch.
NUMBERS = 1 << 21
#: Sums of different terms and sources that a task keeps before they go out, and rows of them that go out together.
SUMS = 1 << 20
ROWS = 1 << 17
#: Rows of shared terms that are compared at a time; those of one term stay together.
CHUNK = 1 << 16
SCALE = 1_000_000_000
#: Letters of ASCII in lower case, bytes beyond it as they are, everything else a space: what is left between spaces is a term.
LETTERS = bytes(b if b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Between a language and a term; terms do not hold it.
MARK = "\0"
#: Rows of several documents of a language, see `group_vectors`.
TERMS = "terms array<string>, held array<int>, vectors array<struct<source: string, at: array<int>, n: array<bigint>>>"


@dataclass(frozen=True)
class AuditPlan:
    """Terms of fewer than `min_documents` documents of a language are left out. `vocabulary` bounds the different
    terms, rare ones included, that one vectorizer sees, `top` the terms that are reported for a group."""

    min_documents: int = 3
    top: int = 200
    vocabulary: int = 1 << 22


def _read(documents: DataFrame) -> DataFrame:
    """`lang`, `source`, `text`, empty where missing."""
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _terms(texts: Sequence[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts in order, and how many each text has."""
    joined = np.frombuffer(b" ".join([b"", *texts, b""]).translate(LETTERS), np.uint8)
    letters = joined != 32
    edges = np.flatnonzero(letters[1:] != letters[:-1])
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(joined[letters]))
    return terms, np.diff(np.searchsorted(starts, np.cumsum([0, *(len(text) + 1 for text in texts)])))


def _row_batch(rows: Sequence[tuple[int, pa.Array, list[int], list[tuple[str, np.ndarray, np.ndarray]]]]) -> pa.RecordBatch:
    """Rows of a cell, different terms, how many are held so often, and a vector of each source."""
    cells, terms, held, vectors = zip(*rows)
    sources, at, n = zip(*(vector for of in vectors for vector in of))

    def lists(sizes: Iterable[int], flat: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), flat)

    numbers = [lists(map(len, some), pa.array(np.concatenate(some))) for some in (at, n)]
    vector = pa.StructArray.from_arrays([pa.array(sources, pa.string()), *numbers], names=["source", "at", "n"])
    columns = [
        pa.array(cells, pa.int32()), lists(map(len, terms), pa.concat_arrays(terms)), pa.array(held, pa.list_(pa.int32())),
        lists(map(len, vectors), vector),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["cell", "terms", "held", "vectors"])


def _sums_by_key(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of theirs."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


class _Group:
    """The documents of a language that a task has at hand, in parts: the different terms of a part, how many documents have
    each, and for each document and term of it the source, the term's place and its count."""

    def __init__(self) -> None:
        self.sources: dict[str, int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, sources: Sequence[str], texts: Sequence[bytes]) -> tuple[int, int]:
        """How many different terms and numbers there are more."""
        terms, sizes = _terms(texts)
        if not len(terms):
            return 0, 0
        terms = terms.dictionary_encode()
        keys = np.asarray(terms.indices) + np.repeat(np.arange(len(texts)) * len(terms.dictionary), sizes)
        keys.sort()
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        document, at = np.divmod(keys[first], len(terms.dictionary))
        of = np.array([self.sources.setdefault(s, len(self.sources)) if size else 0 for s, size in zip(sources, sizes)], np.int32)
        often = np.bincount(at, minlength=len(terms.dictionary))
        self.parts.append((terms.dictionary, often, of[document], at.astype(np.int32), np.diff(first, append=len(keys))))
        return len(terms.dictionary), len(at)

    def row(self, lang: str, least: int) -> tuple:
        """Terms of many documents first: `held[k]` of them are in more than k, up to `least`."""
        dictionaries, often, of, at, n = zip(*self.parts)
        terms = pa.concat_arrays(dictionaries).dictionary_encode()
        width, known = len(terms.dictionary), np.asarray(terms.indices)
        # Whole numbers are exact up to 2^53, far beyond what a task reads.
        often = np.minimum(np.bincount(known, np.concatenate(often), width), least)
        order = np.argsort(-often, kind="stable")
        place = np.empty(width, np.int64)
        place[order] = np.arange(width)
        starts = np.cumsum([0, *map(len, dictionaries)])
        at = np.concatenate([place[known[start + some]] for start, some in zip(starts, at)])
        keys, n = np.concatenate(of).astype(np.int64) * width + at, np.concatenate(n)
        if len(self.sources) * width <= 16 * len(keys):
            sums = np.bincount(keys, n)
            keys = np.flatnonzero(sums)
            n = sums[keys].astype(np.int64)
        else:
            keys, n = _sums_by_key(keys, n)
        cuts = np.searchsorted(keys, np.arange(len(self.sources) + 1) * width)
        parts = [slice(*cut) for cut in zip(cuts, cuts[1:])]
        vectors = [(source, (keys[some] % width).astype(np.int32), n[some]) for source, some in zip(self.sources, parts)]
        marked = pc.binary_join_element_wise(lang + MARK, terms.dictionary.take(pa.array(order)), "")
        return 0, marked, [int((often > k).sum()) for k in range(least)], vectors


def group_vectors(documents: DataFrame, least: int = 1, apart: bool = False) -> DataFrame:
    """`cell` (0), `terms`, `held` and `vectors`: rows of the terms of several documents of one language, and if `apart` one
    source, marked by language; the first `held[k]` are those of more than k of the documents, for k below `least`. A
    vector has the counts `n` of one source's documents at the places `at` of the row's terms, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, different, numbers = {}, 0, 0
        for batch in chain(batches, [None]):
            if batch is not None:
                met = defaultdict(lambda: ([], []))
                langs, sources, texts = batch.columns
                for lang, source, text in zip(langs.to_pylist(), sources.to_pylist(), texts.cast(pa.binary()).to_pylist()):
                    of, some = met[(lang, source) if apart else (lang,)]
                    of.append(source)
                    some.append(text)
                for key, (of, some) in met.items():
                    more = groups.setdefault(key, _Group()).add(of, some)
                    different += more[0]
                    numbers += more[1]
            if batch is None or different > TOGETHER or numbers > NUMBERS:
                for (lang, *_), group in groups.items():
                    if group.parts:
                        yield _row_batch([group.row(lang, least)])
                groups, different, numbers = {}, 0, 0

    return map_batches(_read(documents), run, f"cell int, {TERMS}")


def term_counts(documents: DataFrame, least: int = 1) -> DataFrame:
    """`source`, `cell` (0), `terms`, `counts` and `held`: as :func:`group_vectors`, each source in rows of its own."""
    vector = F.get("vectors", F.lit(0))
    rows = group_vectors(documents, least, apart=True)
    return rows.select(vector["source"].alias("source"), "cell", "terms", vector["n"].alias("counts"), "held")


def _dealt(counts: DataFrame, cells: int) -> DataFrame:
    """The same with the terms of a row dealt to cells by hash."""

    def dealt(terms: pa.Array, held: list[int], vectors: pa.Array) -> pa.RecordBatch:
        cell = np.array([zlib.crc32(term.encode()) % cells for term in terms.to_pylist()], np.int64)
        order = np.argsort(cell, kind="stable")
        ends = np.searchsorted(cell[order], np.arange(cells + 1))
        place = np.empty(len(cell), np.int32)
        place[order] = np.arange(len(cell)) - ends[cell[order]]
        firsts = [np.bincount(cell[:h], minlength=cells) for h in held]
        parts = [[] for _ in range(cells)]
        for source, at, n in zip(*vectors.flatten()):
            at, n = np.asarray(at.values), np.asarray(n.values)
            by = np.argsort(cell[at], kind="stable")
            at, n, cuts = at[by], n[by], np.searchsorted(cell[at[by]], np.arange(cells + 1))
            for c in np.flatnonzero(np.diff(cuts)):
                parts[c].append((source.as_py(), place[at[cuts[c] : cuts[c + 1]]], n[cuts[c] : cuts[c + 1]]))
        some = np.flatnonzero(np.diff(ends))
        return _row_batch([(c, terms.take(pa.array(order[ends[c] : ends[c + 1]])), [f[c] for f in firsts], parts[c]) for c in some])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for terms, held, vectors in zip(*(batch.column(c) for c in ("terms", "held", "vectors"))):
                yield dealt(terms.values, held.as_py(), vectors.values)

    return map_batches(counts, run, f"cell int, {TERMS}")


def _summed(cell: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """`source`, `at` (place in the vocabulary), `n`: sums of the sparse vectors by source, in parts."""

    def looked_up(rows: list[pa.RecordBatch], names: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the vocabulary, after those of the sources before, and counts."""
        table = pa.Table.from_batches(rows).combine_chunks()
        terms, vectors = (table.column(c).combine_chunks() for c in ("terms", "vectors"))
        places = pc.index_in(terms.flatten(), value_set=vocabulary.value).fill_null(-1).to_numpy()
        starts = np.concatenate([[0], np.cumsum(np.asarray(terms.value_lengths()))])[:-1]
        starts = np.repeat(starts, np.asarray(vectors.value_lengths()))
        sources, at, n = vectors.flatten().flatten()
        of = np.fromiter((names.setdefault(s, len(names)) for s in sources.to_pylist()), np.int64, len(sources))
        lengths = np.asarray(at.value_lengths())
        place = places[at.flatten().to_numpy() + np.repeat(starts, lengths)].astype(np.int64)
        held = place >= 0
        return (place + np.repeat(of * len(vocabulary.value), lengths))[held], n.flatten().to_numpy()[held]

    def put_out(keys: np.ndarray, n: np.ndarray, names: dict[str, int]) -> Iterator[pa.RecordBatch]:
        width, known = len(vocabulary.value), pa.array(list(names), pa.string())
        for start in range(0, len(keys), ROWS):
            some = slice(start, start + ROWS)
            columns = [known.take(pa.array(keys[some] // width)), pa.array((keys[some] % width).astype(np.int32)), pa.array(n[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["source", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, waiting, size = {}, [], 0
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                waiting.append(batch)
                size += batch.nbytes
            if waiting and (batch is None or size > WIDTH):
                more, of = looked_up(waiting, names)
                keys, n = _sums_by_key(np.concatenate([keys, more]), np.concatenate([n, of]))
                waiting, size = [], 0
            if batch is None or len(keys) > SUMS:
                yield from put_out(keys, n, names)
                names, keys, n = {}, keys[:0], n[:0]

    return map_batches(cell.select("terms", "vectors"), run, "source string, at int, n long")


def _least(plan: AuditPlan) -> int:
    return max(1, plan.min_documents)


def _vocabulary(spark: SparkSession, cell: DataFrame, plan: AuditPlan) -> DataFrame:
    """`at`, `marked`: places and terms that enough documents have, written by the fitted vectorizer.

    A row stands for as many lists as decide: the terms of at least one of its documents, of at least two, and so on. A
    term is in `min_documents` lists exactly if so many documents have it.
    """
    lists = F.array(*[F.slice("terms", F.lit(1), F.get("held", F.lit(k))) for k in range(_least(plan))])
    lists = cell.select(F.explode(lists).alias("terms")).where(F.size("terms") > 0)
    always = spark.createDataFrame([([MARK],)] * plan.min_documents, "terms array<string>")  # no vocabulary may be empty
    vectorizer = CountVectorizer(inputCol="terms", outputCol="vector", minDF=plan.min_documents, vocabSize=2**31 - 1)
    path = scratch_path(spark, "divergence-vocabulary")
    vectorizer.fit(lists.union(always)).save(path)
    return spark.read.parquet(f"{path}/data").select(F.posexplode("vocabulary").alias("at", "marked"))


def _unmarked(places: DataFrame) -> DataFrame:
    """`at`, `lang`, `term`, without the one that is always there."""
    term = F.substring_index("marked", MARK, -1)
    lang = F.col("marked").substr(F.lit(1), F.length("marked") - F.length(term) - 1)
    return places.where(F.col("marked") != MARK).select("at", lang.alias("lang"), term.alias("term"))


def _cell_sums(spark: SparkSession, cell: DataFrame, places: DataFrame) -> DataFrame:
    """`lang`, `source`, `term`, `n` of the terms of one cell that enough documents have."""
    terms = places.orderBy("at").select("marked").toArrow().column(0).combine_chunks()
    sums = _summed(cell, spark.sparkContext.broadcast(terms)).groupBy("source", "at").agg(F.sum("n").alias("n"))
    return sums.join(_unmarked(places), "at").select("lang", "source", "term", "n")


def _together(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for more in parts[1:]:
        result = result.union(more)
    return result


def group_sums(documents: DataFrame, plan: AuditPlan = AuditPlan()) -> tuple[DataFrame, DataFrame]:
    """`lang`, `source`, `term`, `n`: the summed vectors of each group, without zeros; and `lang`, `v`: its kept terms."""
    spark = documents.sparkSession
    counts = materialise(group_vectors(documents, _least(plan)), "divergence-counts")
    different = counts.select(F.explode("terms").alias("term")).agg(F.approx_count_distinct("term", 0.02)).first()[0]
    cells = max(1, math.ceil(different / plan.vocabulary))
    dealt = [counts]
    if cells > 1:
        path = scratch_path(spark, "divergence-cells")
        _dealt(counts, cells).write.partitionBy("cell").parquet(path)
        every = spark.read.schema(f"{TERMS}, cell int").parquet(path)
        dealt = [every.where(F.col("cell") == cell) for cell in range(cells)]
    places = [_vocabulary(spark, cell, plan) for cell in dealt]
    sums = [materialise(_cell_sums(spark, cell, known), "divergence-sums") for cell, known in zip(dealt, places)]
    kept = _together([_unmarked(known).select("lang") for known in places]).groupBy("lang").agg(F.count("*").alias("v"))
    return _together(sums), kept


def _share(n: str, total: str) -> str:
    """SQL: one more than the whole billionths that `n` + 1 is of `total`; digits by threes, so that nothing overflows."""
    value, rest = "0", f"({n} + 1)"
    for _ in range(3):
        value = f"{value} * 1000 + {rest} * 1000 div {total}"
        value, rest = f"({value})", f"({rest} * 1000 % {total})"
    return f"CASE WHEN {total} > 0 THEN 1 + {value} END"


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _both_hold(shared: DataFrame) -> DataFrame:
    """`lang`, `source`, `item`, `value`: what terms that both groups hold add to what is known without looking at them.

    `shared` has `lang`, `term`, `source`, `p`, `zero`, and all rows of a term in one task. Chunks of whole terms are compared
    by distance in the order, and a chunk gives one row for each pair of groups.
    """
    kind = "lang string, source string, item string, value long"

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        lang, term, source = (table.column(c).combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        names, groups = source.dictionary, np.asarray(source.indices)
        langs, ends = np.asarray(lang.indices), len(table)
        terms = np.asarray(term.indices).astype(np.int64) * len(lang.dictionary) + langs
        p, zero = (table.column(c).to_numpy() for c in ("p", "zero"))
        keys, values, width = [], [], len(names)
        for step in range(1, ends):
            at = np.flatnonzero(terms[step:] == terms[:-step])
            if not len(at):
                break
            for a, b in ((at, at + step), (at + step, at)):
                more = _far(p[a], p[b]) - _far(p[a], zero[b]) - _far(zero[a], p[b]) + _far(zero[a], zero[b])
                pairs, place = np.unique((langs[a].astype(np.int64) * width + groups[a]) * width + groups[b], return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, place, more)
                keys.append(pairs)
                values.append(sums)
        if keys:
            pairs, place = np.unique(np.concatenate(keys), return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, place, np.concatenate(values))
            columns = [lang.dictionary.take(pairs // width // width), names.take(pairs // width % width), names.take(pairs % width)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sums)], names=["lang", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.Table.from_batches([batch])
            kept = batch if kept is None else pa.concat_tables([kept, batch])
            if len(kept) >= CHUNK:
                last = kept.slice(len(kept) - 1)
                lang, term = last.column("lang")[0].as_py(), last.column("term")[0].as_py()
                open_ = len(kept) - 1
                while open_ and kept.column("term")[open_ - 1].as_py() == term and kept.column("lang")[open_ - 1].as_py() == lang:
                    open_ -= 1
                yield from compared(kept.slice(0, open_))
                kept = kept.slice(open_)
        if kept is not None:
            yield from compared(kept)

    return shared.select("lang", "term", "source", "p", "zero").sortWithinPartitions("term", "lang").mapInArrow(run, kind)


def audit(documents: DataFrame, plan: AuditPlan = AuditPlan()) -> DataFrame:
    """One row per group and other source of its language (part `pair`), and per group and term that it has more of than
    its language, the `plan.top` first only (part `term`): `lang`, `source`, `part`, `item`, `value`, `rank`.

    With N the occurrences of kept terms in a group or language and V the kept terms of the language, a term's p is one
    more than the whole billionths that its count plus one is of N + V. A value is the whole part of (p - q)^2 / q, for a
    term with q its language's, for a pair summed over all kept terms with q the other source's. Ranks start at 1 in each
    group and part, large values first, then items in the order of their bytes.

    Missing texts, languages and sources are empty. A group whose language keeps no terms has pairs of value 0 and no
    terms; a language of one source has no pairs. Repeated rows count each. Other columns are ignored. No rows in, no rows
    out. Arithmetic is exact up to 9 * 10^15 occurrences.
    """
    sums, kept = group_sums(documents, plan)
    sizes = materialise(sums.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), "divergence-sizes")
    langs = kept.join(sizes.groupBy("lang").agg(F.sum("group_n").alias("lang_n")), "lang")
    groups = _read(documents).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(
        "lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
        F.coalesce("group_n", F.lit(0)).alias("group_n"),
    )
    groups = materialise(groups.withColumn("zero", F.expr(_share("0", "(group_n + v)"))), "divergence-groups")

    # One shuffle brings the groups of a term together, for its total and for the pairs that both hold it; terms come first in
    # its order, since languages tell few rows apart.
    met = sums.withColumn("term_n", F.sum("n").over(Window.partitionBy("term", "lang"))).join(groups, ["lang", "source"])
    shares = met.withColumn("p", F.expr(_share("n", "(group_n + v)")))
    common = shares.withColumn("q", F.expr(_share("term_n", "(lang_n + v)")))
    telling = common.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    counts = sums.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(groups, ["lang", "source"])
    counts = counts.select("lang", "source", "zero", "k", F.expr(_share("n", "(group_n + v)")).alias("p"))
    beside = counts.join(other, "lang").where("source <> item")
    none = _apart("zero", "other")
    held = beside.groupBy("lang", "source", "item").agg(
        F.expr(f"sum(k * ({_apart('p', 'other')} - {none}))").alias("first"),
        F.expr(f"sum(k * ({_apart('other', 'p')} - {_apart('other', 'zero')}))").alias("second"),
    )
    pairs = groups.join(other, "lang").where("source <> item")
    known = pairs.select("lang", "source", "item", F.expr(f"CASE WHEN v > 0 THEN v * {none} ELSE 0 END").alias("value"))
    known = known.union(held.select("lang", "source", "item", "first"))
    known = known.union(held.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "second"))
    pairs = known.union(_both_hold(shares.where("term_n > n"))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    group = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(group).alias("rank"))
    terms = telling.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(group).alias("rank"))
    return ranked.union(terms.where(F.col("rank") <= plan.top))
