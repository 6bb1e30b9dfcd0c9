"""Language identification by error-correcting output codes.

Every language has a codeword. For each bit of it a binary classifier of character n-grams says on which side a text
lies; the language whose codeword agrees best is the prediction, so a few wrong bits are corrected by the others.
Each classifier is the log-odds of n-grams between the languages with the bit and those without, from counts over
all learning texts; its loss counts as much as it separates the two sides. Counting and predicting are one pass each
over whole texts; what comes to the driver are n-gram counts per language, a table of fixed size each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Table size of the hashed n-grams, of one to three characters; added to every count.
TABLE, SMOOTHING = 1 << 15, 0.5
#: Characters worked on at a time, whatever the length of a text.
PIECE = 1 << 20
#: Below this lead over the second language a prediction is marked ambiguous.
LEAD = 0.1
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of texts, one text after another and any run of other characters as a space, as code
    points; and the index of the text for each."""
    joined = "\n".join(texts).lower()  # may change lengths, not the line feeds that stand between texts
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    letter = _letters(codes)
    text = np.cumsum(codes == 10, dtype=np.int32) - (codes == 10)  # a line feed ends its text
    codes = np.where(letter, codes, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    return codes[keep], text[keep]


_IS_LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])


def _letters(codes: np.ndarray) -> np.ndarray:
    return _IS_LETTER[codes]


def _grams(codes: np.ndarray, firsts: np.ndarray) -> list[np.ndarray]:
    """Table places of the n-grams that end at each character, for one, two and three characters. Before the first
    character of a text, at `firsts`, stand spaces."""
    one = codes * _MIX[0]
    before = np.roll(codes, 1)
    before[firsts] = 32
    two = (one ^ (before * _MIX[1])) * _MIX[0]
    third = np.roll(before, 1)
    third[firsts] = 32
    three = (two ^ (third + _MIX[1])) * _MIX[1]
    return [(h >> np.uint32(17)).astype(np.int32) for h in (one, two, three)]


def _firsts(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(text, prepend=-1))


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts in groups of about `PIECE` characters: which text, and what of it. Line feeds become spaces."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, len(text or ""), PIECE):
            owners.append(i)
            parts.append(text[at : at + PIECE].replace("\n", " "))
            size += len(parts[-1])
            if size >= PIECE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def codewords(languages: int) -> np.ndarray:
    """One row of +1 and -1 per language: all ways to part up to five languages, else rows of a Hadamard matrix, any
    two of which differ in half their bits. A single language has one bit."""
    if languages <= 5:
        ways = range(1, 1 << max(languages - 1, 1)) if languages > 1 else [0]
        return np.array([[-1 if way >> i & 1 else 1 for way in ways] for i in range(languages)], float).reshape(languages, len(ways))
    matrix = np.ones((1, 1))
    while len(matrix) < max(16, languages + 1):
        matrix = np.block([[matrix, matrix], [matrix, -matrix]])
    return matrix[1 : languages + 1, 1:]


@dataclass(frozen=True)
class Model:
    """`weights`: n-gram by bit, scaled so that a typical text of either side gives +1 or -1. `trust`: of each bit."""

    languages: tuple[str, ...]
    words: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted distance of each text (its margin per bit) to each codeword."""
        agreement = margins[:, None, :] * self.words[None]
        return (np.logaddexp(0.0, -4 * agreement) * self.trust).sum(2) / self.trust.sum()


def model_of(languages: list[str], counts: np.ndarray) -> Model:
    """`counts`: language by n-gram, the three lengths one after another. Languages weigh the same however many texts
    they have."""
    shares = counts.reshape(len(languages), 3, TABLE) + SMOOTHING
    shares = (shares / shares.sum(2, keepdims=True)).reshape(len(languages), 3 * TABLE)
    words = codewords(len(languages))
    weights, trust = [], []
    for bit in words.T:
        sides = [shares[bit == s].mean(0) if (bit == s).any() else np.full(shares.shape[1], 1 / TABLE) for s in (1, -1)]
        odds = np.log(sides[0] / sides[1])
        typical = (shares * odds).sum(1) / 3
        high, low = typical[bit == 1].mean() if (bit == 1).any() else 1.0, typical[bit == -1].mean() if (bit == -1).any() else -1.0
        gap = max((high - low) / 2, 1e-9)
        weights.append((odds - (high + low) / 2) / gap)
        trust.append(gap)
    return Model(tuple(languages), words, np.array(weights, np.float32).T.copy(), np.array(trust))


def learn(examples: DataFrame) -> Model:
    """Fit on all rows of `text` and `lang`; rows without a language or a letter teach nothing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for owners, parts in _pieces(batch.column(0).to_pylist()):
                codes, text = _codes(parts)
                grams = _grams(codes, _firsts(text))
                numbers = {lang: tables.setdefault(lang, np.zeros(3 * TABLE, np.int64)) for lang in {langs[o] for o in owners}}
                for lang, table in numbers.items():
                    own = np.array([langs[o] == lang for o in owners])[text]
                    for k, places in enumerate(grams):
                        table[k * TABLE : (k + 1) * TABLE] += np.bincount(places[own], minlength=TABLE)
        for lang, table in tables.items():
            for at in range(0, 3 * TABLE, TABLE // 4):  # not one row for all, so that adding up is shared out
                part = table[at : at + TABLE // 4]
                where = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(where)), pa.array(where + at), pa.array(part[where])], names=["lang", "gram", "n"]
                )

    rows = examples.filter("lang is not null and text is not null").select("text", "lang")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((len(names), 3 * TABLE))
    at = np.searchsorted(names, found.column("lang").to_pylist()) if names else []
    counts[at, found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return model_of(names, counts)


def _predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and ambiguity of each text."""
    bits = model.words.shape[1] if model.languages else 0
    sums, grams = np.zeros((len(texts), bits)), np.zeros(len(texts))
    for owners, parts in _pieces(texts) if bits else ():
        codes, text = _codes(parts)
        if not len(codes):
            continue
        firsts = _firsts(text)
        owner = np.array(owners)[text[firsts]]
        places = _grams(codes, firsts)
        for bit in range(bits):
            column = model.weights[:, bit]
            worth = sum(column[k * TABLE : (k + 1) * TABLE][p] for k, p in enumerate(places))
            np.add.at(sums[:, bit], owner, np.add.reduceat(worth, firsts, dtype=np.float64))
        np.add.at(grams, owner, np.diff(np.append(firsts, len(codes))))
    known = grams > 0
    langs, score, unclear = np.full(len(texts), "und", object), np.zeros(len(texts)), known.copy()
    if known.any():
        losses = model.losses(sums[known] / (3 * grams[known, None]))
        chance = np.exp(-2 * (losses - losses.min(1, keepdims=True)))
        chance /= chance.sum(1, keepdims=True)
        best = losses.argmin(1)
        ranked = np.sort(losses, axis=1)
        langs[known] = np.array(model.languages, object)[best]
        score[known] = chance.max(1)
        unclear[known] = ranked[:, 1] - ranked[:, 0] < LEAD if len(model.languages) > 1 else False
    return langs.tolist(), score, unclear


def predict(documents: DataFrame, model: Model, carry: list[str]) -> DataFrame:
    """`carry` (not named `text`) and `lang_pred`, `score`, `ambiguous`, from `text` alone."""
    schema = documents.select(*carry).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, score, unclear = _predict(model, batch.column(0).to_pylist())
            columns = [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(score), pa.array(unclear)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "lang_pred", "score", "ambiguous"])

    out = schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return documents.select("text", *carry).mapInArrow(run, out)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: a fixed quarter by the checksum of the id; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def identify(documents: DataFrame) -> DataFrame:
    """One row per document: `doc_id`, `held_out`, `lang_pred`, `score` (0 to 1), `ambiguous`.

    Learned from `text` and `lang` of documents that are not held out. Null texts and texts without a letter are
    `und` with score 0, as are all if nothing could be learned. Repeated rows each get a row and each teach. Other
    columns are ignored. No rows in, no rows out.
    """
    marked = documents.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(marked, learn(marked.filter("not held_out")), ["doc_id", "held_out"])
