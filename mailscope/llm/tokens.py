"""Token ids of whole texts with the tokenizers library.

Encoding is by far the largest cost, and most of it goes into words met before. So a text is cut where no token can
cross the cut - in front of white space that follows something else - and the ids of the cuts are remembered in a
dictionary of bounded size. The ids are those of the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space before a run of anything else, or at the end. Both tokenizers' patterns start a new token there.
CUT = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: Where one of these stands, cuts at single spaces are not enough.
SPACED = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
#: White space and controls that the two libraries could class differently: such texts are encoded in one go.
UNUSUAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
MARKS = ".,;:!?"
#: Cuts remembered by a worker, about 200 bytes each: where memory is shared with other stages, and where it is not.
REMEMBERED, REMEMBERED_ALONE = 300_000, 900_000
#: Characters of texts that are cut and looked up together.
TOGETHER = 1 << 22
#: The name of a tokenizer's file with the package that holds the files.
DEFAULT_PACKAGE = "public_tokenizers"


def tokenizer_path(name: str, package: str = DEFAULT_PACKAGE) -> str:
    """Where a worker finds a vocabulary file; a path is taken as it is."""
    if "/" in name:
        return name
    from importlib import import_module

    return import_module(package).path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies spell printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Places of the ids of what stands between two spaces, or, after a NUL, of the same without a space before it.

    A place leads to a stretch of one long array of ids. What is met beyond `remembered` is forgotten again."""

    def __init__(self, name: str, remembered: int):
        super().__init__()
        self.remembered = remembered
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.openings = {content[0] for content in added}
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE)
        self.model = self.tokenizer.model
        self.lowers = self.tokenizer.normalizer is not None
        self.spells = _byte_letters()
        self.flat, self.starts, self.lengths = array("I"), array("q"), array("q")
        self.newline = self.encode("\n")

    def holds_added(self, text: str) -> bool:
        """Whether the text may hold a token that the file adds to its vocabulary; such texts go to the library whole."""
        return any(map(text.__contains__, self.openings)) and self.added.search(text) is not None

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters(self, word: str, bare: bool) -> list[int]:
        """A word of letters is one piece to the merges of the vocabulary."""
        if self.lowers:
            word, bare = word.lower(), True
        if not word.isascii():
            word = "".join(map(self.spells.__getitem__, word.encode()))
        return [p.id for p in self.model.tokenize(word if bare else self.spells[0x20] + word)]

    def stretch(self, cut: str) -> list[int]:
        place = self[cut]
        return self.flat[self.starts[place] : self.starts[place] + self.lengths[place]].tolist()

    def _composed(self, cut: str) -> list[int]:
        bare = cut[:1] == "\0"
        word = cut[1:] if bare else cut
        if word[:1] == "\n" and len(word) > 1:
            return self.newline + self.stretch("\0" + word[1:])
        stem = word.rstrip(MARKS)
        if LETTERS.fullmatch(stem):
            if len(stem) == len(word):
                return self._letters(word, bare)
            return self.stretch("\0" + stem if bare else stem) + self.stretch("\0" + word[len(stem):])
        return self.encode(word if bare else " " + word)

    def add(self, ids: list[int]) -> int:
        self.starts.append(len(self.flat))
        self.lengths.append(len(ids))
        self.flat.extend(ids)
        return len(self.starts) - 1

    def __missing__(self, cut: str) -> int:
        simple = cut.isalpha() and (cut.isascii() or LETTERS.fullmatch(cut))
        place = self[cut] = self.add(self._letters(cut, False) if simple else self._composed(cut))
        return place

    def forget(self) -> None:
        """Back to the first `remembered` places, between batches."""
        if len(self.starts) > self.remembered:
            for cut in list(takewhile(lambda c: self[c] >= self.remembered, reversed(self))):  # later cuts, later places
                del self[cut]
            del self.flat[self.starts[self.remembered] :]
            del self.starts[self.remembered :], self.lengths[self.remembered :]


class Encoder:
    """Ids of texts by one vocabulary file, those that the library gives for the whole text."""

    def __init__(self, name: str, remembered: int = REMEMBERED):
        self._known = _Known(name, remembered)

    def _alone(self, text: str) -> list[int]:
        """Ids of a text in which cuts at single spaces are not enough."""
        if self._known.holds_added(text) or not text.replace("\n", " ").isprintable() and UNUSUAL.search(text):
            return self._known.encode(text)
        return list(chain.from_iterable(map(self._spaced, CUT.findall(text))))

    def _spaced(self, cut: str) -> list[int]:
        if cut[0] not in " \t\n\r":
            return self._known.stretch("\0" + cut)
        return self._known.stretch(cut[1:]) if cut[0] == " " and cut[1:2].strip() else self._known.encode(cut)

    def _together(self, texts: list[str], end: list[int]) -> list[np.ndarray]:
        """Ids of texts with single spaces and line feeds only, `end` after each: each different cut is looked up once."""
        known = self._known
        known.forget()
        joined = pc.replace_substring(pa.array(texts), "\n", " " if known.lowers else " \n")
        if known.lowers:  # what the vocabulary does anyway; so fewer cuts differ
            joined = pc.ascii_lower(joined)
        split = pc.split_pattern(joined, " ")
        cuts = split.flatten().dictionary_encode()
        words = cuts.dictionary.to_numpy(zero_copy_only=False).tolist()
        which, bounds = cuts.indices.to_numpy(), split.offsets.to_numpy()
        firsts = [known["\0" + words[which[at]]] for at in bounds[:-1]]
        places = np.fromiter(map(known.__getitem__, words), np.int64, len(words))[which]
        places[bounds[:-1]] = firsts
        places = np.insert(places, bounds[1:], known.add(end))
        lengths = np.frombuffer(known.lengths, np.int64)[places]
        ends = np.cumsum(lengths)
        shift = np.frombuffer(known.starts, np.int64)[places] - (ends - lengths)
        ids = np.frombuffer(known.flat, np.uint32)[np.repeat(shift, lengths) + np.arange(ends[-1])]
        return np.split(ids, ends[bounds[1:-1] + np.arange(len(texts) - 1)])

    def batch(self, texts: list[str | None], end: int | None = None) -> Iterator[np.ndarray]:
        """Ids of each text as unsigned 32-bit numbers, with `end` after them; a null text is empty."""
        tail = [] if end is None else [end]
        plain: list[str] = []
        odd: dict[int, np.ndarray] = {}

        def done() -> Iterator[np.ndarray]:
            found = iter(self._together(plain, tail) if plain else ())
            for i in range(len(plain) + len(odd)):
                yield odd[i] if i in odd else next(found)
            plain.clear()
            odd.clear()

        size = 0
        for text in texts:
            if not text:
                odd[len(plain) + len(odd)] = np.array(tail, np.uint32)
            elif (
                text[0] in " \n" or text[-1] in " \n" or any(map(text.__contains__, SPACED))
                or not text.replace("\n", " ").isprintable() and UNUSUAL.search(text) or self._known.holds_added(text)
            ):
                odd[len(plain) + len(odd)] = np.array(self._alone(text) + tail, np.uint32)
            else:
                plain.append(text)
            size += len(text or "")
            if size > TOGETHER:
                yield from done()
                size = 0
        yield from done()

    def ids(self, text: str | None, end: int | None = None) -> np.ndarray:
        return next(self.batch([text], end))


@lru_cache(maxsize=4)
def encoder(name: str, remembered: int = REMEMBERED) -> Encoder:
    """One encoder per worker and file, kept between tasks."""
    return Encoder(name, remembered)
