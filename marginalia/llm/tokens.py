"""Encoding whole Arrow batches of texts with public tokenizers, inside tasks."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = "\x01"
#: Letters that stay one letter in lower case and in every normal form, so that no vocabulary's normaliser makes more of them.
_LETTERS = [c for c in map(chr, range(0x41, 0x250)) if c.isalpha() and all(len(x) == 1 and x.isalpha() for f in ("NFC", "NFKC") for x in (unicodedata.normalize(f, c), unicodedata.normalize(f, c.lower())))]
_MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]  # contractions begin with the apostrophe
#: Special tokens begin so, and the library looks for them before it splits; white space that engines disagree about.
_DOUBTFUL = r"<\||[\x01\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_RUN = r"[ \t\n\r][ \t\n\r]"
#: The memo is emptied when it has so many segments; longer ones aren't kept. So its memory is bounded.
MEMO_SEGMENTS = 150_000
MEMO_CHARS = 64
#: Segments of letters are encoded as texts of so many, each with this mark behind it.
JOINED, _STOP = 500, "."


def _joined(arrays: list[pa.Array]) -> pa.Array:
    return pa.concat_arrays(arrays)


class Encoder:
    """The ids that the tokenizers library gives for whole texts, with each distinct segment encoded once.

    Both public vocabularies split a text before they merge: no token spans the place between a Latin letter and a
    punctuation mark, that before single white space, or that after a line feed. Texts are cut at those places, but
    between a letter and a mark only where the library, asked for every such pair when the vocabulary is loaded, cuts too. Special
    tokens, and white space that engines disagree about, send the whole text to the library; so do runs of white
    space, if the vocabulary keeps white space at all.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and threads have memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        a, big, spaced = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in ("a", "A", " a\n"))
        self.folds_case, self.drops_white = a == big, a == spaced
        letters, marks = self._proven()
        self.cuts = f"([{letters}])([{marks}])|([{marks}])([{letters}])"
        self.plain, self.stop = f"^ ?[{letters}]+$", self.tokenizer.encode(_STOP, add_special_tokens=False).ids
        self._forget()

    def _proven(self) -> tuple[str, str]:
        """The letters, as a class of a regular expression, that every mark is parted from on both sides; and the marks."""
        alone = dict(zip([*_LETTERS, *_MARKS], (x.tolist() for x in self._library([*_LETTERS, *_MARKS])), strict=True))
        pairs = [p for c in _LETTERS for m in _MARKS for p in ((c, m), (m, c))]
        bad = set()
        for k in range(0, len(pairs), 2000):
            part = pairs[k : k + 2000]
            for (a, b), ids in zip(part, self._library([a + b for a, b in part]), strict=True):
                if ids.tolist() != alone[a] + alone[b]:
                    bad |= {a, b}
        return "".join(c for c in _LETTERS if c not in bad), "".join(f"\\x{ord(m):02x}" for m in _MARKS)

    def _forget(self) -> None:
        self.known, self.flat, self.sizes = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of(self, plain: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of segments of letters. A mark is parted from letters and from white space before them, so they are encoded as texts of many, with a mark behind each."""
        parts = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)]
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for part, found in zip(parts, self._library([_STOP.join([*part, ""]) for part in parts]), strict=True):
            stops = found == self.stop[0]
            ends = np.flatnonzero(stops)
            own = np.diff(ends, prepend=-1) - 1
            if len(ends) == len(part) and own.all():
                ids.append(found[~stops])
                sizes.append(own)
            else:  # a vocabulary in which letters make the mark or nothing
                each = self._library(part)
                ids += each
                sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _segments(self, texts: pa.Array) -> pa.Array:
        """A list of segments for each text."""
        cut = " " if self.drops_white else _CUT
        texts = pc.replace_substring_regex(texts, self.cuts, rf"\1\3{cut}\2\4")
        if self.folds_case:
            texts = pc.ascii_lower(texts)
        if self.drops_white:
            return pc.ascii_split_whitespace(texts)
        texts = pc.replace_substring(pc.replace_substring(texts, "\n", f"{_CUT}\n{_CUT}"), " ", f"{_CUT} ")
        return pc.split_pattern(texts, _CUT)

    def _codes(self, distinct: pa.Array) -> np.ndarray:
        """Places in the memo, which gets the segments that it lacks."""
        if len(self.known) > MEMO_SEGMENTS:
            self._forget()
        at = pc.index_in(distinct, value_set=self.known)
        places = np.array(pc.fill_null(at, 0), dtype=np.int64)
        if at.null_count:
            missing = distinct.filter(at.is_null())
            plain = np.asarray(pc.match_substring_regex(missing, self.plain)) & (len(self.stop) == 1)
            order = np.argsort(~plain, kind="stable")
            places[np.flatnonzero(at.is_null())[order]] = len(self.known) + np.arange(at.null_count)  # one lookup: they are appended in this order
            missing = missing.take(pa.array(order))
            n = int(plain.sum())
            ids, sizes = self._ids_of(missing.slice(0, n).to_pylist())
            found = self._library(missing.slice(n).to_pylist())
            more = np.fromiter(map(len, found), np.int64, len(found))
            self.flat, self.sizes = np.concatenate([self.flat, ids, *found]), np.concatenate([self.sizes, sizes, more])
            self.known = _joined([self.known, missing])
        return places

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one more entry: the end). Null is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, _DOUBTFUL if self.drops_white else f"{_DOUBTFUL}|{_RUN}")
        lists = self._segments(pc.if_else(odd, "", texts))
        starts, coded = np.asarray(lists.offsets), lists.flatten().dictionary_encode()
        distinct = coded.dictionary
        places = self._codes(distinct)
        first = np.cumsum(self.sizes) - self.sizes
        codes = places[np.asarray(coded.indices)]
        n = self.sizes[codes]
        ends = np.cumsum(n)
        bounds = np.concatenate([[0], ends])[starts - starts[0]]
        ids = self.flat[np.repeat(first[codes] - (ends - n), n) + np.arange(bounds[-1])]
        short = pc.less_equal(pc.binary_length(self.known), MEMO_CHARS)
        if not pc.all(short).as_py():
            self.flat = self.flat[np.repeat(np.asarray(short), self.sizes)]
            self.sizes, self.known = self.sizes[np.asarray(short)], self.known.filter(short)
        if pc.any(odd).as_py():
            where = np.flatnonzero(np.asarray(odd))
            each = np.split(ids, bounds[1:-1])
            for i, own in zip(where, self._library(texts.take(pa.array(where)).to_pylist()), strict=True):
                each[i] = own
            ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        return ids, bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def bounded(texts: pa.Array, chars: int = 5_000_000):
    """Slices of (start, length) with about so many bytes of text at most, or one text."""
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    start = 0
    while start < len(texts):
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + chars, side="right")))
        yield start, end - start
        start = end


@lru_cache(maxsize=2)
def sentencepiece_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
