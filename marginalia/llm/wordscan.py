"""Words of whole Arrow batches as bytes: letters and digits of ASCII and every character beyond it, A-Z in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_IN_WORD = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
_FOLD = bytes(ord(chr(c).lower()) if c < 0x80 and _IN_WORD[c] else c if _IN_WORD[c] else 0x20 for c in range(256))


def folded(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All texts' UTF-8 one after the other, what isn't part of a word made a space, and where each text begins (one more entry: the end). Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = data.slice(int(bounds[0]), int(bounds[-1] - bounds[0])).to_pybytes() if data is not None else b""
    return raw.translate(_FOLD), bounds - bounds[0]


def word_counts(data: bytes, bounds: np.ndarray) -> np.ndarray:
    """The number of words of each text."""
    inside = np.frombuffer(data, np.uint8) != 0x20
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    begins[edges] = inside[edges]  # a text's first character doesn't go on with the text before
    total = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
