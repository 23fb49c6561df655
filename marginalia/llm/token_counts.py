"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text beyond ``chunk_bytes`` is encoded in chunks that overlap. Each encoding gives the offsets of its token
boundaries. Two neighbouring chunks are spliced at a boundary that both have and that is proven stable: no piece of
the vocabulary holds the two characters around it side by side, so no merge crosses it, whatever stands before or after.
Where an overlap has no such boundary it is doubled and, beyond the chunk, the chunk with it, up to the whole text.

At scale: one pass without a shuffle; memory is bounded by a batch of texts and the chunks, not by a text's tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.shared import lean

CHUNK_BYTES = 16_384
OVERLAP_BYTES = 256


class Resynchroniser:
    def __init__(self, model_path: str):
        self.model = tokens.sentencepiece_model(model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p.replace("▁", " ") for p in pieces]
        self.width = np.array([1 if self.model.is_byte(i) else len(p.encode()) for i, p in enumerate(plain)], dtype=np.int64)
        self.beside = {p[i : i + 2] for p in plain for i in range(len(p) - 1)}

    def _ends(self, part: bytes, at: int) -> np.ndarray | None:
        """Offsets in the document at which the tokens of a part end; None if the model's normaliser changes the text."""
        ends = np.cumsum(self.width[self.model.encode(part.decode())]) - 1  # the model puts a space before a text
        return ends + at if len(ends) and ends[-1] == len(part) else None

    def _stable(self, data: bytes, at: int) -> bool:
        before, after = data[max(0, at - 4) : at].decode(errors="ignore")[-1:], data[at : at + 4].decode(errors="ignore")[:1]
        return (data[at] & 0xC0) != 0x80 and before + after not in self.beside

    def _splice(self, data: bytes, left: np.ndarray, right: np.ndarray, low: int) -> int | None:
        """The first common, stable boundary after low."""
        common = np.intersect1d(left[left > low], right, assume_unique=False)
        return next((int(x) for x in common if x < len(data) and self._stable(data, int(x))), None)

    def count(self, text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> int:
        data = text.encode()
        if len(data) <= chunk:
            return len(self.model.encode(text))

        def aligned(at: int) -> int:
            while 0 < at < len(data) and (data[at] & 0xC0) == 0x80:
                at -= 1
            return at

        total, spliced, start, size = 0, -1, 0, chunk  # the space before the text ends at 0
        end = aligned(size)
        left = self._ends(data[:end], 0)
        while left is not None and end < len(data):
            wide, at = overlap, None
            while at is None:
                after = aligned(end - wide)
                if after <= max(start, spliced):
                    break
                stop = aligned(min(len(data), after + max(chunk, 2 * wide)))
                right = self._ends(data[after:stop], after)
                if right is None:
                    return len(self.model.encode(text))
                at = self._splice(data, left, right, max(after, spliced))
                wide *= 2
            if at is None:  # no room for a wider overlap: widen the chunk
                size *= 2
                end = aligned(min(len(data), start + size))
                left = self._ends(data[start:end], start)
                continue
            total += int(((left > spliced) & (left <= at)).sum())
            spliced, start, end, left, size = at, after, stop, right, chunk
        if left is None:
            return len(self.model.encode(text))
        return total + int((left > spliced).sum())


@lru_cache(maxsize=2)
def resynchroniser(model_path: str) -> Resynchroniser:
    return Resynchroniser(model_path)


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", *,
    limit: int = 4096, chunk_bytes: int = CHUNK_BYTES, overlap_bytes: int = OVERLAP_BYTES,
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (more tokens than ``limit``).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are returned as they are; other
    columns are ignored; an empty table gives an empty result. The length of a text isn't limited.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = resynchroniser(model_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            sizes = np.asarray(pc.binary_length(texts), dtype=np.int64)
            counts = np.zeros(len(texts), dtype=np.int64)
            for start, n in tokens.bounded(texts, 2_000_000):
                part = texts.slice(start, n).to_pylist()
                small = [i for i in range(n) if sizes[start + i] <= chunk_bytes]
                for i, ids in zip(small, own.model.encode([part[i] for i in small], num_threads=1), strict=True):
                    counts[start + i] = len(ids)
                for i in range(n):
                    if sizes[start + i] > chunk_bytes:
                        counts[start + i] = own.count(part[i], chunk_bytes, overlap_bytes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(counts), pa.array(counts > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
