"""Token-id files with directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds every id's lowest chunk; a bitmap says which ids go on, and the
next level holds the next chunk of those only. A rank directory (ones before every 512th bit) finds an id's place on the
next level, so any token is read without decoding those before it.

A file: magic, length of the header, header (JSON: counts and places), then document ids, document starts and, for each
level, chunks, bitmap and directory, each at a multiple of 8 bytes.

At scale: documents are range-partitioned by id, each task encodes its own range and writes shards of bounded size to the
shared folder under names that depend on the range only, so a task that runs again writes the same file again. The
starts of shards are sums over one row a shard. Reading is one task for each group of shards.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.shared import Scratch, lean

MAGIC = b"DACTOK01"
BITS = 8
BLOCK = 512
SHARD_TOKENS = 4_000_000


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per level: chunks, continuation bitmap, rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> BITS > 0
        bitmap = np.packbits(more, bitorder="little")
        bitmap = np.concatenate([bitmap, np.zeros(-len(bitmap) % (BLOCK // 8), np.uint8)])
        ones = np.bitwise_count(bitmap).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint64)
        levels.append(((rest & ((1 << BITS) - 1)).astype(np.uint8), bitmap, np.cumsum(ones) - ones))
        if not more.any():
            return levels
        rest = rest[more] >> BITS


def to_bytes(ids: np.ndarray, doc_ids: list, starts: np.ndarray) -> bytes:
    known = [-1 if x is None else x for x in doc_ids]
    parts = [np.array(known, "<i8"), np.array([x is None for x in doc_ids], np.uint8), starts.astype("<u8")]
    for chunks, bitmap, ranks in encode_levels(ids):
        parts += [chunks, bitmap, ranks.astype("<u8")]
    at, places, body = 0, [], []
    for part in parts:
        raw = part.tobytes()
        places.append([at, len(raw)])
        raw += b"\0" * (-len(raw) % 8)
        body.append(raw)
        at += len(raw)
    head = json.dumps({"tokens": len(ids), "docs": len(doc_ids), "levels": (len(parts) - 3) // 3, "parts": places}).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])


class TokenFile:
    """A file in memory. ``token(i)`` and ``tokens(i, j)`` read by place; ``doc_ids`` and ``starts`` are the documents."""

    def __init__(self, raw: bytes | pa.Buffer):
        view = memoryview(raw)
        if bytes(view[:8]) != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(view[8:16], "little")
        head = json.loads(bytes(view[16 : 16 + size]))
        part = lambda k, kind: np.frombuffer(view[16 + size + head["parts"][k][0] :][: head["parts"][k][1]], dtype=kind)
        self.n = head["tokens"]
        self.doc_ids = [None if no else int(x) for x, no in zip(part(0, "<i8"), part(1, np.uint8), strict=True)]
        self.starts = part(2, "<u8").astype(np.int64)
        self.levels = [(part(3 + 3 * k, np.uint8), part(4 + 3 * k, np.uint8), part(5 + 3 * k, "<u8")) for k in range(head["levels"])]

    def _rank(self, level: int, at: int) -> int:
        _, bitmap, ranks = self.levels[level]
        block = at // BLOCK
        if block == len(ranks):
            return int(ranks[-1]) + int(np.bitwise_count(bitmap[-(BLOCK // 8) :]).sum())
        whole = int(np.bitwise_count(bitmap[block * BLOCK // 8 : at // 8]).sum())
        last = int(bitmap[at // 8]) & ((1 << at % 8) - 1) if at % 8 else 0
        return int(ranks[block]) + whole + last.bit_count()

    def token(self, at: int) -> int:
        value = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[at]) << (BITS * level)
            if not bitmap[at // 8] >> at % 8 & 1:
                break
            at = self._rank(level, at)
        return value

    def tokens(self, start: int, stop: int, level: int = 0) -> np.ndarray:
        chunks, bitmap, _ = self.levels[level]
        out = chunks[start:stop].astype(np.uint32)
        more = np.unpackbits(bitmap[start // 8 : (stop + 7) // 8], bitorder="little")[start % 8 :][: stop - start].astype(bool)
        if more.any():
            first = self._rank(level, start)
            out[more] |= self.tokens(first, first + int(more.sum()), level + 1) << BITS
        return out


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes all documents in ascending id order (null ids first; rows with equal ids by text). Returns the manifest:
    shard, part, path, docs, tokens. Null texts are empty: they have the end id only. An empty table writes no file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = tokens.encoder(tokenizer_path), TaskContext.get()
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        shard, part, have, ids, lengths, own = task.partitionId(), 0, 0, [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal part, have, ids, lengths, own
            sizes = np.concatenate(lengths)
            path = f"{base}/shard-{shard:06d}-{part:04d}.dac"
            with fs.open_output_stream(f"{path}.{task.taskAttemptId()}") as out:
                out.write(to_bytes(np.concatenate(ids), own, np.cumsum(sizes) - sizes))
            fs.move(f"{path}.{task.taskAttemptId()}", path)
            row = pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "path": [f"{folder}/{path.rpartition('/')[2]}"], "docs": [len(own)], "tokens": [have]})
            part, have, ids, lengths, own = part + 1, 0, [], [], []
            return row

        for batch in batches:
            for start, n in tokens.bounded(batch.column(1)):
                found, bounds = encoder.encode(batch.column(1).slice(start, n))
                sizes = np.diff(bounds)
                ended = np.insert(found, bounds[1:], end_id).astype(np.uint32)
                ids.append(ended)
                lengths.append(sizes + 1)
                own += batch.column(0).slice(start, n).to_pylist()
                have += len(ended)
                if have >= shard_tokens:
                    yield flush()
        if own:
            yield flush()

    return ordered.mapInArrow(write, "shard long, part long, path string, docs long, tokens long")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, as the files have it: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    tasks = max(1, 4 * spark.sparkContext.defaultParallelism)

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = pafs.FileSystem.from_uri(row["path"])
                with fs.open_input_file(path) as f:
                    file = TokenFile(f.read_buffer())
                ends = np.append(file.starts[1:], file.n)
                sums = [zlib.crc32(file.tokens(s, e).astype("<u4").tobytes()) for s, e in zip(file.starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, pa.int64()), pa.array(file.starts + row["base"]), pa.array(ends - file.starts), pa.array(sums, pa.int64())],
                    names=["id", "start", "n_tokens", "ids_crc32"],
                )

    return based.select("path", "base").repartition(tasks, "path").mapInArrow(scan, "id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the documents to token files in the shared folder and returns what reading them gives."""
    tmp = Scratch(docs.sparkSession, "token-files")
    manifest = tmp.save(write_token_files(docs, tmp.folder("files"), tokenizer_path, end_id, id_col, text_col), "manifest")
    return read_token_files(manifest).withColumnRenamed("id", id_col)
