"""Best-fit packing by large-item matching.

Documents longer than a sequence are cut; their full pieces are sequences of their own. Of the other pieces, those above a
third of the capacity fit at most twice into a sequence: from the largest down, each is matched with the largest that
still fits beside it. Smaller pieces then fill the remaining gaps by best fit, in descending order, and what is left
over opens sequences of its own.

At scale: which lengths share a sequence depends on the counts of each length only. So the plan is made from a
histogram of at most ``capacity`` rows, whatever the corpus; its patterns come with multiplicities. A piece finds its
place by its length and its rank among pieces of that length. Ranks come from one range-partitioned sort of
(length, id, piece), with counts per partition and length, so no length is ever gathered in one task. Both tables of
places are broadcast; they have a row for each length and partition at most.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.shared import Scratch, lean

CAPACITY = 1024
SLICE_BYTES = 500_000
BATCH_PIECES = 1000


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit)."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path)
        for batch in batches:
            for at, n in tokens.bounded(batch.column(1), SLICE_BYTES):
                found, bounds = encoder.encode(batch.column(1).slice(at, n))
                flat = np.insert(found, bounds[1:], end_id).astype("<u4")
                sizes = np.diff(bounds) + 1
                first = np.cumsum(sizes) - sizes
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = sizes - (count - 1) * capacity  # the first piece may be shorter
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                begin = first[doc] + start  # pieces follow each other without gaps, so one buffer holds the ids of all
                owner = batch.column(0).slice(at, n).take(pa.array(doc))
                for low in range(0, len(doc), BATCH_PIECES):
                    rows = slice(low, min(len(doc), low + BATCH_PIECES))
                    base = begin[rows.start]
                    own = flat[base : begin[rows.stop - 1] + length[rows.stop - 1]]
                    raw, places = memoryview(own).cast("B"), 4 * np.append(begin[rows] - base, len(own))
                    sums = [zlib.crc32(raw[b:e]) for b, e in zip(places.tolist(), places[1:].tolist(), strict=False)]
                    columns = [owner.slice(low, len(sums)), pa.array(piece[rows], pa.int32()), pa.array(start[rows], pa.int64()), pa.array(length[rows], pa.int64()), pa.array(sums, pa.int64())]
                    ids = [pa.Array.from_buffers(pa.binary(), len(sums), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(own)])] if with_ids else []
                    yield pa.RecordBatch.from_arrays([*columns, *ids], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long{', ids binary' * with_ids}")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, in order) and how many sequences have each."""
    left = {n: c for n, c in histogram.items() if c > 0}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("a length is outside 1 to the capacity")
    larges = sorted(n for n in left if 3 * n > capacity)
    bins: dict[int, list[list]] = {}  # by gap
    gaps: list[int] = []

    def put(pattern: list[int], count: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in bins:
            bins[gap] = []
            insort(gaps, gap)
        bins[gap].append([pattern, count])

    def take(gap: int, count: int) -> tuple[list[int], int]:
        """A pattern with this gap, count times at most; how many it gave is put in its place."""
        entry = bins[gap][-1]
        n = min(count, entry[1])
        entry[1] -= n
        if not entry[1]:
            bins[gap].pop()
            if not bins[gap]:
                del bins[gap]
                gaps.pop(bisect_left(gaps, gap))
        return entry[0], n

    while larges:
        a = larges[-1]
        fits = bisect_left(larges, capacity - a + 1)
        if not fits:
            put([a], left[a])
            larges.pop()
            continue
        b = larges[fits - 1]
        if a == b:
            if left[a] >= 2:
                put([a, a], left[a] // 2)
            left[a] %= 2
            if left[a]:  # the last of its length: with the next smaller, if any
                smaller = larges[fits - 2] if fits >= 2 else None
                put([a] if smaller is None else [a, smaller], 1)
                if smaller is not None:
                    left[smaller] -= 1
                    if not left[smaller]:
                        larges.remove(smaller)
            larges.remove(a)
            continue
        n = min(left[a], left[b])
        put([a, b], n)
        for x in (a, b):
            left[x] -= n
            if not left[x]:
                larges.remove(x)

    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        count = left[n]
        while count:
            at = bisect_left(gaps, n)
            gap = gaps[at] if at < len(gaps) else None
            each = (capacity if gap is None else gap) // n
            whole = count // each
            if gap is None:
                if whole:
                    put([n] * each, whole)
                if count % each:
                    put([n] * (count % each), 1)
                count = 0
            elif whole:
                pattern, used = take(gap, whole)
                put(pattern + [n] * each, used)
                count -= used * each
            else:
                pattern, _ = take(gap, 1)
                put(pattern + [n] * count, 1)
                count = 0
    return [(pattern, count) for gap in gaps for pattern, count in bins[gap]]


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", order_by: tuple[str, ...] = ("id", "piece")) -> DataFrame:
    """The pieces with sequence_id and offset (place there, without gaps from 0). Rows are kept as they are; repeated ones
    are packed each. An empty table gives an empty result."""
    tmp = Scratch(pieces.sparkSession, "packing")
    ordered = pieces.repartitionByRange(length_col, *order_by).sortWithinPartitions(length_col, *order_by)
    ordered = tmp.save(ordered.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    # a partition holds a range of lengths, so there are at most capacity + partitions of these rows
    parts = ordered.groupBy(F.col(length_col).alias("length"), F.shiftright("_at", 33).alias("partition")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("n"))
    parts = parts.orderBy("length", "partition").collect()
    histogram: dict[int, int] = {}
    runs = []  # (length, first place in the sort, rank of that place among the length)
    for row in parts:
        runs.append((row["length"], row["first"], histogram.get(row["length"], 0)))
        histogram[row["length"]] = runs[-1][2] + row["n"]

    slots: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    given, sequence = dict.fromkeys(histogram, 0), 0
    for pattern, count in plan(histogram, capacity):
        offset = 0
        for n in pattern:
            slots.append((n, given[n], sequence, offset))
            given[n] += count
            offset += n
        sequence += count
    spark = pieces.sparkSession
    # a row for each length and partition, and one for each length: capacity + partitions, and capacity rows at most
    ranks = spark.createDataFrame([(n, first >> 33, first, rank) for n, first, rank in runs], "_length long, _partition long, _first long, _rank long")
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for n, rank, number, offset in sorted(slots):
        by_length.setdefault(n, []).append((rank, number, offset))
    places = spark.createDataFrame(list(by_length.items()), "_slot_length long, _slots array<struct<rank:long,number:long,offset:long>>")
    own = [F.col(f"`{c}`") for c in pieces.columns]
    placed = ordered.join(F.broadcast(ranks), (F.col(length_col) == F.col("_length")) & (F.shiftright("_at", 33) == F.col("_partition")))
    placed = placed.join(F.broadcast(places), F.col(length_col) == F.col("_slot_length"))
    rank = F.col("_rank") + F.col("_at") - F.col("_first")
    placed = placed.select(*own, rank.alias("_mine"), F.element_at(F.filter("_slots", lambda s: s.rank <= rank), -1).alias("_slot"))
    return placed.select(*own, (F.col("_slot.number") + F.col("_mine") - F.col("_slot.rank")).alias("sequence_id"), F.col("_slot.offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for).

    Null and empty texts have the end id only. Null ids and repeated rows are packed like others. A document with more
    tokens than the capacity is cut; its first piece may be shorter than the rest. An empty table gives an empty result.
    """
    tmp = Scratch(docs.sparkSession, "pieces")
    pieces = pieces_of(docs, tokenizer_path, end_id, capacity, id_col, text_col, with_ids).withColumn("_row", F.monotonically_increasing_id())
    pieces = tmp.save(pieces, "pieces")
    placed = pack(pieces.drop("ids"), capacity)
    if with_ids:  # ids are moved once, to their places, and not sorted
        places = tmp.save(placed.select("_row", "sequence_id", "offset"), "places")
        placed = pieces.join(places, "_row")
    columns = ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return placed.select(*columns).withColumnRenamed("id", id_col)
