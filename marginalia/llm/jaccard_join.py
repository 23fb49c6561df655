"""N-gram Jaccard join on prefix trees.

A document's set is its distinct word shingles as 64-bit hashes, in one global order: rare ones first, those that Spark
counts as frequent last. Two sets with a Jaccard similarity of the threshold share one of their first elements (as many as
the threshold leaves room for), so each set goes to the buckets of those only. The sets that meet at an element are a
group. Of the pairs in a group those may link whose sizes are near enough and whose parity bitmaps, which bound from below by
how much two sets differ, don't rule it out; a group gives as many of these as connect what all of them connect, so never
more pairs than it has sets. Where more than ``PAIRED`` sets meet, those of compatible sizes are chained. Connected candidates are
clusters, and every link is inside one cluster.
The whole sets of a cluster are then stored in a trie. A set walks it once: sets that begin alike share the overlap
counted so far, and a subtree is left as soon as what remains of either side can't make up the overlap that is missing.

Equal sets are one node throughout. Clusters beyond ``UNIT_SETS`` are first split around a pivot: sets linked with it
are one component; of the others, only those within twice the distance can link with one of them, and by the triangle
inequality only with those that are far enough from the pivot. A split that leaves most of the pairs isn't made: what no pivot
splits is compared block by block.

The order is made in two steps: elements that tasks see often, then those at which many prefixes of that order meet.
A merely common phrase so leaves the prefixes, and what still meets in numbers are groups of copies.

At scale: texts are read three times and shuffled only for sets in clusters; shuffles carry numbers. A frequent passage
comes last in the order, so it fills no bucket. A task that has many sets at one element chains those of about one size and
passes on one of them, so that an element of a third of all documents doesn't fill its bucket either. None emits the pairs of a
group, and the list of frequent elements is bounded (it only decides the order, so results don't depend on it). A cluster that
no pivot splits is compared in blocks, which is quadratic in its sets' number; the texts of one are alike in size and in
a rare shingle, but mutually unlike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.components import components
from marginalia.llm.shared import Scratch, lean

WORDS = 5
PERCENT = 80
FREQUENT = 8
FREQUENT_ENTRIES = 1 << 20
BUCKET_ENTRIES = 500_000
TEXT_BYTES = 500_000
PAIRED = 64
CROWDED = 16
SIZE_CLASS = 1.25**0.25
HELD_KEYS = 1_000_000
SKETCH_BITS = 1 << 15
FILTER_BITS = 1 << 23
UNIT_SETS = 192
PIVOT_ROUNDS = 4

_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NAMES = np.random.default_rng(7).integers(1 << 63, size=256, dtype=np.uint64) | 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = np.random.default_rng(8).integers(1 << 63, size=64, dtype=np.uint64) | 1
_HOT = np.uint64(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its shingles. Words are runs of bytes other than ASCII white space, A-Z in lower case.
    A text with fewer words is one shingle; without words it has none."""
    raw = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join(raw), dtype=np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
    white = _WHITE[data]
    starts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])[: len(data)])
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in raw]
    number = np.cumsum(~white & np.concatenate([[True], white[:-1]])) - 1
    place = np.arange(len(data)) - starts[np.maximum(number, 0)]
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
    values = np.where(white, np.uint64(0), _NAMES[data] * powers[np.maximum(place, 0)])
    word = _mixed(np.add.reduceat(values, starts))
    first = np.concatenate([[0], np.searchsorted(starts, ends)])
    out = []
    whole = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for k in range(words):
        whole += word[k : len(word) - words + 1 + k] * _FACTORS[k]
    whole = _mixed(whole)
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            out.append(_mixed(np.array([(word[a:b] * _FACTORS[words + 1 : words + 1 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def ordered(found: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: hashes as 63-bit numbers, frequent ones after all others, by how frequent they are."""
    key = found >> np.uint64(1)
    if len(hot) and len(found):
        at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
        key = np.where(hot[at] == key, _HOT | (rank[at].astype(np.uint64) << np.uint64(57)) | (key >> np.uint64(6)), key)
    return np.sort(key)


def prefix_length(n: int, percent: int) -> int:
    """Elements of which one at least is shared with any set that links."""
    return n - -(-n * percent // 100) + 1 if n else 0


def linked(shared: int, a: int, b: int, percent: int) -> bool:
    return 100 * shared >= percent * (a + b - shared)


def sketch(x: np.ndarray) -> bytes:
    """A bit for each of so many classes of elements (about as many as the set has): whether the set has an odd number of them."""
    bits = min(SKETCH_BITS, 1 << max(6, (len(x) - 1).bit_length()))
    return np.packbits((np.bincount((x & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False only if sets of n and m elements with these sketches differ in too many elements to link."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    while len(y) > len(x):  # a class of the coarser sketch is the sum of two
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= n + m - 2 * -(-percent * (n + m) // (100 + percent))


class _Node:
    __slots__ = ("children", "ends", "high", "low", "segment")

    def __init__(self, segment: np.ndarray):
        self.segment, self.children, self.ends, self.low, self.high = segment, {}, [], 1 << 62, 0


class Trie:
    """Ordered sets. ``walk(x)`` gives those that link with x."""

    STEP = 96

    def __init__(self, percent: int):
        self.percent, self.root, self.sizes = percent, _Node(np.zeros(0, np.uint64)), {}

    def add(self, x: np.ndarray, name) -> None:
        node, at = self.root, 0
        self.sizes[name] = len(x)
        while True:
            node.low, node.high = min(node.low, len(x)), max(node.high, len(x))
            if at == len(x):
                node.ends.append(name)
                return
            child = node.children.get(int(x[at]))
            if child is None:
                child = node.children[int(x[at])] = _Node(x[at:])
                child.low = child.high = len(x)
                child.ends.append(name)
                return
            n = min(len(child.segment), len(x) - at)
            differ = np.flatnonzero(child.segment[:n] != x[at : at + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(child.segment):
                upper = _Node(child.segment[:same])
                upper.low, upper.high = child.low, child.high
                child.segment = child.segment[same:]
                upper.children[int(child.segment[0])] = child
                node.children[int(x[at])] = upper
                child = upper
            node, at = child, at + same

    def walk(self, x: np.ndarray, skip=lambda name: False) -> Iterator:
        n, percent = len(x), self.percent
        stack = [(c, 0, 0, 0) for c in self.root.children.values()]
        while stack:
            node, shared, at, depth = stack.pop()
            if 100 * node.high < percent * n or percent * node.low > 100 * n:
                continue
            if not node.children and all(map(skip, node.ends)):
                continue
            # the smallest overlap that links with a set of this subtree
            least = -(-percent * (n + max(node.low, -(-percent * n // 100))) // (100 + percent))
            segment, left = node.segment, False
            for k in range(0, len(segment), self.STEP):
                part = segment[k : k + self.STEP]
                found = np.searchsorted(x[at:], part)
                inside = found < n - at
                shared += int((x[at + found[inside]] == part[inside]).sum())
                at += int(np.searchsorted(x[at:], part[-1], side="right"))
                if shared + min(n - at, node.high - depth - k - len(part)) < least:
                    left = True
                    break
            if left:
                continue
            depth += len(segment)
            for name in node.ends:
                if linked(shared, n, self.sizes[name], percent):
                    yield name
            stack += [(c, shared, at, depth) for c in node.children.values()]


def unit_links(names: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the sets as all their links would (a forest)."""
    parent = {n: n for n in names}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    trie, out = Trie(percent), []
    for k in sorted(range(len(names)), key=lambda k: (len(sets[k]), names[k])):
        name, x = names[k], sets[k]
        for other in trie.walk(x, lambda y, name=name: find(y) == find(name)):
            if find(other) != find(name):
                out.append((name, other))
                parent[find(name)] = find(other)
        trie.add(x, name)
    return out


def _frequent(rows: DataFrame, tmp: Scratch, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent elements, by hash, and how frequent they are as a power of two."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            found, times = np.unique(np.concatenate(held) >> np.uint64(1), return_counts=True)
            often = times >= 3
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(times[often].astype(np.int64))], names=["h", "c"])

        for batch in batches:
            for start, n in tokens.bounded(batch.column(0), TEXT_BYTES):
                own = shingle_sets(pc.fill_null(batch.column(0).slice(start, n), "").to_pylist(), words)
                held += own
                size += sum(map(len, own))
                if size > HELD_KEYS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    counts = rows.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= FREQUENT)
    return _ranked([tmp.save(counts, "frequent")])


def _ranked(counts: list[DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Elements (63-bit) in order, and how frequent they are as a power of two; of each table FREQUENT_ENTRIES at most."""
    tops = [c.orderBy(F.desc("c"), "h").limit(FREQUENT_ENTRIES).toArrow() for c in counts]
    found = np.concatenate([np.asarray(t["h"], dtype=np.int64).view(np.uint64) for t in tops])
    often = np.concatenate([np.asarray(t["c"], dtype=np.int64) for t in tops])
    at = np.lexsort((-often, found))
    found, often = found[at], often[at]
    first = np.concatenate([[True], found[1:] != found[:-1]]) if len(found) else np.zeros(0, bool)
    return found[first], np.minimum(np.log2(np.maximum(often[first], 1)), 63).astype(np.uint8)


def _crowded(rows: DataFrame, tmp: Scratch, words: int, percent: int, order) -> DataFrame:
    """h, c: the elements not yet known as frequent at which more than CROWDED prefixes meet, and how many do."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(8, int(np.ceil(np.log2(max(1, size / 30 / BUCKET_ENTRIES)))))  # about a prefix element for 30 bytes

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            keys, times = np.unique(np.concatenate(held), return_counts=True)
            bucket = _mixed(keys) >> np.uint64(64 - bits)
            at = np.argsort(bucket, kind="stable")
            return _dealt(bucket[at], {"keys": keys[at], "times": times[at].astype(np.int32)})

        for batch in batches:
            for start, n in tokens.bounded(batch.column(0), TEXT_BYTES):
                sets = [ordered(x, *order.value) for x in shingle_sets(pc.fill_null(batch.column(0).slice(start, n), "").to_pylist(), words)]
                keys = np.concatenate([x[: prefix_length(len(x), percent)] for x in sets])
                held.append(keys[keys < _HOT])
                size += len(held[-1])
                if size > HELD_KEYS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches, 1):
            found, at = np.unique(_values(own, "keys", np.uint64), return_inverse=True)
            times = np.bincount(at, weights=_values(own, "times", np.int32)).astype(np.int64)
            many = times > CROWDED
            yield pa.RecordBatch.from_arrays([pa.array(found[many].view(np.int64)), pa.array(times[many])], names=["h", "c"])

    dealt = rows.select("text").mapInArrow(deal, "bucket long, keys binary, times binary")
    return tmp.save(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "h long, c long"), "crowded")


def _dealt(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """A row for each bucket (they are in order) with its part of each column, as bytes."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.zeros(1, np.int64)
    parts = [pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))]) for x in columns.values()]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), *parts], names=["bucket", *columns])


def _grouped(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal first columns (long or int), as slices of the batches."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(by)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            mine = tuple(keys[a].tolist())
            if held and mine != key:
                yield key, held
                held = []
            key = mine
            held.append(batch.slice(a, b - a))
    if held:
        yield key, held


def _values(own: list[pa.RecordBatch], column: str, kind) -> np.ndarray:
    """The numbers that a column of bytes holds."""
    parts = []
    for batch in own:
        c = batch.column(column)
        places = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
        parts.append(np.frombuffer(memoryview(c.buffers()[2] or b"")[places[0] : places[-1]], kind))
    return np.concatenate(parts)


def _thinned(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by key. Where more than PAIRED have a key, one of each class of sizes stays for it, with its size negative, and is
    chained with the others of its class: the entries, and the chained pairs."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(keys)))
    hot = np.repeat(times > PAIRED, times)
    if not hot.any():
        return keys, names, sizes, np.zeros((0, 2), np.int64)
    at = np.flatnonzero(hot)
    level = np.floor(np.log(sizes[at]) / np.log(SIZE_CLASS)).astype(np.int64)
    order = np.lexsort((names[at], sizes[at], level, keys[at]))
    at, level = at[order], level[order]
    new = np.concatenate([[True], (keys[at][1:] != keys[at][:-1]) | (level[1:] != level[:-1])])
    first = at[new][np.cumsum(new) - 1]
    chained = np.unique(np.stack([names[first], names[at]], axis=1)[~new], axis=0)
    stay = np.concatenate([np.flatnonzero(~hot), at[new]])
    sizes = sizes.copy()
    sizes[at[new]] *= -1
    stay = stay[np.argsort(keys[stay], kind="stable")]
    return keys[stay], names[stay], sizes[stay], chained[chained[:, 0] != chained[:, 1]]


def _meeting(keys: np.ndarray, names: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[set[bytes], np.ndarray]:
    """Groups of at most PAIRED names that meet at an element and whose sizes may link; chained pairs of names where more meet."""
    at = np.argsort(keys, kind="stable")
    k = keys[at]
    same = k[1:] == k[:-1]
    at = at[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(at) else at
    size = np.abs(sizes).astype(np.int64)
    at = at[np.lexsort((names[at], size[at], keys[at]))]
    k, n = keys[at], names[at]
    at = at[np.concatenate([[True], (k[1:] != k[:-1]) | (n[1:] != n[:-1])])] if len(at) else at
    k, n, size, rep = keys[at], names[at], size[at], sizes[at] < 0
    if len(at) < 2:
        return set(), np.zeros((0, 2), np.int64)
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    times = np.diff(np.append(first, len(k)))
    chain = np.repeat((times > PAIRED) | np.logical_or.reduceat(rep, first), times)
    same = k[1:] == k[:-1]
    near = 100 * size[:-1] * np.where(chain[1:], SIZE_CLASS, 1.0) >= percent * size[1:]
    links = np.flatnonzero(same & near & chain[1:])
    pairs = np.unique(np.stack([n[links], n[links + 1]], axis=1), axis=0)
    cuts = [0, *(np.flatnonzero(~(same & near)) + 1).tolist(), len(k)]
    plain = ~chain
    groups = {np.sort(n[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 and plain[a]}
    return groups, pairs


def forest(names: list[int], sizes: list[int], sketches: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Of the pairs that may link as many as connect what all of them connect."""
    width = min(map(len, sketches))
    folded = []
    for s in sketches:
        x = np.frombuffer(s, np.uint64)
        while len(x) > width // 8:  # a class of the coarser sketch is the sum of two
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        folded.append(x)
    x, n = np.stack(folded), np.array(sizes, np.int64)
    out, label = [], list(range(len(names)))
    for i in range(len(names) - 1):
        both = n[i] + n[i + 1 :]
        good = np.bitwise_count(x[i] ^ x[i + 1 :]).sum(axis=1) <= both - 2 * -(-percent * both // (100 + percent))
        for j in (np.flatnonzero(good) + i + 1).tolist():
            if label[i] != label[j] and may_link(sketches[i], sketches[j], sizes[i], sizes[j], percent):
                out.append((names[i], names[j]))
                old, new = label[j], label[i]
                label = [new if v == old else v for v in label]
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable by links, its own included).

    Two documents link if 100 * intersection >= percent * union of their sets. Null and empty texts, and those of white
    space, have no shingles and link with nothing; their component is their own id. Rows with equal sets are linked. Null ids are never the
    smallest unless all of a component are null. Repeated rows are returned each; other columns are ignored; an empty table
    gives an empty result. Elements are compared by 63-bit hashes, frequent ones by 57 bits, equal sets by 64 bits. A word's hash is a polynomial
    modulo 2^64, which resists chance but not an author who constructs long words that collide.
    """
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("same"))
    known = spark.sparkContext.broadcast(_frequent(rows, tmp, words))  # FREQUENT_ENTRIES at most
    crowded = _crowded(rows, tmp, words, percent, known)
    order = spark.sparkContext.broadcast(_ranked([spark.read.parquet(tmp.folder("frequent")), crowded]))  # twice as many at most

    def sets_of(column: pa.Array, start: int, n: int) -> list[np.ndarray]:
        return [ordered(s, *order.value) for s in shingle_sets(pc.fill_null(column.slice(start, n), "").to_pylist(), words)]

    @lean
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for start, n in tokens.bounded(batch.column(1), TEXT_BYTES):
                sets = sets_of(batch.column(1), start, n)
                names = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
                prefixes, sketches = [], []
                for name, s in zip(names, sets, strict=True):
                    new = name not in seen and len(s) > 0
                    prefixes.append(s[: prefix_length(len(s), percent)].tobytes() if new else None)
                    sketches.append(sketch(s) if new else None)
                    if len(seen) < 500_000:  # repetitions beyond cost a little work, no more
                        seen.add(name)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, n), batch.column(2).slice(start, n), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(sketches, pa.binary())],
                    names=["id", "same", "n", "name", "prefix", "sketch"],
                )

    described = tmp.save(rows.mapInArrow(describe, f"id {kind}, same long, n long, name long, prefix binary, sketch binary"), "described")
    entries = (described.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0) // 8
    bits = max(8, int(np.ceil(np.log2(max(1, entries / BUCKET_ENTRIES)))))

    @lean
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column(2)), dtype=np.int64) // 8
            mixed = _mixed(_values([batch], "prefix", np.uint64))
            at = np.argsort(mixed, kind="stable")
            names, sizes = np.repeat(np.asarray(batch.column(0)), lengths)[at], np.repeat(np.asarray(batch.column(1)), lengths)[at]
            mixed, names, sizes, chained = _thinned(mixed[at], names, sizes)
            keys = (mixed << np.uint64(bits) >> np.uint64(32)).astype(np.uint32)  # elements that this makes equal are more candidates, no more
            yield _dealt(mixed >> np.uint64(64 - bits), {"keys": keys, "names": names, "sizes": sizes.astype(np.int32)})
            if len(chained):  # pairs that are known go as they are: buckets below 0
                a, b = (np.ascontiguousarray(chained[:, k]) for k in (0, 1))
                bucket = np.full(len(a), -1 - int(_mixed(b[:1].view(np.uint64))[0] >> np.uint64(64 - bits)))
                yield _dealt(bucket, {"keys": np.zeros(len(a), np.uint32), "names": a, "sizes": b})

    dealt = described.filter("prefix IS NOT NULL").select("name", "n", "prefix").mapInArrow(deal, "bucket long, keys binary, names binary, sizes binary")

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (bucket,), own in _grouped(batches, 1):
            if bucket < 0:
                groups, pairs = set(), np.stack([_values(own, "names", np.int64), _values(own, "sizes", np.int64)], axis=1)
            else:
                groups, pairs = _meeting(_values(own, "keys", np.uint32), _values(own, "names", np.int64), _values(own, "sizes", np.int32), percent)
            if groups:
                values = pa.ListArray.from_arrays(np.cumsum([0, *(len(g) // 8 for g in groups)], dtype=np.int32), pa.array(np.frombuffer(b"".join(groups), np.int64)))
                yield pa.RecordBatch.from_arrays([values, pa.nulls(len(groups), pa.int64()), pa.nulls(len(groups), pa.int64())], names=["names", "a", "b"])
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs), values_type), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["names", "a", "b"])

    values_type = pa.list_(pa.int64())
    met = tmp.save(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "names array<long>, a long, b long"), "met")
    sketches = tmp.save(described.filter("sketch IS NOT NULL").groupBy("name").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    groups = met.filter("names IS NOT NULL").select("names").distinct().select(F.xxhash64("names").alias("g"), F.explode("names").alias("name"))
    groups = groups.join(sketches, "name").select("g", "name", "n", "sketch")

    @lean
    def connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for _, own in _grouped(batches, 1):
            names, sizes, bits = ([x for batch in own for x in batch.column(c).to_pylist()] for c in ("name", "n", "sketch"))
            found += forest(names, sizes, bits, percent)
            if len(found) > 10_000:
                yield _pairs(found)
                found = []
        if found:
            yield _pairs(found)

    near = groups.repartition("g").sortWithinPartitions("g", "n", "name").mapInArrow(connect, "a long, b long")
    near = near.union(met.filter("a IS NOT NULL").select("a", "b"))
    clusters = tmp.save(components(near, tmp, "chains"), "clusters")

    names = tmp.save(described.select("id", "same", "n", "name"), "names")
    tmp.drop("described", "frequent", "crowded", "met", "sketches")
    first = names.filter("n > 0").groupBy("name").agg(F.min(F.struct("id", "same")).alias("first"))
    sizes = tmp.save(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("pivot")), "cluster-sizes")
    wanted = first.join(clusters.join(sizes, "root"), F.col("name") == F.col("node"))
    wanted = tmp.save(wanted.select("first.id", "first.same", "name", "root", "sets", "pivot"), "wanted")
    asked = _maybe(rows, wanted).join(wanted.withColumnsRenamed({"id": "_id", "same": "_same"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")))
    columns = ["root", "name", "sets", "pivot", "text"]

    @lean
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in tokens.bounded(batch.column(4), TEXT_BYTES):
                sets = sets_of(batch.column(4), start, n)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(start, n) for k in range(4)), pa.array([s.tobytes() for s in sets], pa.binary())], names=[*columns[:4], "elements"])

    members = tmp.save(asked.select(*columns).mapInArrow(collect, "root long, name long, sets long, pivot long, elements binary"), "members")
    links = _links(members, tmp, percent)
    reached = tmp.save(components(links, tmp, "links"), "reached")

    grouped = names.join(reached, F.col("name") == F.col("node"), "left").select("id", "n", F.coalesce("root", "name").alias("name"))
    grouped = tmp.save(grouped, "grouped")
    least = tmp.save(grouped.filter("n > 0").groupBy("name").agg(F.min("id").alias("component_id")), "least")
    out = grouped.join(least, "name", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    tmp.drop("wanted", "clusters", "cluster-sizes", "names")
    return out


def _maybe(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose text's hash may be a wanted one: a bitmap of at most FILTER_BITS spares the others the shuffle."""
    bits = min(FILTER_BITS, 1 << max(10, int(np.ceil(np.log2(16 * max(1, wanted.count()))))))
    place = F.pmod(F.col("same"), F.lit(bits))
    words = wanted.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(same, {bits}) % 64 as int))")).alias("set")).toArrow()
    bitmap = np.zeros(bits // 64, np.int64)
    bitmap[np.asarray(words["word"], dtype=np.int64)] = np.asarray(words["set"], dtype=np.int64)
    held = rows.sparkSession.sparkContext.broadcast(bitmap)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("same")) % bits
            yield batch.filter(pa.array(held.value[at >> 6] >> (at & 63) & 1 == 1))

    return rows.mapInArrow(keep, schema)


def _links(members: DataFrame, tmp: Scratch, percent: int) -> DataFrame:
    """Links that connect each cluster's sets (root, name, sets, pivot, elements) as all its links would."""
    found: list[DataFrame] = []
    whole = members.withColumn("stuck", F.lit(False))
    for k in range(PIVOT_ROUNDS + 1):
        last = k == PIVOT_ROUNDS
        if k:
            sizes = tmp.save(whole.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.min("name").alias("pivot")), f"sizes-{k}")
            whole = whole.join(sizes, "root")
        small = F.col("sets") <= UNIT_SETS
        units = whole.filter(F.col("sets") > 1 if last else (F.col("sets") > 1) & (small | F.col("stuck")))
        blocks = F.when(small, 1).otherwise(F.ceil(F.col("sets") * 2 / F.lit(UNIT_SETS))).cast("int")
        units = units.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int"))
        units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = units.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "name", "elements")
        found.append(tmp.save(_in_units(units, percent), f"unit-links-{k}"))
        if last:
            break
        large = whole.filter(~small & ~F.col("stuck"))
        if large.isEmpty():
            break
        pivots = large.filter(F.col("name") == F.col("pivot")).dropDuplicates(["root"]).select("root", F.col("elements").alias("center"))
        pivots = tmp.save(pivots, f"pivots-{k}")
        measured = tmp.save(_measured(large.select("root", "name", "elements", "pivot").join(pivots, "root"), percent), f"measured-{k}")
        found.append(tmp.save(measured.filter("link AND name <> pivot").select(F.col("name").alias("a"), F.col("pivot").alias("b")), f"pivot-links-{k}"))
        # what isn't linked with the pivot can link with something linked with it only within twice the distance
        reach = 2 * (1 - percent / 100) + 1e-9
        between = measured.filter(~F.col("link") & (F.col("distance") <= reach)).groupBy("root").agg(F.min("distance").alias("nearest"))
        between = tmp.save(between, f"between-{k}")
        # of those on this side, the links among the linked are known; the pivot's own component holds them together
        inside = (F.col("distance") <= reach) & (~F.col("link") | (F.col("distance") >= F.col("nearest") - (1 - percent / 100) - 1e-9))
        inside = F.coalesce(inside, F.lit(False))
        # a cluster whose parts have together more than three quarters of its pairs stays whole, and is compared block by block in the next round
        squares = F.pow(F.count_if(~F.col("link")), F.lit(2)) + F.pow(F.count_if(inside), F.lit(2))
        pays = measured.join(between, "root", "left").groupBy("root").agg(F.first("nearest").alias("nearest"), (squares <= F.pow(F.count(F.lit(1)), F.lit(2)) * 0.75).alias("pays"))
        parted = measured.join(tmp.save(pays, f"pays-{k}"), "root")
        part = lambda rows, number, stuck: rows.select(number.alias("root"), "name", "elements", F.lit(stuck).alias("stuck"))
        rest = part(parted.filter("pays AND NOT link"), F.xxhash64("root", F.lit(0)), False)
        side = part(parted.filter(F.col("pays") & inside), F.xxhash64("root", F.lit(1)), False)
        whole_ones = part(parted.filter("NOT pays"), F.col("root"), True)
        whole = tmp.save(rest.unionByName(side).unionByName(whole_ones), f"pool-{k + 1}")
        tmp.drop(f"measured-{k}", f"pivots-{k}", f"pool-{k}" if k else "members")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _in_units(units: DataFrame, percent: int) -> DataFrame:
    @lean
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _grouped(batches, 3):
            names = [x for batch in own for x in batch.column("name").to_pylist()]
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for batch in own for x in batch.column("elements")]
            out = unit_links(names, sets, percent)
            if out:
                yield _pairs(out)

    return units.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(link, "a long, b long")


def _measured(pairs: DataFrame, percent: int) -> DataFrame:
    """Each set's distance from its cluster's pivot."""

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance, link = [], []
            for mine, center in zip(batch.column("elements").to_pylist(), batch.column("center").to_pylist(), strict=True):
                x, y = np.frombuffer(mine, dtype=np.uint64), np.frombuffer(center, dtype=np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                distance.append(1 - shared / (len(x) + len(y) - shared))
                link.append(linked(shared, len(x), len(y), percent))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "name", "elements", "pivot")), pa.array(distance, pa.float64()), pa.array(link)], names=["root", "name", "elements", "pivot", "distance", "link"])

    return pairs.mapInArrow(measure, "root long, name long, elements binary, pivot long, distance double, link boolean")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents without those that are linked, directly or over others, with one of a smaller id. Null ids stay."""
    found = jaccard_components(docs, id_col, text_col, words, percent)
    tmp = Scratch(docs.sparkSession, "jaccard-dropped")
    dropped = tmp.save(found.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct(), "dropped")
    return docs.join(dropped, id_col, "left_anti").select(*docs.columns)
