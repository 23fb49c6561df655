"""Runs: maximal periodic stretches of a text's words, by Baier grouping.

Phase one of Baier's suffix sorter groups suffixes by their longest Lyndon prefix: groups are taken from the greatest
down, and each suffix of a group lengthens the prefix of the nearest suffix to its left that no greater or equal group
has. Those prefixes are the Lyndon array, without a suffix array. It is taken under an order of words and under its
reverse; every run holds a Lyndon root that is one of these prefixes, and the root is extended to both sides by the longest common
extension. A run of at least ``least`` words has two stretches of ``least / 2`` equal words, so suffixes are sorted only in
the places of a text that such stretches cover, which loses no run.

At scale: documents are independent, so there is one pass and no shuffle; the work is linear in a text's words (sorting of
stretches aside), and memory is that of one text and a slice of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.shared import lean

LEAST_WORDS = 12
RUN = "struct<start:long,length:long,period:long>"
_SLICE_CHARS = 1_000_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lyndon_array(codes: list[int]) -> list[int]:
    """The length of the longest Lyndon word that begins at each place: phase one of Baier's sorter, in linear time but for the first grouping.

    A group is a list of places with one common prefix. Moved places leave stale entries behind, which ``of`` tells apart.
    """
    n = len(codes)
    if not n:
        return []
    members: list[list[int]] = []
    of, seen = [0] * n, {}
    for c in sorted(set(codes)):
        seen[c] = len(members)
        members.append([])
    for i, c in enumerate(codes):
        g = of[i] = seen[c]
        members[g].append(i)
    size = [len(m) for m in members]
    length = [1] * len(members)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members) + 1))
    above[-1] = -1
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    group = len(members) - 1
    while group >= 0:
        grown = length[group]
        times: dict[int, int] = {}
        for i in members[group]:
            if of[i] != group:
                continue
            out[i] = grown
            before, after = left[i], right[i]
            if before >= 0:
                right[before] = after
                times[before] = times.get(before, 0) + 1
            if after < n:
                left[after] = before
        if len(times) == 1:
            ((j, k),) = times.items()
            if size[of[j]] == 1:  # alone in its group: the group itself grows
                length[of[j]] += k * grown
                group = below[group]
                continue
        by_times: dict[int, list[int]] = {}
        for j, k in times.items():
            by_times.setdefault(k, []).append(j)
        for k in sorted(by_times, reverse=True):  # more repetitions of a greater prefix are greater
            fresh: dict[int, int] = {}
            for j in by_times[k]:
                old = of[j]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    size.append(0)
                    length.append(length[old] + k * grown)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                of[j] = new
                members[new].append(j)
                size[new] += 1
                size[old] -= 1
        members[group] = []
        group = below[group]
    return out


def _common(data: bytes, a: int, b: int, most: int, step: int) -> int:
    """How many 4-byte codes from a on and from b on are equal, forwards (step 1) or backwards (step -1), ``most`` at most: doubling, then halving, over equal bytes."""

    def equal(done: int, more: int) -> bool:
        if step > 0:
            return data[4 * (a + done) : 4 * (a + done + more)] == data[4 * (b + done) : 4 * (b + done + more)]
        return data[4 * (a - done - more + 1) : 4 * (a - done + 1)] == data[4 * (b - done - more + 1) : 4 * (b - done + 1)]

    done, more = 0, 1
    while done < most and equal(done, min(more, most - done)):
        done += min(more, most - done)
        more *= 2
    while more > 1 and done < most:
        more //= 2
        if more <= most - done and equal(done, more):
            done += more
    return done


def _runs_of(codes: np.ndarray, least: int) -> set[tuple[int, int, int]]:
    """(start, length, period) of all runs with at least ``least`` codes."""
    n, data, found = len(codes), codes.tobytes(), set()
    for order in (codes, codes.max() - codes):
        period = np.asarray(lyndon_array(order.tolist()), dtype=np.int64)
        at = np.flatnonzero(np.arange(n) + period <= n)
        q = period[at]
        end = at + q
        onward = (end < n) & (codes[np.minimum(end, n - 1)] == codes[at])
        backward = (at > 0) & (codes[at - 1] == codes[end - 1])
        keep = onward | backward
        known: dict[int, int] = {}  # where the last run of a period ends
        for i, p in zip(at[keep].tolist(), q[keep].tolist(), strict=True):
            if i + p <= known.get(p, 0):  # a root inside that run belongs to it
                continue
            to_right = _common(data, i, i + p, n - i - p, 1)
            to_left = _common(data, i - 1, i + p - 1, i, -1)
            long = to_left + p + to_right
            if to_left + to_right >= p:
                known[p] = i + p + to_right
                if long >= least:
                    found.add((i - to_left, long, p))
    return found


def _repeated(codes: np.ndarray, width: int) -> np.ndarray:
    """Places that a stretch of ``width`` codes covers that occurs again. Equal stretches have equal hashes, so none is missed."""
    n = len(codes) - width + 1
    covered = np.zeros(len(codes) + 1, dtype=np.int64)
    if n < 2:
        return covered[:-1] > 0
    sums, wide = np.zeros(n, dtype=np.uint64), codes.astype(np.uint64) + np.uint64(1)
    for k in range(width):
        sums = (sums ^ (sums >> np.uint64(29))) * _ODD + wide[k : k + n]
    order = np.argsort(sums, kind="stable")
    same = sums[order[1:]] == sums[order[:-1]]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    places = np.flatnonzero(again)
    np.add.at(covered, places, 1)
    np.add.at(covered, places + width, -1)
    return np.cumsum(covered)[:-1] > 0


def runs_of_words(words: list, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` words, by start, then period."""
    if len(words) < least:
        return []
    seen: dict = {}
    codes = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))
    if len(seen) == len(words):
        return []
    # half of a run is at least half of ``least``: its first and its last words occur in it twice, and stretches of them cover it
    flags = np.diff(np.concatenate([[0], _repeated(codes, max(1, least // 2)).view(np.int8), [0]]))
    found = set()
    for start, end in zip(np.flatnonzero(flags == 1).tolist(), np.flatnonzero(flags == -1).tolist(), strict=True):
        if end - start >= least:
            found |= {(start + s, long, p) for s, long, p in _runs_of(codes[start:end], least)}
    return sorted(found, key=lambda r: (r[0], r[2]))


def _kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, long, p in runs:
        change[start + p] += 1
        change[start + long] -= 1
    return np.cumsum(change)[:-1] == 0


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Per row: id, n_words, runs (array of start, length, period in words, by start, then period), collapsed (the words that no run repeats, joined by one space).

    Words are runs of characters other than the six ASCII blanks. Null and empty texts have no words, no runs and an empty collapsed
    text. Repeated rows and null ids are returned as they are; other columns are ignored; an empty table gives an empty result.
    The length of a text isn't limited. ``least`` is two at least.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    @lean
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in tokens.bounded(batch.column(1), _SLICE_CHARS):
                sizes, runs, texts = [], [], []
                for text in batch.column(1).slice(start, n):
                    words = (text.as_py() or "").encode().split()  # of bytes: at ASCII blanks only
                    own = runs_of_words(words, least)
                    if own:
                        texts.append(b" ".join([words[i] for i in np.flatnonzero(_kept(len(words), own))]).decode())
                    else:
                        texts.append(b" ".join(words).decode())
                    sizes.append(len(words))
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                columns = [batch.column(0).slice(start, n), pa.array(sizes, pa.int64()), pa.array(runs, run_type), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(search, f"id {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("id", id_col)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows' ids and texts; with h the unsigned CRC-32 of the decimal id and g = h div 10, in texts with h mod 10 = 0 the words from a = g mod n on repeat the p = 1 + (n - a) div (3 + g mod 8) words there.

    A null id has no h: its text stays. Texts without words stay.
    """
    h = F.crc32(F.col(id_col).cast("string"))
    blanks = r"[\x20\x09-\x0D]+"
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.floor(h / 10).alias("_g"), F.coalesce(h % 10 == 0, F.lit(False)).alias("_hit"))
    words = F.when(F.col("_hit"), F.filter(F.split("_text", blanks), lambda w: w != ""))
    rows = rows.withColumn("_words", words).withColumn("_n", F.size("_words"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")))
    rest = F.col("_n") - F.col("_a")
    rows = rows.withColumn("_p", (1 + F.floor(rest / (3 + F.col("_g") % 8))).cast("int"))
    turns = F.ceil(rest / F.col("_p")).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("_words", F.col("_a") + 1, F.col("_p")), turns)), F.lit(1), rest)
    changed = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), tail), " ")
    return rows.select(F.col("_id").alias(id_col), F.when(F.col("_hit") & (F.col("_n") > 0), changed).otherwise(F.col("_text")).alias(text_col))


def _longest() -> Column:
    """The run of greatest length; of several the first, then the one of the smallest period. Null if there is none."""
    rank = F.transform("runs", lambda r: F.struct((-r.length).alias("l"), r.start.alias("s"), r.period.alias("p")))
    return F.array_min(rank)


def runs_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``find_runs`` as the number of runs, the longest one, and digests of all runs and of the collapsed text."""
    found = find_runs(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text", least).withColumn("_best", _longest())
    written = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")), F.lit("\n"))), "")
    start, length, period = F.col("_best.s"), -F.col("_best.l"), F.col("_best.p")
    return found.select(
        F.col("_id").alias(id_col), F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
