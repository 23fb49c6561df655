"""Quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character kinds, lengths and repetition, its own and those of the
lines before and after it; transitions tie neighbouring labels. Forward and backward passes give each line's marginal.
A document's quality is the mean of its lines' marginals weighted by length, and a logistic curve fitted on the
training documents turns it into a probability.

The model is fitted on a bounded sample of labelled documents (``SAMPLE_DOCS``, by hash of the id; of one with more than
``SAMPLE_LINES`` lines, as many from its middle), whose line features Spark makes. A label holds for all lines of its document. At scale: scoring is one pass without a shuffle, over Arrow
batches, with vectors over all bytes and all lines of a batch; the model is about a hundred numbers in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.shared import lean

SAMPLE_DOCS = 4000
SAMPLE_LINES = 2000
ROUNDS = 150
LEARNING_RATE = 0.08
PENALTY = 2e-3
THRESHOLD = 0.7
SLICE_BYTES = 500_000

_KINDS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", ".,;:'\"()?-", "!", "|", "#$%&*@^~", "<>{}[]=+/\\_`"]
_OTHER = len(_KINDS)
_TABLE = np.full(256, _OTHER + 1, dtype=np.uint8)
_TABLE[:128] = _OTHER
for _k, _chars in enumerate(_KINDS):
    for _c in _chars:
        _TABLE[ord(_c)] = _k
_TABLE[ord("\n")] = 3
N_KINDS = _OTHER + 2
N_OWN = N_KINDS + 11
N_FEATURES = 3 * N_OWN + 1
_NAMING = np.random.default_rng(1).integers(1 << 62, size=256, dtype=np.uint64) | 1
_PLACE = np.random.default_rng(2).integers(1 << 62, size=64, dtype=np.uint64) | 1


def line_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, bytes of each, and where each text's lines begin (one more entry: the end). Null is empty; an empty text has one empty line."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lines = pc.split_pattern(texts, "\n")
    starts = np.asarray(lines.offsets) - lines.offsets[0].as_py()
    flat = lines.flatten()
    size = np.asarray(pc.binary_length(flat), dtype=np.int64)
    data = np.frombuffer("\n".join(texts.to_pylist()).encode(), dtype=np.uint8)  # the same lines, one after the other
    kinds = _TABLE[data]
    ends = np.cumsum(size + 1) - 1  # places of the line feeds
    begins = ends - size

    def per_line(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[ends] - sums[begins]

    counts = np.stack([per_line(kinds == k) for k in range(N_KINDS)], axis=1).astype(np.float64)
    white = kinds == 3
    word_start = ~white & np.concatenate([[True], white[:-1]])
    words = per_line(word_start)
    same = np.concatenate([[False], data[1:] == data[:-1]])
    symbol = (kinds >= 5) & (kinds <= 8)
    marked = per_line(symbol & np.concatenate([white[1:], [True]]))  # words that end in a symbol
    capital = per_line(word_start & (kinds == 1))
    at = np.flatnonzero(word_start)
    again, long_repeat = np.zeros(len(data), bool), np.zeros(len(data), bool)
    if len(at):  # words that equal the one before them, and the one two before
        place = np.arange(len(data)) - at[np.maximum(np.cumsum(word_start) - 1, 0)]
        name = np.add.reduceat(np.where(white, 0, _NAMING[data] * _PLACE[place & 63]).astype(np.uint64), at)
        again[at[1:]] = name[1:] == name[:-1]
        long_repeat[at[2:]] = name[2:] == name[:-2]
    again, long_repeat = per_line(again), per_line(long_repeat)
    n = np.maximum(size, 1)
    w = np.maximum(words, 1)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    code = np.asarray(flat.dictionary_encode().indices, dtype=np.int64)
    _, at, times = np.unique(doc * (code.max(initial=0) + 1) + code, return_inverse=True, return_counts=True)
    repeated = (times[at] > 1) & (size > 0)
    own = np.column_stack([
        counts / n[:, None], np.log1p(size) / 5, np.log1p(words) / 4, np.minimum(n / w, 30) / 10, marked / w, capital / w, again / w, long_repeat / w,
        per_line(same) / n, repeated, size == 0, np.minimum(np.repeat(np.diff(starts), np.diff(starts)), 50) / 50,
    ])
    first, last = np.zeros(len(size), bool), np.zeros(len(size), bool)
    first[starts[:-1]], last[starts[1:] - 1] = True, True
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.column_stack([own, before, after, np.ones(len(size))]).astype(np.float32), size, starts


def _step(x: np.ndarray, w: np.ndarray, backward: bool) -> np.ndarray:
    """The log-odds that a neighbour with log-odds x passes on; w[a][b] goes with label a and then b."""
    w = w.T if backward else w
    return np.logaddexp(x + w[1, 1], w[0, 1]) - np.logaddexp(x + w[1, 0], w[0, 0])


def chains(odds: np.ndarray, starts: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (own evidence included) and backward ones (not included) of every line; all texts at once, line by line."""
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    begin, n = starts[:-1][order], n[order]
    forward, backward = odds.astype(np.float64).copy(), np.zeros(len(odds))
    live = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")  # texts with more than t lines
    for t in range(1, len(live)):
        at = begin[: live[t]] + t
        forward[at] += _step(forward[at - 1], w, False)
    for t in range(len(live) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        backward[at] = _step(odds[at + 1] + backward[at + 1], w, True)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def quality(features: np.ndarray, size: np.ndarray, starts: np.ndarray, model: dict) -> np.ndarray:
    """Per text the mean of its lines' marginals, weighted by length."""
    forward, backward = chains(features @ model["weights"], starts, model["pairs"])
    good = _sigmoid(forward + backward)
    weight = size + 1.0
    return np.add.reduceat(good * weight, starts[:-1]) / np.add.reduceat(weight, starts[:-1])


def fit(features: np.ndarray, size: np.ndarray, starts: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> dict:
    """Maximum conditional likelihood by Adam; classes weigh the same."""
    lines = np.diff(starts)
    y = np.repeat(labels, lines).astype(np.float64)
    share = np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3)
    cost = np.repeat(np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)), lines) / max(1, len(y))
    inner = np.ones(len(y), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    theta = np.zeros(features.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        weights, pairs = theta[:-4], theta[-4:].reshape(2, 2)
        odds = features @ weights
        forward, backward = chains(odds, starts, pairs)
        grad = np.empty_like(theta)
        grad[:-4] = features.T @ (cost * (y - _sigmoid(forward + backward)))
        both = np.stack([a * forward[at - 1] + pairs[a, b] + b * (odds[at] + backward[at]) for a in (0, 1) for b in (0, 1)])
        both = np.exp(both - both.max(axis=0))
        both /= both.sum(axis=0)
        seen = np.stack([(y[at - 1] == a) & (y[at] == b) for a in (0, 1) for b in (0, 1)])
        grad[-4:] = ((seen - both) * cost[at]).sum(axis=1)
        grad -= PENALTY * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + LEARNING_RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = {"weights": theta[:-4].astype(np.float32), "pairs": theta[-4:].reshape(2, 2)}
    model["curve"] = _logistic(quality(features, size, starts, model) if len(labels) else np.zeros(0), labels)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a small penalty."""
    z = np.column_stack([x, np.ones(len(x))])
    t = np.zeros(2)
    for _ in range(50):
        p = _sigmoid(z @ t)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        t = t + np.linalg.solve(h, z.T @ (y - p) - 1e-2 * t)
    return float(t[0]), float(t[1])


def score(texts: pa.Array, model: dict) -> np.ndarray:
    out = np.zeros(len(texts))
    a, b = model["curve"]
    for start, n in tokens.bounded(texts, SLICE_BYTES):
        out[start : start + n] = _sigmoid(a * quality(*line_features(texts.slice(start, n)), model) + b)
    return out


def held_out(id_col: str):
    """Rows that no label is learned from: crc32 of the id as text, modulo 4, is 2. A null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_docs: int = SAMPLE_DOCS) -> dict:
    """The model. Labels other than 0 and 1, null ids and held-out rows aren't used; without any, every score is that of no evidence.
    Of several labels for an id the smallest counts."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("y"))
    chosen = usable.orderBy(F.xxhash64("id"), "id").limit(sample_docs)

    @lean
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in tokens.bounded(batch.column(2), SLICE_BYTES):
                features, size, starts = line_features(batch.column(2).slice(at, n))
                spans = [(a + max(0, b - a - SAMPLE_LINES) // 2, b) for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False)]
                raw = [features[a : min(b, a + SAMPLE_LINES)].tobytes() for a, b in spans]
                sizes = [size[a : min(b, a + SAMPLE_LINES)].astype("<i8").tobytes() for a, b in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array(raw, pa.binary()), pa.array(sizes, pa.binary())], names=["id", "y", "features", "sizes"])

    # the sample has at most sample_docs rows of two integers, so it may be broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("id", F.col("y").cast("int").alias("y"), "text")
    found = sample.mapInArrow(rows, f"id {docs.schema[id_col].dataType.simpleString()}, y int, features binary, sizes binary").drop("id").toArrow()
    if not found.num_rows:
        return fit(np.zeros((0, N_FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0), rounds=0)
    features = [np.frombuffer(x, np.float32).reshape(-1, N_FEATURES) for x in found["features"].to_pylist()]
    order = sorted(range(len(features)), key=lambda i: features[i].tobytes())  # a sum's last bits depend on the order
    sizes = [np.frombuffer(x, "<i8") for x in found["sizes"].to_pylist()]
    features, sizes = [features[i] for i in order], [sizes[i] for i in order]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sizes])])
    return fit(np.concatenate(features), np.concatenate(sizes), starts, np.asarray(found["y"], dtype=np.float64)[order])


def scores(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score (0 to 1), predicted (1 from the threshold on). Null texts count as empty, which have a score too.
    Rows with equal texts have equal scores; repeated rows and null ids are returned as they are; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = score(batch.column(2), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own), pa.array((own >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier doesn't reject, with all their columns."""

    at = docs.columns.index(text_col)

    @lean
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at), model) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
