"""Ranked lexical search by a scan of documents for all items' terms at once.

The terms of all items are one Aho-Corasick automaton, each term between two guards, so that it is only found as a whole
word; it is broadcast, and counts how often each term occurs in a document directly from the text. There is no index of
documents. Corpus figures (documents, terms, documents of a term) are sums of those counts; then each task adds up the
scores of its documents for the items that its terms belong to and hands on its best few for each item.

At scale: items are cut to blocks of bounded bytes, so the automaton is bounded whatever the number of items; each block
reads the texts once. The counts are far smaller than the texts. A task hands on ``k`` rows per item at most, so neither copies
of a document nor frequent words make more of them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.shared import Scratch, lean
from marginalia.llm.wordscan import folded, word_counts

BEST = 10
#: Items of one automaton: their texts' bytes (an item with more is alone) and their number.
BLOCK_BYTES = 512 * 1024
BLOCK_ITEMS = 4096
#: A document's length counts so much, of a hundred; both are the ranking formula's constants.
LENGTH_SHARE = 75
SATURATION = 8
_SLICE_BYTES = 1_000_000
_SLICE_CELLS = 1_000_000


def _item_blocks(items: DataFrame, id_col: str, text_col: str, tmp: Scratch) -> DataFrame:
    """The items with the block that each belongs to. Each task cuts its own rows, so no block is beyond its bounds but by one item."""
    kind = items.schema[id_col].dataType.simpleString()
    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, own = 0, 0, 0
        for batch in batches:
            names = []
            for text in batch.column(1):
                more = len((text.as_py() or "").encode())
                if own and (held + more > BLOCK_BYTES or own == BLOCK_ITEMS):
                    block, held, own = block + 1, 0, 0
                held, own = held + more, own + 1
                names.append(f"{TaskContext.get().partitionId()}-{block}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], names=["id", "text", "block"])

    tasks = max(1, size // (8 * BLOCK_BYTES), n // (8 * BLOCK_ITEMS))
    return tmp.save(rows.coalesce(int(tasks)).mapInArrow(cut, f"id {kind}, text string, block string"), "items")


def _term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Per row: id, n (all terms of the text), terms (numbers of those that occur) and times (how often)."""
    kind = docs.schema["id"].dataType.simpleString()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for number, term in enumerate(terms):
        automaton.add_word(f" {term} ", number)
    automaton.make_automaton()
    shared, second = docs.sparkSession.sparkContext.broadcast(automaton), itemgetter(1)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start, n in tokens.bounded(batch.column(1), _SLICE_BYTES):
                data, bounds = folded(batch.column(1).slice(start, n))
                found, times, sizes = [], [], [0]
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    hits = Counter(map(second, own.iter(f" {data[a:b].decode()} ")))
                    found.extend(hits.keys())
                    times.extend(hits.values())
                    sizes.append(len(found))
                lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (found, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, n), pa.array(word_counts(data, bounds)), *lists], names=["id", "n", "terms", "times"])

    return docs.mapInArrow(count, f"id {kind}, n long, terms array<int>, times array<int>")


class _Best:
    """The best documents of each item so far, equal scores by ascending id, nulls last."""

    def __init__(self, items: int, k: int):
        self.k, self.rows, self.least = k, [[] for _ in range(items)], np.ones(items, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: list) -> None:
        """``scores`` has a row for each document and a column for each item."""
        for item in np.flatnonzero(scores.max(axis=0) >= self.least).tolist():
            column, least = scores[:, item], int(self.least[item])
            if len(column) > self.k:
                least = max(least, int(np.partition(column, -self.k)[-self.k]))
            at = np.flatnonzero(column >= least).tolist()
            rows = self.rows[item] + [(-int(column[i]), ids[i] is None, ids[i]) for i in at]
            rows.sort(key=lambda r: r if not r[1] else (r[0], True))
            self.rows[item] = rows[: self.k]
            if len(rows) >= self.k:
                self.least[item] = -rows[self.k - 1][0]


def _best_of_tasks(counts: DataFrame, weight: np.ndarray, by_term: tuple[np.ndarray, np.ndarray, np.ndarray], n_items: int, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """Per task and item the best ``k`` documents: item (its number), id, score."""
    kind = counts.schema["id"].dataType.simpleString()
    shared = counts.sparkSession.sparkContext.broadcast((weight, *by_term))

    def scores(part: pa.RecordBatch) -> np.ndarray:
        weight, first, item_of, repeats = shared.value
        lists, times = part.column(2), np.asarray(part.column(3).flatten(), dtype=np.int64)
        terms, each = np.asarray(lists.flatten(), dtype=np.int64), np.diff(np.asarray(lists.offsets))
        m = np.array([100 - LENGTH_SHARE + (LENGTH_SHARE * n * n_docs) // n_terms for n in part.column(1).to_pylist()], dtype=np.int64)
        doc = np.repeat(np.arange(part.num_rows), each)
        value = weight[terms] * ((1_000_000_000 * times) // (1000 * times + SATURATION * m[doc]))
        wide = first[terms + 1] - first[terms]  # items of the term
        at = np.repeat(np.arange(len(terms)), wide)
        posting = np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide) + first[terms[at]]
        out = np.zeros((part.num_rows, n_items), dtype=np.int64)
        np.add.at(out.reshape(-1), doc[at] * n_items + item_of[posting], value[at] * repeats[posting])
        return out

    @lean
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, first, id_type = _Best(n_items, k), shared.value[1], None
        for batch in batches:
            id_type = batch.schema.field(0).type
            lists = batch.column(2)
            terms = np.asarray(lists.flatten(), dtype=np.int64)
            cells = np.concatenate([[0], np.cumsum(first[terms + 1] - first[terms])])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            cells = cells + n_items * np.arange(batch.num_rows + 1)
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(cells, cells[start] + _SLICE_CELLS, side="right")) - 1)
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(start, end - start)]) for c in batch.columns], names=batch.schema.names)
                best.add(scores(part), part.column(0).to_pylist())
                start = end
        if id_type is not None:
            flat = [(item, r[2], -r[0]) for item, rows in enumerate(best.rows) for r in rows]
            columns = [pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], id_type), pa.array([r[2] for r in flat], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "id", "score"])

    return counts.mapInArrow(rank, f"item int, id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", query_col: str = "text", k: int = BEST) -> DataFrame:
    """Per item its ``k`` documents of highest score above 0 (all, if fewer): the item's id, rank (from 1), the document's id, score.

    Terms are letters and digits of ASCII and all characters beyond it, A-Z in lower case. With N documents that have terms, L
    terms in all, n terms of a document, df documents of a term: w = floor(1000 ln((2N + 2) / (2df + 1))), m = 25 + 75 n N div L,
    and the score sums w (10^9 tf div (1000 tf + 8 m)) over the item's terms, repeats included. Equal scores rank by
    ascending id, null ids last. Null and empty texts have no terms: such documents aren't found, such items find nothing.
    Each row of items is answered on its own, repeated ones too; each row of documents is a document. Other
    columns are ignored; empty tables give an empty result.
    """
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "search")
    item_kind, kind = items.schema[item_col].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _item_blocks(items, item_col, query_col, tmp)
    parts = []
    for number, (block,) in enumerate(sorted(blocks.select("block").distinct().collect())):
        own = blocks.filter(F.col("block") == block).select("id", "text").collect()  # of bounded bytes
        words = [Counter((lambda found: found[0].decode().split())(folded(pa.array([r.text], pa.string())))) for r in own]
        terms = sorted(set().union(*words))
        if not terms:
            continue
        place = {t: i for i, t in enumerate(terms)}
        counts = tmp.save(_term_counts(rows, terms), f"counts-{number}")
        n_docs, n_terms = counts.filter("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        held = dict(counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # as many rows as terms
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(terms))], dtype=np.int64)
        postings = sorted((place[t], item, n) for item, found in enumerate(words) for t, n in found.items())
        of_term, item_of, repeats = (np.array(x, dtype=np.int64) for x in zip(*postings, strict=True))
        first = np.searchsorted(of_term, np.arange(len(terms) + 1))
        best = _best_of_tasks(counts, weight, (first, item_of, repeats), len(own), n_docs, n_terms, k)
        by_item = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = tmp.save(best.withColumn("rank", F.row_number().over(by_item)).filter(F.col("rank") <= k), f"best-{number}")
        names = spark.createDataFrame([(i, r.id) for i, r in enumerate(own)], f"item int, item_id {item_kind}")
        parts.append(best.join(F.broadcast(names), "item").select(F.col("item_id").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
        tmp.drop(f"counts-{number}")
    if not parts:
        return spark.createDataFrame([], f"`{item_col}` {item_kind}, rank int, `{id_col}` {kind}, score long")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
