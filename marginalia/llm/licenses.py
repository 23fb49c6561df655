"""License scan: places of fixed phrases, and an exact set-similarity join of text blocks with license notices.

Blocks are windows of words: a notice of m words is compared with windows of one and a half times m that step by half of m, so
wherever it stands, one of them holds all of it, and one word between. A block matches a notice if it holds a given share
of the notice's distinct words (containment). The join is exact: words are ordered by how often they occur in all documents,
rarest first; to match, a block must hold one of a notice's first words (prefix filter), have words enough (length filter), and
from the first common word on both must have enough left (positional filter); what remains is compared word by word.

At scale: two passes over the texts, the first for the words' frequencies, and no shuffle of texts. Only windows around a
notice's rarest words leave a task, as numbers of words, so the join's rows are about as many as notices in the texts. The list
of notices is a parameter of bounded size, so what is broadcast doesn't grow with the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import tokens
from marginalia.llm.shared import Scratch, lean, text_of
from marginalia.llm.wordscan import folded

#: A notice's distinct words that a block must hold. Notices of nine words or fewer must be held whole.
CONTAINMENT = 0.9
#: All notices together have so many words at most.
MOST_WORDS = 50_000
_SLICE_BYTES = 1_000_000

#: Phrases whose every place counts, and their labels: fixed values.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Notices by label, in the words of well-known license texts.
NOTICES = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "the apache license version 2 0"),
    ("apache-2.0", "apache 2 0 license"),
    ("artistic-2.0", "the artistic license 2 0"),
    ("bsd", "licensed under the bsd license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "creative commons attribution license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc-by-nd", "licensed under cc by nd"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-sa", "licensed under cc by sa"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("cc0", "cc0 1 0 universal public domain dedication"),
    ("epl-2.0", "eclipse public license version 2 0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("lgpl", "gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "the mit license mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "mozilla public license version 2 0"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "unauthorized copying of this file via any medium is strictly prohibited"),
)


def _words(text: str) -> list[str]:
    return folded(pa.array([text], pa.string()))[0].decode().split()


def step_of(words: int) -> int:
    """How far windows for a notice of so many words are apart; they are longer than the notice by as much."""
    return (words + 1) // 2


def _frequencies(docs: DataFrame, vocabulary: set[str]) -> dict[str, int]:
    """How often each word of the vocabulary occurs in all texts."""
    wanted = frozenset(w.encode() for w in vocabulary)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for start, n in tokens.bounded(batch.column(0), _SLICE_BYTES):
                data, bounds = folded(batch.column(0).slice(start, n))
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    found.update(filter(wanted.__contains__, data[a:b].split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return dict(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n")).collect())


_PLACE = "struct<start:long,end:long,label:string>"
_BLOCK = "struct<width:int,start:long,words:array<int>>"


def _scanned(docs: DataFrame, phrases: Sequence[tuple[str, str]], number: dict[str, int], prefixes: dict[str, set[int]]) -> DataFrame:
    """Per row: id, n_words, places of phrases, and the windows that hold a prefix word of a notice of their width (its number of words)."""
    kind = docs.schema["id"].dataType.simpleString()
    numbers = {w.encode(): i for w, i in number.items()}
    at_word = {w.encode(): sorted(widths) for w, widths in prefixes.items()}
    begins: dict[bytes, list] = {}
    for phrase, label in phrases:
        words = [w.encode() for w in _words(phrase)]
        begins.setdefault(words[0], []).append((words, label))
    marked = frozenset(at_word) | frozenset(begins)
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    block = pa.struct([("width", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32()))])

    def of_text(words: list[bytes]) -> tuple[list, list]:
        places, blocks = [], set()
        for i in [i for i, w in enumerate(words) if w in marked]:
            for phrase, label in begins.get(words[i], ()):
                if words[i : i + len(phrase)] == phrase:
                    places.append({"start": i, "end": i + len(phrase), "label": label})
            for width in at_word.get(words[i], ()):
                step = step_of(width)
                blocks.update((width, k * step) for k in range(max(0, i - width) // step, i // step + 1))
        out = []
        for width, start in sorted(blocks):
            out.append({"width": width, "start": start, "words": sorted({numbers[w] for w in words[start : start + width + step_of(width)] if w in numbers})})
        return places, out

    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, n in tokens.bounded(batch.column(1), _SLICE_BYTES):
                data, bounds = folded(batch.column(1).slice(start, n))
                sizes, places, blocks = [], [], []
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    words = data[a:b].split()
                    own = of_text(words)
                    sizes.append(len(words))
                    places.append(own[0])
                    blocks.append(own[1])
                columns = [batch.column(0).slice(start, n), pa.array(sizes, pa.int64()), pa.array(places, pa.list_(place)), pa.array(blocks, pa.list_(block))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "places", "blocks"])

    return docs.select("id", "text").mapInArrow(scan, f"id {kind}, n_words long, places array<{_PLACE}>, blocks array<{_BLOCK}>")


def _joined(blocks: DataFrame, notices: DataFrame) -> DataFrame:
    """The exact join: row, start, end, label, containment of every block that holds enough of a notice. Words of both are numbers, rarest first."""
    prefix = notices.select("notice", "width", "need", "size", F.posexplode(F.slice("words", F.lit(1), F.col("size") - F.col("need") + 1)).alias("place", "word"))
    words = blocks.select("row", "width", "start", "words", F.posexplode("words").alias("at", "word"))
    pairs = words.join(F.broadcast(prefix), ["width", "word"]).filter(F.size("words") >= F.col("need"))
    first = pairs.groupBy("row", "width", "start", "notice").agg(F.min(F.struct("place", "at")).alias("first"), F.first("words").alias("words"), F.first("need").alias("need"), F.first("size").alias("size"))
    left = F.least(F.col("size") - F.col("first.place"), F.size("words") - F.col("first.at"))
    kept = first.filter(left >= F.col("need")).join(F.broadcast(notices.select("notice", "label", F.col("words").alias("of_notice"))), "notice")
    common = F.size(F.array_intersect("words", "of_notice"))
    end = F.col("start") + F.col("width") + F.expr("(width + 1) div 2")
    matched = kept.withColumn("common", common).filter(F.col("common") >= F.col("need"))
    return matched.select("row", "start", end.alias("end"), "label", (F.col("common") / F.col("size")).alias("containment"))


def license_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, containment: float = CONTAINMENT,
) -> DataFrame:
    """Per row: id, n_words, places (array of start, end, label: where a phrase stands), blocks (array of start, end, label, containment: windows that hold a notice).

    Words are letters and digits of ASCII and all characters beyond it, A-Z in lower case, numbered from 0; ends are
    exclusive, a window's end may lie beyond the text's. Null and empty texts have no words and match nothing. Repeated rows and null
    ids are returned as they are; other columns are ignored; an empty table gives an empty result. Notices without words
    are an error, as are phrases, and notices of more than ``MOST_WORDS`` words in all.
    """
    spark, tmp = docs.sparkSession, Scratch(docs.sparkSession, "licenses")
    split = [(label, _words(text)) for label, text in notices]
    if not all(w for _, w in split) or not all(_words(p) for p, _ in phrases):
        raise ValueError("a notice or a phrase has no words")
    if sum(len(w) for _, w in split) > MOST_WORDS:
        raise ValueError(f"notices have more than {MOST_WORDS} words")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    vocabulary = set().union(*(w for _, w in split))
    often = _frequencies(rows, vocabulary)
    number = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}
    known, prefixes = [], {}
    for i, (label, words) in enumerate(split):
        own = sorted({number[w] for w in words})
        need = math.ceil(containment * len(own) - 1e-9)
        known.append((i, label, len(words), need, len(own), own))
        for w in sorted(set(words), key=number.__getitem__)[: len(own) - need + 1]:
            prefixes.setdefault(w, set()).add(len(words))
    table = spark.createDataFrame(known, "notice int, label string, width int, need int, size int, words array<int>")
    scanned = tmp.save(_scanned(rows, phrases, number, prefixes).withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = _joined(scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.*"), table)
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "containment"))).alias("found"))
    out = scanned.drop("blocks").join(tmp.save(by_row, "found"), "row", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint,label:string,containment:double>>")
    return out.select(F.col("id").alias(id_col), "n_words", "places", F.coalesce("found", none).alias("blocks"))


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``license_blocks`` as counts and labels; the score is 1 where a phrase stands, else the greatest containment of a block, else 0."""
    found = license_blocks(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_id", "_text")
    base, starts = F.transform("places", lambda p: p.label), F.transform("places", lambda p: p.start)
    own = F.transform("blocks", lambda b: b.label)
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        F.col("_id").alias(id_col), "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b.containment)), F.lit(0.0))).alias("score"),
    )
