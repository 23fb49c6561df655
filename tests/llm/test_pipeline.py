"""Each stage of the pipeline against a plain version of it, on its own input."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    sets, least = [shingles(r.text) for r in rows], {}
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    for i, r in enumerate(rows):
        least[find(i)] = min(r.doc_id, least.get(find(i), r.doc_id))
    return set(least.values())


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(docs.collect())
    source = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    good, exact, near, mixed, packed = kept
    assert all(source[r.doc_id] == r for rows in kept[:4] for r in rows)

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 4 == 2]
    ids = {r.doc_id for r in good}
    assert np.mean([(d in ids) == bool(labels[d]) for d in held]) >= 0.9

    last = {}
    for r in good:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in exact) == sorted(last.values())
    assert sorted(r.doc_id for r in near) == sorted(one_of_each(exact))

    times = Counter(r.doc_id for r in mixed)
    assert set(times) == {r.doc_id for r in near} and set(times.values()) <= {1, 2, 3}
    once, given = defaultdict(int), defaultdict(int)
    for d, n in times.items():
        size = len((source[d].text or "").split())
        once[source[d].source] += size
        given[source[d].source] += n * size
    assert all(given[s] <= 2 * once[s] for s in once) and sum(given.values()) >= sum(once.values())

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for p in packed:
        pieces[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length and zlib.crc32(bytes(p.ids)) == p.ids_crc32
    for d, own in pieces.items():
        ids = np.array([*t.encode(source[d].text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        by_piece = {p.piece: bytes(p.ids) for p in own}
        assert b"".join(by_piece[k] for k in sorted(by_piece)) == ids
        assert set(Counter(p.piece for p in own).values()) == {times[d]}
    assert set(pieces) == set(times)
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
