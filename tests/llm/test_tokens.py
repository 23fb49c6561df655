"""Counts, files and packing against the plain libraries."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from marginalia.llm import packing, token_counts, token_files, tokens

SENTENCEPIECE, WORD, BYTE = (public_tokenizers.path(x) for x in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, lang string, id long, piece string, start string"
ODD = [None, "", " ", "\n", "  a  b", "a\n\n b", "naïve café, x's don't", "<|endoftext|> a <|endoftext|>", "a　b\x1cc\x85d", "x" * 5000, "ab " * 3000, "ﬁ é ½ 𝔘 😀 中文", "1234 5.6,7"]


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", 7, "p", "s") for i, t in enumerate(texts)], SCHEMA)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    rnd = random.Random(3)
    letters = "ab 'sZéß\n\t  .,!1٣Σσ<|>́ \x1c中-"
    texts = ODD + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    ids, bounds = tokens.Encoder(path).encode(pa.array(texts, pa.string()))
    library = Tokenizer.from_file(path)
    for text, own in zip(texts, np.split(ids, bounds[1:-1]), strict=True):
        assert own.tolist() == library.encode(text or "", add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_cuts_beside_every_letter(path):
    """Letters whose lower case or normal form is more than a letter, beside all marks and after other letters and marks."""
    rnd = random.Random(4)
    letters = [*map(chr, range(0x41, 0x5B)), *map(chr, range(0x61, 0x7B)), *map(chr, range(0xC0, 0x250))]
    marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()]
    texts = [f"{a}{m}{b}" for b in letters for m in marks for a in (b, "x")] + [f"'{b}({m}" for b in letters for m in marks]
    texts += ["".join(rnd.choice(rnd.choice((letters, marks, ["\u0130", "\u0307", "e\u0301", "'", " ", "\n", "1"]))) for _ in range(rnd.randint(1, 8))) for _ in range(20_000)]
    ids, bounds = tokens.Encoder(path).encode(pa.array(texts, pa.string()))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    for text, own, e in zip(texts, np.split(ids, bounds[1:-1]), want, strict=True):
        assert own.tolist() == e.ids, repr(text)


def test_encoder_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_SEGMENTS", 3)
    encoder = tokens.Encoder(BYTE)
    for text in ["a b c d e f", "g h i j", "a b " + "w" * 100, "a b"]:
        assert encoder.encode(pa.array([text]))[0].tolist() == ids_of(BYTE, text)


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_new_segments_of_letters_reach_the_library_together(path, monkeypatch):
    encoder, rnd = tokens.Encoder(path), random.Random(6)
    text = "".join(rnd.choice([" ", "\n", ", "]) + "".join(rnd.choice("abcdeZ") for _ in range(rnd.randint(1, 9))) for _ in range(4000))
    plain, asked = encoder._library, []
    monkeypatch.setattr(encoder, "_library", lambda texts: asked.extend(texts) or plain(texts))
    assert encoder.encode(pa.array([text]))[0].tolist() == ids_of(path, text)
    assert len(asked) < 100
    monkeypatch.setattr(encoder, "stop", ids_of(path, "a"))  # no mark of the vocabulary: segments go one by one
    assert encoder.encode(pa.array(["unseen wordings"]))[0].tolist() == ids_of(path, "unseen wordings")


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 4), (100, 16), (1000, 64)])
def test_resynchronised_counts(chunk, overlap):
    own, model = token_counts.Resynchroniser(SENTENCEPIECE), sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE)
    rnd = random.Random(5)
    texts = ["a" * 3000, " " * 2000, "é" * 900, "the cat " * 400, "ab▁c " * 200, "\n" * 700, "x<0x0A>y " * 99]
    texts += ["".join(rnd.choice("abcdeé  \n.中😀") for _ in range(rnd.randint(50, 3000))) for _ in range(60)]
    for text in texts:
        assert own.count(text, chunk, overlap) == len(model.encode(text)), text[:50]


def test_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(table(spark, ODD).selectExpr("doc_id + 1000000", "text"))
    model = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = token_counts.token_counts(docs, SENTENCEPIECE, limit=100, chunk_bytes=512).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        n = len(model.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)


@given(st.lists(st.integers(0, 2**21), max_size=1500))
@settings(max_examples=40, deadline=None)
def test_levels_round_trip(ids):
    file = token_files.TokenFile(token_files.to_bytes(np.array(ids, np.uint32), [1], np.array([0])))
    assert file.tokens(0, len(ids)).tolist() == ids
    rnd = random.Random(len(ids))
    for _ in range(min(20, len(ids))):
        i, j = sorted(rnd.randrange(len(ids) + 1) for _ in range(2))
        assert file.tokens(i, j).tolist() == ids[i:j]
        k = rnd.randrange(len(ids))
        assert file.token(k) == ids[k]


def test_token_files(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(table(spark, ODD).selectExpr("doc_id + 1000000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in token_files.token_files(docs, WORD, end_id=2).collect()}
    start, library = 0, Tokenizer.from_file(WORD)
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        r = got.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not got


def test_token_files_with_small_shards_null_and_repeated_ids(spark):
    from marginalia.llm.shared import Scratch

    docs = spark.createDataFrame([(None, "a"), (2, "b c"), (2, "b c"), (1, None)], "doc_id long, text string")
    tmp = Scratch(spark, "test")
    manifest = tmp.save(token_files.write_token_files(docs, tmp.folder("f"), WORD, 2, shard_tokens=2), "m")
    rows = sorted(tuple(r)[:3] for r in token_files.read_token_files(manifest).fillna(-1, ["id"]).collect())
    assert rows == [(-1, 0, 2), (1, 2, 1), (2, 3, 3), (2, 6, 3)]


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=25))
@settings(max_examples=150, deadline=None)
def test_plan_places_every_piece_once(histogram):
    got = packing.plan(histogram, 60)
    placed = Counter()
    for pattern, count in got:
        assert sum(pattern) <= 60 and count > 0
        assert sum(3 * n > 60 for n in pattern) <= 2
        for n in pattern:
            placed[n] += count
    assert placed == Counter(histogram)
    # no two pieces above half the capacity share a sequence
    least = max(-(-sum(n * c for n, c in histogram.items()) // 60), sum(c for n, c in histogram.items() if 2 * n > 60))
    assert sum(c for _, c in got) <= max(1, 1.5 * least + 1)


def test_plan_equals_one_by_one():
    """Run lengths give the sequences that packing piece by piece gives."""
    rnd = random.Random(2)
    for _ in range(50):
        histogram = Counter(rnd.randint(1, 40) for _ in range(rnd.randint(1, 120)))
        larges = sorted((n for n in histogram.elements() if 3 * n > 40), reverse=True)
        bins = []
        while larges:
            a = larges.pop(0)
            k = next((i for i, b in enumerate(larges) if a + b <= 40), None)
            bins.append(a + (larges.pop(k) if k is not None else 0))
        for n in sorted((n for n in histogram.elements() if 3 * n <= 40), reverse=True):
            fit = [b for b in bins if b + n <= 40]
            if fit:
                bins[bins.index(max(fit))] += n
            else:
                bins.append(n)
        assert sum(c for _, c in packing.plan(histogram, 40)) == len(bins)


def test_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(table(spark, ODD).selectExpr("doc_id + 1000000", "text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack_documents(docs, BYTE, end_id=2, capacity=64).collect()
    library, by_doc, by_sequence = Tokenizer.from_file(BYTE), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert k == 0 or r.length == 64
            at += r.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64


def test_empty_tables(spark):
    none = table(spark, []).select("doc_id", "text", "id", "piece")
    assert token_counts.token_counts(none, SENTENCEPIECE).count() == 0
    assert token_files.token_files(none, WORD, 2).count() == 0
    assert packing.pack_documents(none, BYTE, 2).count() == 0
