"""Phrases and the set-similarity join against plain versions, and odd tables."""

import math
import random
import re

import pytest

from marginalia.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(text, phrases=licenses.PHRASES, notices=licenses.NOTICES, share=licenses.CONTAINMENT):
    words = words_of(text)
    places = [(i, i + len(p.split()), label) for i in range(len(words)) for p, label in phrases if words[i : i + len(p.split())] == p.split()]
    blocks = set()
    for label, notice in notices:
        own, width = set(words_of(notice)), len(words_of(notice))
        step = (width + 1) // 2
        window = width + step
        for start in range(0, max(1, len(words)), step):
            common = len(own & set(words[start : start + window]))
            if common >= math.ceil(share * len(own) - 1e-9):
                blocks.add((start, start + window, label, common / len(own)))
    return len(words), sorted(places), sorted(blocks)


def made(n=400):
    rng = random.Random(4)
    small = ["the", "license", "under", "mit", "gnu", "public", "general", "cc", "by", "nc", "all", "rights", "reserved", "é", "2", "0", "of", "licensed"]
    out = [None, "", " .\n", "Licensed under CC BY-NC 4.0.", "ALL\nrights-reserved all rights reserved", "cc-by cc by cc  by", "éall rights reserved", "all rights reserved2"]
    for _ in range(n):
        words = [rng.choice(small) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            notice = words_of(rng.choice(licenses.NOTICES)[1])
            if rng.random() < 0.5:
                notice[rng.randrange(len(notice))] = "other"
            at = rng.randint(0, len(words))
            words[at:at] = notice
        out.append("".join(w + rng.choice([" ", ", ", "\n"]) for w in words))
    return out


def found(df):
    return {r.doc_id: (r.n_words, sorted((p.start, p.end, p.label) for p in r.places), sorted({(b.start, b.end, b.label, b.containment) for b in r.blocks})) for r in df.collect()}


def test_equals_the_plain_version(spark):
    texts = made()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, blocks string, row int").repartition(6)
    got = found(licenses.license_blocks(docs))
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert sum(bool(b) for _, _, b in got.values()) > 100
    loose = found(licenses.license_blocks(docs, containment=0.6))
    assert loose == {i: plain(t, share=0.6) for i, t in enumerate(texts)}


def test_notices_of_documents_and_clean_texts(spark):
    notices = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "reserved", "Gehen wir nach Hause, under the licence of mit.": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this programme and associated documentation files": "mit",
    }
    filler = "und dem Baum die words of mit text near a tree " * 2000
    docs = spark.createDataFrame([(i, f"{filler}\n{t} {filler}") for i, t in enumerate(notices)] + [(90, filler), (91, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_digest(docs).collect()}
    assert [got[i].labels for i in range(len(notices))] == list(notices.values())
    assert (got[90].labels, got[90].score, got[90].n_words, got[90].first_word) == ("", 0.0, 22_000, None)
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels, got[4].score) == (1, 22_000, 22_000, "reserved", 1.0)
    assert tuple(got[91])[1:] == (0, 0, None, None, "", "", 0.0)


def test_odd_tables_and_parameters(spark):
    docs = spark.createDataFrame([(None, "all rights reserved"), (1, "the mit license mit"), (1, "the mit license mit")], "doc_id long, text string")
    got = licenses.license_digest(docs).collect()
    assert sorted((str(r.doc_id), r.labels) for r in got) == [("1", "mit"), ("1", "mit"), ("None", "reserved")]
    assert licenses.license_digest(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.license_blocks(docs, notices=[("x", "...")])
    with pytest.raises(ValueError):
        licenses.license_blocks(docs, notices=[("x", "a b " * licenses.MOST_WORDS)])
