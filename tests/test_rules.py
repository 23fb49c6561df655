"""Rules that the tables don't reach, case by case."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import pages as P
from marginalia.operators import workflow as W


def plain_slug(x):
    x = "".join(c for c in unicodedata.normalize("NFKD", x) if not "\u0300" <= c <= "\u036f").lower().replace("&", " and ")
    return re.sub("^-+|-+$", "", re.sub("[^a-z0-9]+", "-", x))[:200]


def test_slugs(spark):
    names = ["Café", "Cafe\u0301s & bars", "ﬁne oﬃce", "１２ ｗide", "Ångström", "ẞ ø", "--", "", "x" * 300, "Ὀδύσσεια", "Nº 5", "a\u0327\u0301b"]
    got = [r[0] for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "k int, n string").orderBy("k").select(T.slug(F.col("n"))).collect()]
    assert got == [plain_slug(n) for n in names]


def test_slugs_are_unique_in_order(spark):
    rnd = random.Random(1)
    names = [rnd.choice(["a", "a 2", "A-2-2", "b", "b 3", "", "item", "item 2", "c & d", "a 3", "z"]) for _ in range(200)]
    taken, want = set(), []
    for n in names:
        root = plain_slug(n) or "item"
        slug, k = root, 2
        while slug in taken:
            slug, k = f"{root}-{k}", k + 1
        taken.add(slug)
        want.append(slug)
    rows = spark.createDataFrame(list(enumerate(names)), "k int, n string").repartition(3)
    assert [r.slug for r in P.unique_slugs(rows, "n", "k").orderBy("k").collect()] == want


def test_ligatures(spark):
    assert spark.range(1).select(T.expand_ligatures(F.lit("oﬃce baﬄe ﬁt ‘a’ “b”"))).first()[0] == "office baffle fit 'a' \"b\""


def codes(*commands):
    state, out = W.FRESH, []
    for c in commands:
        state, code = W.step(state, c)
        out.append(code or state[0])
    return out


def test_workflow_rules():
    assert codes("create", "submit", "delete", "withdraw", "delete") == ["DRAFT", "PENDING_REVIEW", "ARTICLE_NOT_DELETABLE", "DRAFT", None]
    assert codes("create", "approve", "submit", "submit", "reject", "delete", "submit", "approve", "delete") == ["DRAFT", "NOT_PENDING_REVIEW", "PENDING_REVIEW", "ALREADY_SUBMITTED", "REJECTED", "ARTICLE_NOT_DELETABLE", "PENDING_REVIEW", "PUBLISHED", "ARTICLE_NOT_DELETABLE"]
    published = ["create", "submit", "approve"]
    assert codes(*published, "approve", "submit", "revise", "revise", "submit", "approve")[3:] == ["NO_PENDING_VERSION", "NO_EDITABLE_VERSION", "PUBLISHED", "REVISION_IN_PROGRESS", "PUBLISHED", "PUBLISHED"]
    assert codes(*published, "unpublish", "revise", "unpublish", "archive", "archive")[3:] == ["UNPUBLISHED", "NOT_PUBLISHED", "NOT_PUBLISHED", "ARCHIVED", "NOT_ARCHIVABLE"]
    assert codes("submit", "create", "create", "fly") == ["NOT_FOUND", "DRAFT", "CONFLICT", "UNKNOWN_COMMAND"]


def test_workflow_fold_equals_step(spark):
    rnd = random.Random(2)
    rows = [(a, i, rnd.choice(["create", "submit", "approve", "reject", "revise", "withdraw", "delete", "unpublish", "archive", None])) for a in range(20) for i in range(30)]
    got = {(r.article, r.seq): (r.accepted, r.code, r.status, r.version, r.published_version) for r in W.fold(spark.createDataFrame(rows, "article long, seq long, command string")).collect()}
    for a in range(20):
        state = W.FRESH
        for _, i, c in sorted(r for r in rows if r[0] == a):
            state, code = W.step(state, c)
            assert got[a, i] == (not code, code or None, state[0], state[1], state[2])
