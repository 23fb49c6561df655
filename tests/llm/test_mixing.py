"""Temperature mixing against a plain version, document by document."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marginalia.llm import mixing

SCHEMA = "doc_id long, text string, source string, rest string, weight string, passes string, cut string, blocks string, bucket string, s string, tokens string, share string"


def table(spark, rows):
    return spark.createDataFrame([(*r, *"abcdefghi") for r in rows], SCHEMA)


def documents(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    # one source with a third of all, a null source, one without tokens, null and empty texts, null and repeated ids
    rows += [(10_000 + i, "w " * (1 + i % 7), "hot") for i in range(len(rows) // 2)]
    rows += [(20_000, "a b c", None), (20_001, None, None), (20_002, "", "blank"), (None, "x y", "hot"), (20_003, "p q", "hot"), (20_003, "p q", "hot")]
    return table(spark, rows), rows


def plain(spark, docs, rows, found=None, entropy=None, repeats=None, budget=None, block_docs=mixing.BLOCK_DOCS):
    """Copies of each row by (id, source), and the weights."""
    size = {i: len((t or "").split()) for i, (_, t, _) in enumerate(rows)}
    by = defaultdict(list)
    for i, (_, _, s) in enumerate(rows):
        by[s].append(i)
    tokens = {s: sum(size[i] for i in own) for s, own in by.items()}
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}

    def weights(a):
        z = sum(x**a for x in share.values())
        return {s: x**a / z for s, x in share.items()}

    def flat(a):
        w = weights(a)
        if entropy is not None:
            return -sum(x * math.log(x) for x in w.values()) > entropy
        units = budget or max(share[s] / w[s] for s in share)
        return max(units * w[s] / share[s] for s in share) > repeats

    low, high = (0.0, 16.0) if entropy is not None else (0.0, 1.0)
    if not flat(low):
        high = low
    while high - low > 1e-9:
        middle = (low + high) / 2
        low, high = (middle, high) if flat(middle) else (low, middle)
    if found is not None:  # the last bits of an exponent decide whether a document ends a token before the budget
        assert found == pytest.approx(high, abs=1e-6)
        high = found
    w = weights(high)
    units = budget or max(share[s] / w[s] for s in share)
    copies = {}
    for s, own in by.items():
        if not tokens[s]:
            copies |= {i: 1 for i in own}
            continue
        passes, rest = divmod(math.floor(round(w[s] * units * total, 3)), tokens[s])
        blocks = -(-len(own) // block_docs)
        keys = docs.filter(F.col("source").eqNullSafe(s)).select("doc_id", F.struct(*mixing._permuted(17, F.col("source"), F.lit(blocks), F.col("doc_id"))).alias("k")).collect()
        key = {r.doc_id: tuple(r.k) for r in keys}
        groups = defaultdict(list)
        for i in own:
            groups[key[rows[i][0]]].append(i)
        open_ = True
        for k in sorted(groups):
            n = sum(size[i] for i in groups[k])
            open_ = open_ and rest > 0 and n <= rest
            rest -= n if open_ else 0
            copies |= {i: passes + open_ for i in groups[k]}
    return copies, w


@pytest.mark.parametrize("how", [{"repeats": 2.0}, {"repeats": 1.0}, {"entropy": 1.5, "budget": 2.5}, {"entropy": 0.4, "budget": 1.0}, {"entropy": 99.0, "budget": 1.0}, {"repeats": 3.0, "budget": 0.4}])
def test_copies_equal_a_plain_version(spark, sf_dir, how):
    docs, rows = documents(spark, sf_dir)
    own = {"target_entropy": how.get("entropy"), "repetition_limit": how.get("repeats"), "budget": how.get("budget"), "block_docs": 16}
    plan = mixing.mixing_plan(docs, **own)
    got = mixing.with_copies(docs, plan)
    assert got.columns == [*docs.columns, "_mix_weight", "_mix_copies"]
    got = got.collect()
    want, weights = plain(spark, docs, rows, plan.first().exponent, **how, block_docs=16)
    assert sorted(((r.doc_id, r.source, r._mix_copies) for r in got), key=repr) == sorted(((rows[i][0], rows[i][2], n) for i, n in want.items()), key=repr)
    for r in got:
        assert r._mix_weight == pytest.approx(weights.get(r.source, 0.0), abs=1e-6)
    if how.get("entropy") and 0 < plan.first().exponent < 16:
        assert -sum(w * math.log(w) for w in weights.values()) == pytest.approx(how["entropy"], abs=1e-4)


def test_mix_repeats_rows_and_keeps_columns(spark, sf_dir):
    docs, rows = documents(spark, sf_dir)
    want, _ = plain(spark, docs, rows, repeats=2.0)
    out = mixing.mix(docs, repetition_limit=2.0)
    assert out.columns == docs.columns and out.count() == sum(want.values())


def test_counts_of_a_column(spark):
    docs = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 30), (3, "c", "y", None)], "doc_id long, text string, source string, n int")
    plan = {r.source: r for r in mixing.mixing_plan(docs, repetition_limit=1.0, tokens_col="n").collect()}
    assert (plan["x"].tokens, plan["y"].tokens) == (10, 30) and plan["x"].weight == pytest.approx(0.25)


def test_empty_and_wrong(spark):
    docs = table(spark, [])
    assert mixing.mix(docs, target_entropy=1.0).count() == 0
    with pytest.raises(ValueError):
        mixing.mixing_plan(docs)
