"""Mixing sources to target weights: temperature mixing.

Each source's share of all tokens is raised to an exponent and normalised. The exponent is bisected until the weights
have the wanted entropy, or until no source is repeated more often than allowed. A source's weight times the budget
is the number of tokens that it may give: whole passes over it, then a part of one more. In that part, blocks of
documents come in a pseudo-random permutation, and the part ends where the budget does.

At scale: token counts are taken in one pass and summed per source before any shuffle. The place where a source's part
ends is found by descent: a window over at most 4,096 bucket sums a source, then over the blocks of one bucket, then
over the documents of one block, so a source with a third of all rows is never in one task. The result is one cut
per source; documents compare their own key with it, and need no other shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch, text_of

BLOCK_DOCS = 256
BUCKET_BITS = 12
GRID = 64


def token_count(text: Column) -> Column:
    """Tokens are maximal runs of characters other than white space."""
    return F.regexp_count(text, F.lit("\\S+")).cast("long")


def _permuted(seed: int, source: Column, blocks: Column, doc_id: Column) -> list[Column]:
    """A document's block, the block's place in the permutation and the document's place in its block."""
    block = F.pmod(F.xxhash64(F.lit(seed), doc_id), blocks)
    place = F.xxhash64(F.lit(seed + 1), source, block)
    return [F.shiftrightunsigned(place, 64 - BUCKET_BITS).alias("bucket"), place.alias("place"), F.xxhash64(F.lit(seed + 2), doc_id).alias("within")]


def _bisect(shares: DataFrame, entropy: float | None, repeats: float | None, budget: float | None) -> tuple[float, float, float]:
    """The exponent, the sum of the shares' powers, and the budget in units of all tokens. One job tries GRID exponents at once."""

    def at(exponents: list[float]) -> list:
        each = shares.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        p = F.pow("share", "a")
        got = each.groupBy("a").agg(F.sum(p).alias("z"), F.sum(p * F.log(p)).alias("pl"), F.min(p / F.col("share")).alias("low"), F.max(p / F.col("share")).alias("high"))
        return sorted(got.collect())

    if shares.isEmpty():
        return 1.0, 1.0, 1.0

    def too_flat(row) -> bool:
        if entropy is not None:
            return math.log(row.z) - row.pl / row.z > entropy
        passes = row.high / row.low if budget is None else budget * row.high / row.z
        return passes > repeats

    low, high = (0.0, 16.0) if entropy is not None else (0.0, 1.0)
    if not too_flat(at([low])[0]):
        high = low
    while high - low > 1e-9:
        rows = at([low + (high - low) * k / GRID for k in range(1, GRID)])
        flat = [r.a for r in rows if too_flat(r)]
        low = max([low, *flat])
        high = min([high, *(r.a for r in rows if r.a > low)])
    row = at([high])[0]
    return high, row.z, budget if budget is not None else row.z / row.low


def mixing_plan(
    docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", *,
    target_entropy: float | None = None, repetition_limit: float | None = None, budget: float | None = None, seed: int = 17, block_docs: int = BLOCK_DOCS,
    tokens_col: str | None = None,
) -> DataFrame:
    """Per source: tokens, share, weight, budget_tokens, passes (whole ones) and the cut of the last, partial pass.

    Give ``target_entropy`` (nats) or ``repetition_limit`` (passes over a source at most, 1 or more). ``budget`` is in units of
    all tokens; without it, the budget is the smallest that passes over each source once in full, so nothing is lost.
    Tokens are runs of characters other than white space, or as ``tokens_col`` counts them (null: 0).
    Null is a source of its own. Null texts are empty. A source without tokens has weight 0 and takes one pass, which
    costs nothing. An entropy beyond what exponents of 0 to 16 reach gives the nearest one reached.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give target_entropy or repetition_limit")
    tmp = Scratch(docs.sparkSession, "mixing")
    tokens = token_count(text_of(text_col)) if tokens_col is None else F.coalesce(F.col(tokens_col), F.lit(0))
    rows = tmp.save(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("id"), tokens.cast("long").alias("tokens")), "rows")
    sums = tmp.save(rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "sums")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.filter("tokens > 0").select((F.col("tokens") / F.lit(float(total or 1))).alias("share"))
    exponent, z, units = _bisect(shares, target_entropy, repetition_limit, budget)

    share = F.col("tokens") / F.lit(float(total or 1))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(exponent)) / F.lit(z)).otherwise(0.0)
    plan = sums.select(
        "source", "docs", "tokens", share.alias("share"), weight.alias("weight"),
        # rounding to a thousandth of a token first keeps a whole pass whole
        F.floor(F.round(weight * F.lit(units * total), 3)).cast("long").alias("budget_tokens"),
        F.ceil(F.col("docs") / F.lit(block_docs)).cast("long").alias("blocks"), F.lit(exponent).alias("exponent"),
    )
    none = F.col("tokens") == 0
    plan = plan.withColumn("passes", F.when(none, F.lit(1)).otherwise(F.expr("budget_tokens div tokens")).cast("long"))
    plan = plan.withColumn("rest", F.when(none, F.lit(0)).otherwise(F.col("budget_tokens") - F.col("passes") * F.col("tokens")).cast("long"))
    plan = tmp.save(plan, "plan")

    placed = rows.join(plan.select(F.col("source").alias("s"), "blocks", "rest"), F.col("source").eqNullSafe(F.col("s"))).filter("rest > 0")
    placed = placed.select("source", "tokens", "rest", *_permuted(seed, F.col("source"), F.col("blocks"), F.col("id")))
    sums_in = tmp.save(placed.groupBy("source", "rest", "bucket").agg(F.sum("tokens").alias("tokens")), "buckets")
    cut = _first_over(sums_in, "bucket")
    cut = tmp.save(cut, "cut-buckets")
    inside = _inside(placed, cut, ["bucket"])
    blocks = tmp.save(inside.groupBy("source", F.col("left").alias("rest"), "bucket", "place").agg(F.sum("tokens").alias("tokens")), "blocks")
    cut = tmp.save(_first_over(blocks, "place", ["bucket"]), "cut-blocks")
    inside = _inside(placed, cut, ["bucket", "place"])
    within = tmp.save(inside.groupBy("source", F.col("left").alias("rest"), "bucket", "place", "within").agg(F.sum("tokens").alias("tokens")), "within")
    cut = tmp.save(_first_over(within, "within", ["bucket", "place"]), "cut-docs")
    cut = cut.select(F.col("source").alias("s"), F.struct("bucket", "place", "within").alias("cut"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    out = tmp.save(plan, "result")
    tmp.drop("rows", "buckets", "blocks", "within")
    return out


def _first_over(sums: DataFrame, by: str, keep: list[str] | None = None) -> DataFrame:
    """Per source the first entry with which the running sum goes beyond the rest, and what is left of the rest before it."""
    w = Window.partitionBy("source").orderBy(by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("sum", F.sum("tokens").over(w)).filter("sum > rest")
    before = F.min_by(F.col("rest") - (F.col("sum") - F.col("tokens")), F.col(by)).alias("left")
    return run.groupBy("source").agg(*(F.min_by(c, by).alias(c) for c in keep or []), F.min(by).alias(by), before)


def _inside(placed: DataFrame, cut: DataFrame, keys: list[str]) -> DataFrame:
    right = cut.select(F.col("source").alias("s"), *(F.col(k).alias(f"_{k}") for k in keys), "left")
    same = F.col("source").eqNullSafe(F.col("s"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return placed.join(right, same).select(*placed.columns, "left")


def with_copies(docs: DataFrame, plan: DataFrame, source_col: str = "source", id_col: str = "doc_id", *, seed: int = 17) -> DataFrame:
    """The documents with ``_mix_weight``, the weight of its source, and ``_mix_copies``, how often each is passed over: the source's whole
    passes, and one more before the cut. Rows with equal ids and sources are passed over equally often. Columns of documents may
    have any name that doesn't begin with ``_mix_``."""
    right = plan.select(*(F.col(c).alias(f"_mix_{c}") for c in ("source", "blocks", "passes", "cut", "rest", "weight")))
    joined = docs.join(right, F.col(source_col).eqNullSafe(F.col("_mix_source")), "left")
    mine = F.struct(*_permuted(seed, F.col(source_col), F.col("_mix_blocks"), F.col(id_col)))
    more = (F.col("_mix_rest") > 0) & (F.col("_mix_cut").isNull() | (mine < F.col("_mix_cut")))
    copies = F.col("_mix_passes") + F.when(more, 1).otherwise(0)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), "_mix_weight", copies.alias("_mix_copies"))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents, each as often as its source's budget passes over it; same columns."""
    plan = mixing_plan(docs, source_col, id_col, text_col, **how)
    out = with_copies(docs, plan, source_col, id_col, seed=how.get("seed", 17)).filter("_mix_copies > 0")
    return out.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
