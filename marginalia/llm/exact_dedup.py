"""Exact dedup by deterministic block naming (Karp, Miller and Rosenberg's naming, on a cluster).

Every text is cut into blocks of a fixed number of characters. The distinct blocks are sorted and numbered: that is a
block's name. Then, level by level, each pair of neighbouring names is named in the same way, until every document
has one name. Two documents have the same (level, name) exactly if their texts are identical: no step trusts a hash.

Where rows look up a name, they carry a 128-bit key in place of the block. Before that, the key is proven to be
injective on the blocks of this very corpus; if it isn't, another seed is tried.

At scale: block contents are shuffled once, after each task has combined its own repetitions, so a block that a third
of the corpus shares costs one row a task. All later shuffles move ids only. Both sides of each look-up are plain
exchanges over written tables, which adaptive execution splits where one name is hot. There are about
log2(longest text / block) levels, and rows leave the loop at the level at which their document has its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm.shared import Scratch, text_of

BLOCK_CHARS = 4096
_NO_NEIGHBOUR = -1


def _blocks(text: Column, block_chars: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.length(text) > 0, found).otherwise(F.array(F.lit("")))


def _key(block: Column, seed: int) -> list[Column]:
    return [F.xxhash64(block).alias("k1"), F.xxhash64(F.lit(seed), block).alias("k2")]


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; null counts as empty, and empty texts equal each other. Of equal texts the row with
    the largest id stays. A null id is smaller than any other. Of repeated rows (same id and text) each is returned,
    group_size counts each, and one of them is kept. An empty table gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    tmp = Scratch(spark, "exact-dedup")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    blocks = _blocks(F.col("text"), block_chars)

    contents = rows.select(F.explode(blocks).alias("block")).distinct()
    seed, names = 1, None
    while names is None:
        named = contents.sortWithinPartitions("block").select(*_key(F.col("block"), seed), F.monotonically_increasing_id().alias("name"))
        named = tmp.save(named, f"names-{seed}")
        if named.groupBy("k1", "k2").count().filter("count > 1").isEmpty():
            names = named
        else:
            seed += 1

    keyed = F.transform(blocks, lambda b: F.struct(*_key(b, seed)))
    parts = (
        rows.select("id", F.sha2("text", 256).alias("sha"), keyed.alias("keys"))
        .select("id", "sha", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key"))
        .groupBy("id", "sha", "n", "pos", "key.k1", "key.k2")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    parts = tmp.save(parts, "parts")
    most = parts.agg(F.max("n")).first()[0] or 1
    current, on, level, done = parts, ["k1", "k2"], 0, []
    while True:
        joined = current.join(names, on)
        done.append(joined.filter("n = 1").select("id", "sha", "copies", F.lit(level).alias("level"), "name"))
        if most == 1:
            break
        even = F.col("pos") % 2 == 0
        pairs = (
            joined.filter("n > 1")
            .groupBy("id", "sha", "copies", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_NO_NEIGHBOUR)).alias("b"))
        )
        current = tmp.save(pairs, f"pairs-{level}")
        level += 1
        names = tmp.save(current.select("a", "b").distinct().sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()), f"pair-names-{level}")
        on, most = ["a", "b"], (most + 1) // 2

    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    whole = tmp.save(whole, "identities")
    groups = tmp.save(whole.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size")), "groups")
    out = whole.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), F.col("sha").alias("text_sha256")
    )
    return out.select(id_col, "keep_id", "group_size", (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that ``exact_groups`` keeps, with all their columns; of repeated rows, one."""
    kept = exact_groups(docs, id_col, text_col, block_chars).filter("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    tmp = Scratch(docs.sparkSession, "exact-kept")
    kept = tmp.save(kept, "kept")
    same = F.col(id_col).eqNullSafe(F.col("_kept_id")) & (F.sha2(text_of(text_col), 256) == F.col("_kept_sha"))
    out = docs.join(kept, same, "left_semi")
    ids = docs.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.coalesce(F.col(id_col).cast("string"), F.lit("")))).first()
    return out if ids[0] == ids[1] else out.dropDuplicates([id_col, text_col])
