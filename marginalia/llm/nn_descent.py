"""Embedding near-dedup by NN-descent.

Equal unit vectors are one point with a number of copies. Points are then gathered in balls: within a bucket of random hyperplanes, a vector joins a ball if its angle to the
centre is at most half the angle of the threshold. By the triangle inequality on angles all of a ball are linked with each
other, so a group of thousands of copies is one centre and a count. NN-descent then refines a neighbour graph of the
centres: from the lists of several hyperplane partitions, each centre brings its neighbours and a bounded part of its
reverse neighbours together, and pairs among them improve the lists of both. A list whose every entry is near enough to
matter is saturated, and is doubled up to ``LONGEST`` times its first length. Rounds end when few entries near enough to matter are new. What is
saturated then takes no part in the lists: the points of such balls are compared with all points, block by block, which
counts their links and passes on only as many pairs as connect the same balls.

Two balls that are neighbours are resolved exactly: by their radii where these decide, then by each member's angle to the
other centre, and member by member for what is left. So every link that is reported holds. The audit compares the links of a
fiftieth of all points with brute force over all points, apart for points with few links and with many; where the mean of
either is below the wanted recall, lists are doubled and refined again, and in the end all points are compared in blocks.

At scale: no bucket exceeds ``BUCKET`` rows (larger ones are split by hash), lists are bounded by their length, joins are
on ids of written tables. A block of ``BLOCK`` points of saturated balls takes one scan of all points; a group that no list
holds costs its size times the table's in products, but no row per pair. The audit scans all points once for each ``BLOCK`` of its queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.components import components
from marginalia.llm.shared import Scratch, lean

THRESHOLD = 0.9
LEAF = 512
BUCKET = 1024
TREES = 4
NEIGHBOURS = 12
ROUNDS = 5
CHANGED = 0.002
BEST = 3
RECALL = 0.95
AUDIT = 256
SHARE = 50
FEW = 8
CHUNK = 256
BLOCK = 4096
LONGEST = 8
_SAFE = 1e-7


def _vectors(column) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.float64) for x in column])


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for key, own in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(own)


def _out(names: list[str], kinds: list[pa.DataType]) -> Callable[[list[tuple]], pa.RecordBatch]:
    return lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, tmp: Scratch) -> DataFrame:
    """u (number of the row), id, v (unit vector in doubles; null if it can't be compared), dim."""

    @lean
    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = [], []
            for values in batch.column(1):
                x = None
                if values.is_valid and values.values.null_count == 0:
                    x = np.asarray(values.values, dtype=np.float64)
                    most = np.abs(x).max(initial=0)
                    # by the largest component first, so that no square overflows
                    x = x / most if np.isfinite(x).all() and most > 0 else None
                raw.append(None if x is None else (x / np.linalg.norm(x)).tobytes())
                dims.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], names=["id", "v", "dim"])

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return tmp.save(rows.mapInArrow(unit, "id long, v binary, dim int").withColumn("u", F.monotonically_increasing_id()), "vectors")


def _bucketed(rows: DataFrame, tree: int, bits: int, tmp: Scratch, name: str) -> DataFrame:
    """The rows (u, v, dim, ...) with dim, code and part: no (dim, code, part) has much more than BUCKET rows."""
    columns = rows.columns
    schema = rows.schema

    @lean
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.zeros(batch.num_rows, np.int64)
            dims, vs = np.asarray(batch.column("dim")), batch.column("v").to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                planes = np.random.default_rng([tree, int(d)]).normal(size=(int(d), bits))
                codes[at] = ((_vectors([vs[i] for i in at]) @ planes) > 0) @ (1 << np.arange(bits, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], names=[*columns, "code"])

    coded = tmp.save(rows.mapInArrow(code, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in schema)}, code long"), f"{name}-coded")
    parts = tmp.save(coded.groupBy("dim", "code").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).cast("long").alias("parts")), f"{name}-parts")
    return coded.join(parts, ["dim", "code"]).withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts"))).drop("parts")


def _balls(rows: DataFrame, bits: int, radius: float, tmp: Scratch) -> DataFrame:
    """u, ball (u of its centre), angle to it."""
    columns = ["dim", "code", "part", "u", "v"]
    least = np.cos(radius)
    out = _out(["u", "ball", "angle"], [pa.int64(), pa.int64(), pa.float64()])

    @lean
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_key(batches, 3):
            x, u = _vectors([r[4] for r in own]), np.array([r[3] for r in own])
            ball, angle = np.full(len(u), -1), np.zeros(len(u))
            for i in range(len(u)):
                if ball[i] < 0:
                    free = np.flatnonzero(ball < 0)
                    cosine = x[free] @ x[i]
                    mine = cosine >= least
                    ball[free[mine]], angle[free[mine]] = i, _angle(cosine[mine])
                    ball[i], angle[i] = i, 0
            yield out(list(zip(u.tolist(), u[ball].tolist(), angle.tolist(), strict=True)))

    bucketed = _bucketed(rows, 0, bits, tmp, "balls").select(*columns)
    ordered = bucketed.repartition("dim", "code", "part").sortWithinPartitions("dim", "code", "part", "u")
    return tmp.save(ordered.mapInArrow(gather, "u long, ball long, angle double"), "balls")


_EDGE = "u long, w long, cosine double, near boolean"
_EDGE_OUT = _out(["u", "w", "cosine", "near"], [pa.int64(), pa.int64(), pa.float64(), pa.bool_()])


def _best_pairs(u: np.ndarray, x: np.ndarray, r: np.ndarray, theta: float, best: int, longest: int) -> list[tuple]:
    """For each, its best others, and up to ``longest`` of those that are near enough to matter, the nearest first: no list holds more."""
    cosine = x @ x.T
    near = _angle(cosine) <= theta + r[:, None] + r[None, :] + _SAFE
    np.fill_diagonal(cosine, -2)
    np.fill_diagonal(near, False)
    most = min(max(best, min(longest, int(near.sum(axis=1).max(initial=0)))), len(u) - 1)
    if most <= 0:
        return []
    value = cosine + 4.0 * near
    top = np.argpartition(-value, most - 1, axis=1)[:, :most]
    order = np.argsort(-np.take_along_axis(value, top, axis=1), axis=1, kind="stable")
    top = np.take_along_axis(top, order, axis=1)
    keep = np.take_along_axis(near, top, axis=1) | (np.arange(most) < best)
    a, b = np.repeat(np.arange(len(u)), keep.sum(axis=1)), top[keep]
    return list(zip(u[a].tolist(), u[b].tolist(), cosine[a, b].tolist(), near[a, b].tolist(), strict=True))


def _initial(centres: DataFrame, bits: int, theta: float, k: int, longest: int, tmp: Scratch, name: str) -> DataFrame:
    @lean
    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_key(batches, 3):
            rows = _best_pairs(np.array([r[3] for r in own]), _vectors([r[4] for r in own]), np.array([r[5] for r in own]), theta, k, longest)
            if rows:
                yield _EDGE_OUT(rows)

    edges = None
    for tree in range(1, TREES + 1):
        part = _bucketed(centres.select("u", "v", "dim", "r"), tree, bits, tmp, f"{name}-tree-{tree}").select("dim", "code", "part", "u", "v", "r")
        found = part.repartition("dim", "code", "part").sortWithinPartitions("dim", "code", "part", "u").mapInArrow(inside, _EDGE)
        edges = found if edges is None else edges.union(found)
    return edges


def _lists(edges: DataFrame, sizes: DataFrame, longest: int) -> DataFrame:
    """Per centre its best k edges: u, k, list. Each task passes on ``longest`` edges of a centre at most, so a hub isn't gathered."""
    # those that are near enough to matter come first, so that a list that lacks one is full of them
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("near"), F.desc("cosine"), F.desc("w")))
    best = edges.withColumn("rank", rank).filter(F.col("rank") <= longest)
    found = best.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("near", "cosine", "w")), asc=False).alias("list"))
    return found.join(sizes, "u").select("u", "k", F.slice("list", 1, F.col("k")).alias("list"))


def _saturated() -> Column:
    return (F.size("list") >= F.col("k")) & F.forall("list", lambda e: e.near)


def _refined(lists: DataFrame, centres: DataFrame, theta: float, longest: int, tmp: Scratch, name: str) -> DataFrame:
    """One round: neighbours of neighbours, then the best of old and new."""
    ahead = lists.select("u", F.explode("list").alias("e")).select("u", "e.w", "e.cosine", "e.near")
    slot = F.pmod(F.xxhash64("u"), F.lit(NEIGHBOURS))
    back = ahead.groupBy("w", slot.alias("slot")).agg(F.max(F.struct("cosine", "u")).alias("m")).select(F.col("w").alias("u"), F.col("m.u").alias("w"))
    pairs = tmp.save(ahead.select("u", "w").union(back).union(lists.select("u", F.col("u").alias("w"))).distinct(), f"{name}-pairs")
    met = pairs.join(centres.select(F.col("u").alias("w"), "v", "r"), "w").select("u", "w", "v", "r")

    @lean
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in _by_key(batches, 1):
            x = [np.frombuffer(r[2], np.float64) for r in own]
            if len(own) > 1:  # a centre and one other at least, so each has a best
                yield _EDGE_OUT(_best_pairs(np.array([r[1] for r in own]), np.stack(x), np.array([r[3] for r in own]), theta, BEST, longest))

    new = met.repartition("u").sortWithinPartitions("u").mapInArrow(join, _EDGE)
    new = new.groupBy("u", "w").agg(F.max("cosine").alias("cosine"), F.max("near").alias("near"))
    sizes = lists.select("u", F.when(_saturated() & (F.col("k") < longest), F.col("k") * 2).otherwise(F.col("k")).alias("k"))
    # the same pair's cosine may differ in its last bits between products, so an edge is told by its ends
    edges = ahead.union(new.select("u", "w", "cosine", "near")).groupBy("u", "w").agg(F.max("cosine").alias("cosine"), F.max("near").alias("near"))
    out = tmp.save(_lists(edges, sizes, longest), f"{name}-lists")
    tmp.drop(f"{name}-pairs")
    return out


def _graph(centres: DataFrame, bits: int, theta: float, tmp: Scratch, k: int, longest: int, name: str) -> DataFrame:
    start = centres.select("u", F.lit(k).alias("k"))
    edges = _initial(centres, bits, theta, k, longest, tmp, name).groupBy("u", "w").agg(F.max("cosine").alias("cosine"), F.max("near").alias("near"))
    lists = tmp.save(_lists(edges, start, longest), f"{name}-0-lists")
    for i in range(1, ROUNDS + 1):
        after = _refined(lists, centres, theta, longest, tmp, f"{name}-{i}")
        # only entries that are near enough to matter become links
        old, new = (x.select("u", F.col("k").alias(f"{c}k"), F.transform(F.filter("list", lambda e: e.near), lambda e: e.w).alias(c)) for x, c in ((lists, "old"), (after, "new")))
        changed = new.join(old, "u", "left").agg(
            F.sum(F.size(F.array_except("new", F.coalesce("old", F.array().cast("array<long>"))))).alias("n"), F.sum(F.size("new")).alias("near"), F.sum((F.col("newk") > F.col("oldk")).cast("int")).alias("grown")
        ).first()
        lists = after
        if (changed.n or 0) <= CHANGED * (changed.near or 0) and not changed.grown:
            break
    return lists


def _resolved(pairs: DataFrame, balls: DataFrame, vectors: DataFrame, centres: DataFrame, threshold: float, tmp: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """pairs: i, j (both directions), cosine. Links of each vector beyond its ball (u, n), and balls that are linked (a, b)."""
    theta = float(np.arccos(threshold))
    c = centres.select(F.col("u").alias("c"), "r", "size")
    wide = pairs.join(c.select(F.col("c").alias("i"), F.col("r").alias("ri")), "i").join(c.select(F.col("c").alias("j"), F.col("r").alias("rj"), F.col("size").alias("nj")), "j")
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("cosine"))))
    single = (F.col("ri") == 0) & (F.col("rj") == 0)
    state = F.when(single, F.when(F.col("cosine") >= threshold, "all").otherwise("none")).when(angle + F.col("ri") + F.col("rj") <= theta - _SAFE, "all").when(angle - F.col("ri") - F.col("rj") > theta + _SAFE, "none").otherwise("some")
    wide = tmp.save(wide.withColumn("state", state).filter("state <> 'none'"), f"{name}-wide")
    members = balls.select("u", F.col("ball").alias("i"))
    alls = wide.filter("state = 'all'").groupBy("i").agg(F.sum("nj").alias("n"))
    by_ball = members.join(alls, "i").select("u", "n")
    linked = wide.filter("state = 'all'").select(F.col("i").alias("a"), F.col("j").alias("b"))

    some = wide.filter("state = 'some'").select("i", "j", "rj", "nj")
    asked = members.join(some, "i").join(vectors.select("u", "v"), "u").join(centres.select(F.col("u").alias("j"), F.col("v").alias("center")), "j")

    @lean
    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = np.array([np.dot(np.frombuffer(a, np.float64), np.frombuffer(b, np.float64)) for a, b in zip(batch.column("v").to_pylist(), batch.column("center").to_pylist(), strict=True)])
            r, angle = np.asarray(batch.column("rj")), _angle(cosine)
            state = np.where(r == 0, np.where(cosine >= threshold, 2, 0), np.where(angle + r <= theta - _SAFE, 2, np.where(angle - r > theta + _SAFE, 0, 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("u", "i", "j", "nj")), pa.array(state, pa.int64())], names=["u", "i", "j", "nj", "state"])

    asked = tmp.save(asked.select("u", "i", "j", "nj", "rj", "v", "center").mapInArrow(against, "u long, i long, j long, nj long, state long"), f"{name}-asked")
    by_centre = asked.filter("state = 2").select("u", F.col("nj").alias("n"))
    linked = linked.union(asked.filter("state = 2").select(F.col("i").alias("a"), F.col("j").alias("b")))

    open_ = asked.filter("state = 1").select("u", "i", "j").join(vectors.select("u", F.col("v").alias("x")), "u")
    there = balls.join(open_.select(F.col("j").alias("ball")).distinct(), "ball", "left_semi").join(vectors.select("u", "v", "copies"), "u")
    chunks = balls.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / F.lit(BUCKET)).alias("chunks"))
    there = there.join(chunks, "ball").withColumn("chunk", F.pmod(F.xxhash64("u"), F.col("chunks")))
    chunks = there.groupBy("ball", "chunk").agg(F.collect_list(F.struct("v", "copies")).alias("p")).select("ball", F.col("p.v").alias("vs"), F.col("p.copies").alias("copies")).withColumnRenamed("ball", "j")

    @lean
    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = zip(*(batch.column(c).to_pylist() for c in ("x", "vs", "copies")), strict=True)
            n = [int((_vectors(vs) @ np.frombuffer(x, np.float64) >= threshold) @ np.array(copies)) for x, vs, copies in own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("u", "i", "j")), pa.array(n, pa.int64())], names=["u", "i", "j", "n"])

    ones = tmp.save(open_.join(chunks, "j").select("u", "i", "j", "x", "vs", "copies").mapInArrow(one_by_one, "u long, i long, j long, n long").filter("n > 0"), f"{name}-ones")
    linked = linked.union(ones.select(F.col("i").alias("a"), F.col("j").alias("b")))
    return by_ball.union(by_centre).union(ones.select("u", "n")), linked.distinct()


def _forest(hit: np.ndarray) -> list[tuple[int, int]]:
    """Of the hits as many (row, column) as connect what all of them connect."""
    pairs, rows, columns = [], hit.any(axis=1), hit.any(axis=0)
    for start in np.flatnonzero(rows).tolist():
        todo = [start] if rows[start] else []
        rows[start] = False
        while todo:
            i = todo.pop()
            reached = np.flatnonzero(hit[i] & columns)
            if len(reached):
                columns[reached] = False
                pairs += [(i, j) for j in reached.tolist()]
                more = np.flatnonzero(rows)
                inside = hit[np.ix_(more, reached)]
                at = inside.any(axis=1)
                more, first = more[at], reached[inside[at].argmax(axis=1)]
                pairs += zip(more.tolist(), first.tolist(), strict=True)
                rows[more] = False
                todo += more.tolist()
    return pairs


def _in_blocks(members: DataFrame, hot: DataFrame, threshold: float, tmp: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """members: u, ball, v, dim, copies; hot: ball. All links beyond the own ball of which an end is in a hot ball, by comparing the
    points of these with all: their number for each point (u, n), and pairs of balls (a, b) that connect what the links connect."""
    all_ = tmp.save(members.join(hot.select("ball", F.lit(True).alias("hot")), "ball", "left").select("u", "ball", "v", "dim", "copies", F.coalesce("hot", F.lit(False)).alias("hot")), f"{name}-all")
    asked = all_.filter("hot")
    blocks = -(-asked.count() // BLOCK)
    found = None
    for k in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("u", F.lit(7)), F.lit(blocks)) == k).select("u", "ball", "v", "dim", "copies").collect()
        part = tmp.save(all_.mapInArrow(_block(own, threshold), "u long, n long, a long, b long"), f"{name}-block-{k}")
        found = part if found is None else found.union(part)
    if found is None:
        found = members.sparkSession.createDataFrame([], "u long, n long, a long, b long")
    return found.filter("u IS NOT NULL").groupBy("u").agg(F.sum("n").alias("n")), found.filter("a IS NOT NULL").select("a", "b").distinct()


def _block(own: list, threshold: float, connect: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    by_dim = {}
    for d in {q.dim for q in own}:
        of = [q for q in own if q.dim == d]
        by_dim[d] = (np.array([q.u for q in of]), np.array([q.ball for q in of]), _vectors([q.v for q in of]), np.array([q.copies for q in of], np.float64))
    out = _out(["u", "n", "a", "b"], [pa.int64()] * 4)

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {d: np.zeros(len(q[0])) for d, q in by_dim.items()}
        root: dict[int, int] = {}

        def find(i: int) -> int:
            while (up := root.get(i, i)) != i:
                root[i] = root.get(up, up)
                i = root[i]
            return i

        for batch in batches:
            u, balls, dims, copies, hot = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "ball", "dim", "copies", "hot"))
            vs, counts, links = batch.column("v"), np.zeros(batch.num_rows), []
            for d, (_, mine, x, weight) in by_dim.items():
                of = np.flatnonzero(dims == d)
                for at in np.split(of, range(CHUNK, len(of), CHUNK)):
                    if not len(at):
                        continue
                    there = _vectors([vs[i].as_py() for i in at.tolist()])
                    for low in range(0, len(mine), CHUNK * 4):
                        rows = slice(low, low + CHUNK * 4)
                        hit = x[rows] @ there.T >= threshold
                        if not hit.any():
                            continue
                        hit &= mine[rows, None] != balls[None, at]
                        number = hit.astype(np.float64)
                        totals[d][rows] += number @ copies[at]
                        counts[at] += weight[rows] @ number
                        if connect:
                            for i, j in _forest(hit):
                                a, b = find(int(mine[low + i])), find(int(balls[at[j]]))
                                if a != b:
                                    root[max(a, b)] = min(a, b)
                                    links.append((None, None, int(mine[low + i]), int(balls[at[j]])))
            # hot points are counted as those that ask
            cold = np.flatnonzero(~hot & (counts > 0))
            rows = [(a, b, None, None) for a, b in zip(u[cold].tolist(), counts[cold].astype(np.int64).tolist(), strict=True)] + links
            if rows:
                yield out(rows)
        for d, (asked, *_) in by_dim.items():
            at = np.flatnonzero(totals[d])
            if len(at):
                yield out([(a, b, None, None) for a, b in zip(asked[at].tolist(), totals[d][at].astype(np.int64).tolist(), strict=True)])

    return compare


def _sample(members: DataFrame, tmp: Scratch) -> DataFrame:
    """A share of all points, at least AUDIT where there are as many."""
    share = members.filter(F.pmod(F.xxhash64("u"), F.lit(SHARE)) == 0)
    least = members.orderBy(F.xxhash64("u"), "u").limit(AUDIT)
    return tmp.save(share.union(least).distinct(), "audit-sample")


def _true(sample: DataFrame, members: DataFrame, threshold: float, tmp: Scratch) -> DataFrame:
    """Of each asked point the number of its links beyond its ball, by comparing it with all points: u, links."""
    blocks = -(-sample.count() // BLOCK)
    found = None
    # none of the others is counted
    all_ = members.withColumn("hot", F.lit(True))
    for k in range(blocks):
        own = sample.filter(F.pmod(F.xxhash64("u", F.lit(7)), F.lit(blocks)) == k).collect()
        part = tmp.save(all_.mapInArrow(_block(own, threshold, connect=False), "u long, n long, a long, b long"), f"audit-block-{k}")
        found = part if found is None else found.union(part)
    if found is None:
        return members.sparkSession.createDataFrame([], "u long, links long")
    return tmp.save(found.groupBy("u").agg(F.sum("n").alias("links")), "audit-true")


def _audit(found: DataFrame, true: DataFrame) -> float:
    """The mean over points of the share of their links (u, n) beyond their balls that was found, for points with at most FEW links or
    for those with more, where it is less; 1 without links."""
    share = F.least(F.coalesce("n", F.lit(0)), F.col("links")) / F.col("links")
    means = true.filter("links > 0").join(found, "u", "left").groupBy(F.col("links") <= FEW).agg(F.avg(share).alias("recall")).collect()
    return min((m.recall for m in means), default=1.0)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept (it is its own).

    Rows link if their cosine is at least the threshold. Vectors that are null, empty or zero, or hold null or non-finite
    components link with nothing, and neither do vectors with different numbers of components. Equal vectors and repeated rows
    are linked with each other. Null ids are never the smallest unless all of a component are null; such a row is kept if
    its component is null. Other columns are ignored; an empty table gives an empty result.
    """
    tmp = Scratch(vectors.sparkSession, "nn-descent")
    rows = _prepared(vectors, id_col, vector_col, tmp)
    usable = rows.filter("v IS NOT NULL").select("u", "v", "dim")
    points = tmp.save(usable.groupBy("v", "dim").agg(F.min("u").alias("u"), F.count(F.lit(1)).alias("copies")).select("u", "v", "dim", "copies"), "points")
    count = points.count()
    bits = max(1, int(np.ceil(np.log2(max(2, count / LEAF)))))
    theta = float(np.arccos(threshold))
    balls = _balls(points.select("u", "v", "dim"), bits, theta / 2 - 1e-3, tmp)
    members = tmp.save(balls.join(points, "u"), "members")
    stats = members.groupBy("ball").agg(F.max("angle").alias("r"), F.sum("copies").alias("size")).withColumnRenamed("ball", "u")
    centres = tmp.save(stats.join(points.select("u", "v", "dim"), "u"), "centres")
    k, every = neighbours, False
    true = _true(_sample(members, tmp), members, threshold, tmp)
    while True:
        # where the longest lists fall short, all are compared in blocks
        lists = lists.limit(0) if every else _graph(centres, bits, theta, tmp, k, LONGEST * neighbours, f"k{k}")
        hot = centres if every else lists.filter(_saturated())
        hot = tmp.save(hot.select(F.col("u").alias("ball")), f"k{k}-hot")
        near = lists.select("u", F.explode("list").alias("e")).filter("e.near").select("u", "e.w", "e.cosine")
        both = near.union(near.select(F.col("w").alias("u"), F.col("u").alias("w"), "cosine")).groupBy(F.col("u").alias("i"), F.col("w").alias("j")).agg(F.max("cosine").alias("cosine"))
        both = both.join(hot.withColumnRenamed("ball", "i"), "i", "left_anti").join(hot.withColumnRenamed("ball", "j"), "j", "left_anti").select("i", "j", "cosine")
        outside, linked = _resolved(tmp.save(both, f"k{k}-near"), balls, points, centres, threshold, tmp, f"k{k}")
        more, connected = _in_blocks(members, hot, threshold, tmp, f"k{k}-hot")
        outside, linked = outside.union(more), linked.union(connected)
        outside = tmp.save(outside.groupBy("u").agg(F.sum("n").alias("n")), f"k{k}-outside")
        inside = balls.join(centres.select(F.col("u").alias("ball"), "size"), "ball")
        links = inside.join(outside, "u", "left").select("u", "ball", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).cast("long").alias("n_links"))
        links = tmp.save(links, f"k{k}-links")
        if every or _audit(outside, true) >= RECALL:
            break
        every, k = k >= LONGEST * neighbours, k * 2
    reached = components(tmp.save(linked, f"k{k}-linked"), tmp, "balls-reached")
    placed = links.join(reached, F.col("ball") == F.col("node"), "left").select("u", "n_links", F.coalesce("root", "ball").alias("root"))
    first = points.filter("copies > 1").select("v", F.col("u").alias("p"))
    point = usable.join(first, "v", "left").select("u", F.coalesce("p", "u").alias("p"))
    placed = point.join(placed.withColumnRenamed("u", "p"), "p").select("u", "n_links", "root")
    placed = tmp.save(rows.select("u", "id").join(placed, "u", "left").select("u", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "root"), "placed")
    least = tmp.save(placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("component_id")), "least")
    out = placed.join(least, "root", "left").select("id", "n_links", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumnRenamed("id", id_col)
