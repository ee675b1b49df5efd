"""Hard-negative mining by a Voronoi-partitioned, distributed, exact nearest-neighbour join.

The largest inner product is made the smallest distance: every row gets one more component, sqrt(M^2 - |y|^2) with M the
largest norm, and every anchor a zero, so that d(a, y)^2 = |a|^2 + M^2 - 2 <a, y>. Rows belong to the nearest of a few
pivots. Anchors are dealt into groups of neighbouring cells, and what a group still needs, a distance from each anchor,
bounds by the triangle inequality at which distances from a cell's pivot a row might serve it. Rows are copied only to such
groups; there they meet the anchors in chunks, and what each chunk finds is merged by rank.

Two joins give the positives: the first meets each group with its own cells, and its k-th scores bound the second with all
others. The positives' scores bound a third join, for the negatives, from both sides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Shared, give_back

PIVOTS = 32
GROUP_ANCHORS = 1024
#: Rows that a group's anchors meet in one task, about.
CHUNK_ROWS = 50_000
#: Entries (group, cell) up to which the bounds are broadcast; they are counted.
FEW_BOUNDS = 1_000_000
SLACK = 1e-9


def whole_components(vector: Column, scale: int = 256) -> Column:
    """The components' floor(scale * x), or null if the vector or any component is null or not finite."""
    fine = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


class Space:
    """The pivots and the bounds of all rows: the largest squared norm and the most components."""

    def __init__(self, most: int, width: int, pivots: list[list[int]]):
        self.most, self.width = most, width
        self.exact = np.float64 if most < 2**53 else np.int64
        flat = np.array([[*p, *[0] * (width - len(p))] for p in pivots], dtype=np.float64).reshape(len(pivots), width)
        self.pivots = np.column_stack((flat, self.lift((flat * flat).sum(axis=1))))

    def lift(self, squares: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - squares, 0))

    def matrix(self, column: pa.ChunkedArray | pa.Array) -> np.ndarray:
        """Vectors as rows, shorter ones filled up with zeros; products of such numbers and their sums are exact."""
        out = np.zeros((len(column), self.width), dtype=self.exact)
        for n, v in enumerate(column):
            x = v.values.to_numpy(zero_copy_only=False)
            out[n, : len(x)] = x
        return out

    def to_pivots(self, vectors: np.ndarray, anchors: bool) -> np.ndarray:
        """Distances from each pivot."""
        v = vectors.astype(np.float64)
        squares = (v * v).sum(axis=1)
        lifted = np.zeros(len(v)) if anchors else self.lift(squares)
        v = np.column_stack((v, lifted))
        return np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + (self.pivots * self.pivots).sum(axis=1) - 2 * v @ self.pivots.T, 0))

    def distance(self, square: np.ndarray, score: np.ndarray) -> np.ndarray:
        """How far from an anchor of this squared norm a row of this score is."""
        return np.sqrt(np.maximum(square + self.most - 2.0 * score, 0))


def place(rows: DataFrame, shared: Shared) -> DataFrame:
    """Adds cell, the nearest pivot, and away, the distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            d = space.to_pivots(space.matrix(b.column("vector")), anchors=False)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell], pa.float64())], [*b.schema.names, "cell", "away"])

    return rows.mapInArrow(run, "uid long, id long, label long, anchor boolean, vector array<long>, cell int, away double")


def groups_of_cells(counts: dict[int, int], most: int) -> list[tuple[int, int, int]]:
    """(cell, first group, number of groups): neighbouring cells share a group until it has `most` anchors; a cell with more
    has several. Cells without anchors have none."""
    out, group, room = [], -1, 0
    for cell, n in sorted(counts.items()):
        if n > most:
            splits = -(-n // most)
            out.append((cell, group + 1, splits))
            group, room = group + splits, 0
            continue
        if n > room:
            group, room = group + 1, most
        out.append((cell, group, 1))
        room -= n
    return out


def bounds(anchors: DataFrame, shared: Shared) -> DataFrame:
    """(group, cell, low, high): from what least to what largest distance from its pivot a cell's row might serve a group of
    anchors(group, vector, least, most), which look for scores between `least` (null: any) and `most` (null: any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for b in batches:
            v = space.matrix(b.column("vector")).astype(np.float64)
            square, d = (v * v).sum(axis=1), space.to_pivots(v, anchors=True)
            least, most = (np.array([np.nan if x is None else float(x) for x in b.column(c).to_pylist()]) for c in ("least", "most"))
            far = np.where(np.isnan(least), np.inf, space.distance(square, np.nan_to_num(least)))[:, None]
            near = np.where(np.isnan(most), 0, space.distance(square, np.nan_to_num(most)))[:, None]
            slack = SLACK * (1 + space.most)
            low, high = np.maximum(d - far, near - d) - slack, d + far + slack
            n, k = d.shape
            group = np.repeat(b.column("group").to_numpy(zero_copy_only=False), k)
            yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(np.tile(np.arange(k), n), pa.int32()), pa.array(low.ravel()), pa.array(high.ravel())], ["group", "cell", "low", "high"])

    each = anchors.select("group", "vector", "least", "most").mapInArrow(run, "group long, cell int, low double, high double")
    return each.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def routed(rows: DataFrame, limits: DataFrame, few: bool) -> DataFrame:
    """The rows with each group that limits(group, cell, low, high) lets them serve."""
    by_cell = limits.groupBy("cell").agg(F.collect_list(F.struct("group", "low", "high")).alias("limits"))
    met = rows.join(F.broadcast(by_cell) if few else by_cell, "cell")
    serves = F.filter("limits", lambda g: (g["low"] <= F.col("away")) & (F.col("away") <= g["high"]))
    return met.select("uid", "id", "label", "vector", F.explode(F.transform(serves, lambda g: g["group"])).alias("group"))


def meet(rows: DataFrame, anchors: DataFrame, chunks: int, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """What the kernel finds for each group's anchors among each chunk of its rows."""
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("uid"), F.lit(chunks)))
    copies = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    return copies.groupBy("group", "chunk").cogroup(dealt.groupBy("group", "chunk")).applyInArrow(kernel, schema)


def first(scores: np.ndarray, rows: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """The k of the rows with the highest scores, equal ones by id."""
    s = scores[rows]
    if len(rows) > k:
        rows = rows[s >= np.partition(s, len(s) - k)[len(s) - k]]
    return rows[np.lexsort((uids[rows], ids[rows], -scores[rows]))[:k]]


def finder(shared: Shared, pick: Callable, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A kernel: `pick` gives for an anchor (as a dict) and the scores, labels, ids and uids of a chunk's rows the lists of what
    it takes, each with what stands before it in the output."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        space, out = shared.value, []
        label, ids, uids = (rows.column(c).to_numpy() for c in ("label", "id", "uid"))
        theirs = space.matrix(rows.column("vector")).T if len(rows) else None
        about = anchors.drop_columns(["vector"]).to_pylist() if len(rows) else []
        for at in range(0, len(about), 64):
            scores = space.matrix(anchors.column("vector").slice(at, 64)) @ theirs
            for a, s in zip(about[at : at + 64], scores):
                for start, taken in pick(a, s, label, ids, uids):
                    out.extend((a["uid"], a["id"], *start, int(uids[r]), int(ids[r]), int(s[r])) for r in taken)
        give_back()
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*out) if out else [()] * len(names))], names=names)

    return run


def ranked(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first k of what the chunks found, by score and id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "found_id", "found_uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = PIVOTS, group_anchors: int = GROUP_ANCHORS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows(id, label, vector, anchor). Scores
    are inner products of whole numbers. An anchor's positives are the `positives` other rows of its label with the highest
    scores; for each of them the first `negatives` rows of other labels follow whose score is low to high hundredths of the
    positive's. Higher scores come first, equal ones by smaller id.

    Rows with a null id, label or vector, or of a squared norm of 2^62 or more, whose scores fit no long, take no part. Missing
    components are zeros. Rows are rows: one that repeats an id is another row with that id, and a repeated anchor is mined
    again. A positive of a negative score has no negatives. Anchors without a positive, or without a negative in range, give
    no row, nor does an empty table. Other columns are not read."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "negatives")
    size = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    part = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.col("vector").cast("array<long>").alias("vector"))
    part = part.where("id is not null and label is not null and vector is not null").where(size < 2.0**62)
    plain = scratch.table(part.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "label", "anchor", "vector"), "plain")
    n, most, width = plain.agg(F.count("*"), F.coalesce(F.max(size), F.lit(0.0)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    chosen = [r.vector for r in plain.orderBy(F.xxhash64("id"), "uid").limit(pivots).collect()]
    shared = Shared(spark, Space(int(most), width, chosen or [[]]))
    placed = scratch.table(place(plain, shared), "placed")
    scratch.drop("plain")

    cells = groups_of_cells({r.cell: r["count"] for r in placed.where("anchor").groupBy("cell").count().collect()}, group_anchors)
    homes = F.broadcast(spark.createDataFrame(cells, "cell int, first_group long, splits long"))  # a row a cell
    chunks = max(1, -(-n // chunk_rows))
    few = sum(s for _, _, s in cells) * pivots <= FEW_BOUNDS
    dealt = placed.where("anchor").join(homes, "cell")
    anchors = scratch.table(dealt.select("uid", "id", "label", "vector", (F.col("first_group") + F.pmod(F.xxhash64("uid"), F.col("splits"))).alias("group")), "anchors")

    def same_label(a, s, label, ids, uids):
        return [((), first(s, np.flatnonzero((label == a["label"]) & (uids != a["uid"])), ids, uids, positives))]

    names = ["uid", "anchor_id", "found_uid", "found_id", "score"]
    schema = ", ".join(f"{c} long" for c in names)
    own = placed.join(homes, "cell").select("uid", "id", "label", "vector", F.explode(F.expr("sequence(first_group, first_group + splits - 1)")).alias("group"))
    near = scratch.table(meet(own, anchors, chunks, finder(shared, same_label, names), schema), "near")
    so_far = ranked(near, ["uid"], positives).groupBy("uid").agg(F.when(F.count("*") == positives, F.min("score")).alias("least"))
    limits = bounds(anchors.join(so_far, "uid", "left").withColumn("most", F.lit(None).cast("long")), shared)
    at_home = homes.select("cell", F.explode(F.expr("sequence(first_group, first_group + splits - 1)")).alias("group"))
    far = meet(routed(placed, limits.join(at_home, ["cell", "group"], "left_anti"), few), anchors, chunks, finder(shared, same_label, names), schema)
    best = scratch.table(ranked(near.unionByName(far), ["uid"], positives), "best")

    def in_range(a, s, label, ids, uids):
        rest = np.flatnonzero((label != a["label"]) & (s <= a["most"]) & (s >= a["least"]))
        for p in a["scores"]:
            # 100 * s in Python's integers where a long would not hold it
            at_least, at_most = -(-low * p // 100), high * p // 100
            yield (p,), first(s, rest[(s[rest] >= at_least) & (s[rest] <= at_most)], ids, uids, negatives)

    asked = best.where("score >= 0").groupBy("uid").agg(F.collect_set("score").alias("scores"))
    limit = lambda score, share, up: F.expr(f"cast((cast({share} as decimal(20,0)) * {score} + {99 if up else 0}) div 100 as long)")
    looking = anchors.join(asked, "uid").select("*", limit("array_min(scores)", low, True).alias("least"), limit("array_max(scores)", high, False).alias("most"))
    looking = scratch.table(looking, "looking")
    names = ["uid", "anchor_id", "positive_score", "found_uid", "found_id", "score"]
    found = meet(routed(placed, bounds(looking, shared), few), looking, chunks, finder(shared, in_range, names), ", ".join(f"{c} long" for c in names))
    mined = ranked(found, ["uid", "positive_score"], negatives).select("uid", "positive_score", "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = best.select("uid", "anchor_id", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(mined, ["uid", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
