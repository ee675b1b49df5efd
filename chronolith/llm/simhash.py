"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A pair of fingerprints of n bytes that differs in at most r < n bits shares at least n - r positional bytes. By the
pigeonhole principle a pair that shares t bytes shares at least k <= t among any n - t + k positions, so the index has
one posting for each choice of k of so many positions: no pair that shares t bytes is missed, and a posting list holds
about N / 256^k fingerprints instead of N / 256. Within a posting list the shared positional bytes of each pair are
tallied, pairs below t are dropped, and the rest is verified by Hamming distance.

Exact copies meet before the index (one row for each distinct fingerprint), and posting lists return what their links
connect, as one edge from each fingerprint to the least it reaches, not all pairs; reachability is the same.

With at most 7 differing bits of 64, t = 8 - r is guaranteed. A word-shingle similarity of 0.8 is an angle of 0.15 pi, beyond
what bytes can guarantee: see jaccard.py, which finds by other postings the pairs that the index does not, and verifies all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, byte_column, components, default_parallelism

SEED = 42
CHUNK, SHORT = 1 << 16, 32


@dataclass(frozen=True)
class Plan:
    """lanes of 64 bits; links within `bits`; `least` positional bytes shared among the first `positions` (0: postings
    come from elsewhere, and only the bits count); postings for each choice of `width` of them."""

    lanes: int
    bits: int
    positions: int
    least: int
    width: int

    @staticmethod
    def guaranteed(bits: int) -> Plan:
        if not 0 <= bits <= 7:
            raise ValueError("bits must be 0..7: beyond that no shared byte is guaranteed")
        return Plan(1, bits, 8, 8 - bits, min(8 - bits, 3 if bits <= 5 else 2))

    def combos(self) -> list[tuple[int, ...]]:
        return list(combinations(range(self.positions - self.least + self.width), self.width))


def bits_of(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """`lanes` unsigned 64-bit integers: a bit is 1 if it is set in over half the hashes. The first lane counts the
    hashes themselves, the others what is derived from them."""
    on = np.zeros((lanes, 64), dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK]
        for lane in range(lanes):
            if lane:
                h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                h ^= h >> np.uint64(31)
            on[lane] += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(on * 2 > len(hashes), axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(data: bytes, words: int) -> int:
    """The fingerprint of one text (0 for a text without words)."""
    tokens = data.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        starts, ends = [0], [len(joined)]
    else:
        stop = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        starts = np.concatenate(([0], stop[:-1] + 1))[: len(tokens) - words + 1].tolist()
        ends = stop[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return int(bits_of(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(starts)))[0])


def names(lanes: int, prefix: str = "f") -> list[str]:
    return [f"{prefix}{n}" for n in range(lanes)]


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, f0 long) for each row; null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x, words) for x in byte_column(b, "text")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").cast(pa.int64()), pa.array(fps)], ["id", "f0"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, f0 long")


def near(a: np.ndarray, b: np.ndarray, plan: Plan) -> np.ndarray:
    """near[i, j]: row i of a and row j of b share enough positional bytes and are within the bits."""
    if not plan.least:
        return sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]).astype(np.int16) for k in range(plan.lanes)) <= plan.bits
    x, y = (v.view(np.uint8).reshape(len(v), 8 * plan.lanes) for v in (a, b))
    tally = np.zeros((len(a), len(b)), dtype=np.uint8)
    for p in range(plan.positions):
        tally += x[:, p, None] == y[None, :, p]
    out = tally >= plan.least
    i, j = np.nonzero(out)
    out[i, j] = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= plan.bits
    return out


def contract(i: np.ndarray, j: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of edges (i, j) those, between labels, that join what label has apart; and the new label."""
    low, high, li, lj = [], [], label[i], label[j]
    while (open_ := li != lj).any():
        lo, hi = np.minimum(li[open_], lj[open_]), np.maximum(li[open_], lj[open_])
        hi, first = np.unique(hi, return_index=True)
        lo = lo[first]
        low.append(lo)
        high.append(hi)
        to = np.arange(len(label))
        to[hi] = lo
        while (to[to] != to).any():
            to = to[to]
        label, li, lj = to[label], to[li], to[lj]
    return low, high, label


def small_lists(x: np.ndarray, keys: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of spanning forests of many short posting lists at once: rows of one key stand together."""
    bytes_of, found_i, found_j = x.view(np.uint8).reshape(len(x), 8 * plan.lanes)[:, : plan.positions], [], []
    for d in range(1, len(x)):
        i = np.flatnonzero(keys[d:] == keys[:-d])
        if not len(i):
            break
        i = i[np.bitwise_count(x[i] ^ x[i + d]).sum(axis=1, dtype=np.int64) <= plan.bits]
        i = i[(bytes_of[i] == bytes_of[i + d]).sum(axis=1) >= plan.least]
        found_i.append(i)
        found_j.append(i + d)
    none = np.zeros(0, np.int64)
    low, high, _ = contract(np.concatenate([none, *found_i]), np.concatenate([none, *found_j]), np.arange(len(x)))
    return np.concatenate([none, *low]), np.concatenate([none, *high])


def forest(x: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest of the links within x[m, lanes].

    Large groups are walked breadth first, each reached row against the rows not reached yet, which takes about m
    steps where one group holds most of the list; once a walk reaches few rows, all pairs of what is left are tallied."""
    left, pairs_i, pairs_j = np.arange(len(x)), [], []
    while len(left) > 256:
        front, left, before = left[:1], left[1:], len(left)
        while len(front) and len(left):
            step = max(1, 1_000_000 // len(left))
            some, front = front[:step], front[step:]
            hit = near(x[some], x[left], plan)
            on = hit.any(axis=0)
            pairs_i.append(some[hit[:, on].argmax(axis=0)])
            pairs_j.append(left[on])
            front, left = np.concatenate((front, left[on])), left[~on]
        if before - len(left) < before // 16:
            break
    label, step = np.arange(len(left)), max(1, 1_000_000 // max(len(left), 1))
    rest = x[left]
    for a in range(0, len(left), step):
        i, j = np.nonzero(near(rest[a : a + step], rest[a + 1 :], plan))
        i, j = i + a, j + a + 1
        keep = j > i
        low, high, label = contract(i[keep], j[keep], label)  # what is joined already needs no more edges
        pairs_i += [left[v] for v in low]
        pairs_j += [left[v] for v in high]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *pairs_i]), np.concatenate([none, *pairs_j])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What edges between fingerprints (rows of a and b) connect, as one edge from each fingerprint to the least it
    reaches: different posting lists of a group then mostly return the same edges."""
    both = np.ascontiguousarray(np.concatenate((a, b)))
    node, where = np.unique(both.view(f"V{both.itemsize * both.shape[1]}").ravel(), return_inverse=True)
    label = contract(where[: len(a)], where[len(a) :], np.arange(len(node)))[2]
    on = np.flatnonzero(label != np.arange(len(node)))
    rows = node.view(both.dtype).reshape(len(node), both.shape[1])
    return rows[label[on]], rows[on]


def posting_keys(plan: Plan) -> Column:
    """The posting keys of a fingerprint: the number of the choice, then its bytes."""
    byte = lambda p: F.shiftrightunsigned(F.col(f"f{p // 8}"), p % 8 * 8).bitwiseAND(F.lit(255))
    key = lambda n, combo: reduce(lambda k, p: F.shiftleft(k, 8).bitwiseOR(byte(p)), combo, F.lit(n).cast("long"))
    return F.array(*[key(n, combo) for n, combo in enumerate(plan.combos())])


def links(spark: SparkSession, postings: DataFrame, plan: Plan, scratch: Scratch, list_limit: int = 4096) -> DataFrame:
    """postings(key, f0, ...) -> edges(a0, ..., b0, ...) between fingerprints, which reach what all links within the
    posting lists reach. A posting list longer than list_limit is not handled by one task: its members are dealt into
    blocks and each pair of blocks is a task's group, so no list is dropped and none is gathered whole."""
    cols, ends = names(plan.lanes), names(plan.lanes, "a") + names(plan.lanes, "b")
    dealt = postings.repartition(default_parallelism(spark), "key").sortWithinPartitions("key")

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, size, spilled, out, held = None, [], 0, False, [], 0

        def put(i, j, hot):
            nonlocal held
            out.append((i, j, np.full(len(i), hot, np.int64)))
            held += len(i)

        def close():
            nonlocal members, size, spilled
            if members:
                x = np.concatenate(members)
                if spilled:
                    put(x, x, key)
                elif len(x) > 1:
                    i, j = forest(x.view(np.uint64), plan)
                    if len(i):
                        put(x[i], x[j], -1)
            members, size, spilled = [], 0, False

        def flush():
            nonlocal held
            a, b, hot = (np.concatenate([o[n] for o in out]) for n in range(3))
            out.clear()
            held = 0
            low, high = stars(a[hot < 0], b[hot < 0])
            a, b, hot = np.concatenate((low, a[hot >= 0])), np.concatenate((high, b[hot >= 0])), np.concatenate((np.full(len(low), -1), hot[hot >= 0]))
            arrays = [pa.array(np.ascontiguousarray(side[:, k])) for side in (a, b) for k in range(plan.lanes)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(hot)], [*ends, "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("key").to_numpy()
            fp = np.stack([batch.column(c).to_numpy() for c in cols], axis=1)
            bounds = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            sizes = np.diff(bounds)
            short = sizes <= SHORT
            short[0] = short[-1] = False  # these lists may go on in another batch
            if (rows := np.repeat(short & (sizes > 1), sizes)).any():
                x = np.ascontiguousarray(fp[rows])
                i, j = small_lists(x.view(np.uint64), keys[rows], plan)
                put(x[i], x[j], -1)
            for n in np.flatnonzero(~short).tolist():
                s, e = bounds[n], bounds[n + 1]
                if keys[s] != key:
                    close()
                    key = int(keys[s])
                members.append(fp[s:e])
                size += e - s
                if size > list_limit:
                    x = np.concatenate(members)
                    put(x, x, key)
                    members, size, spilled = [], 0, True
            if held > 20_000:
                yield flush()
        close()
        if out:
            yield flush()

    found = scratch.table(dealt.mapInArrow(lists, ", ".join(f"{c} long" for c in [*ends, "hot"])), "lists")
    edges = found.where("hot < 0").select(*ends)
    hot = found.where("hot >= 0").select("hot", *[F.col(a).alias(c) for a, c in zip(ends, cols)])
    if hot.limit(1).count():
        sizes = hot.groupBy("hot").agg(F.ceil(F.count("*") / list_limit).cast("int").alias("blocks"))
        own = hot.join(sizes, "hot").withColumn("own", F.pmod(F.xxhash64(*cols), F.col("blocks")).cast("int"))
        pairs = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "hot", *cols, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")
        )

        def block(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.ascontiguousarray(pdf[cols].to_numpy())
            i, j = forest(x.view(np.uint64), plan)
            return pd.DataFrame(np.concatenate(stars(x[i], x[j]), axis=1), columns=ends)

        edges = edges.unionByName(pairs.groupBy("hot", "lo", "hi").applyInPandas(block, ", ".join(f"{c} long" for c in ends)))
    return edges


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """One row for each input row: (id_col, fingerprint, component_id). Fingerprints within `bits` link.

    Null and empty texts have fingerprint zero and link like any other; texts with fewer than `words` words hash
    their whole word sequence; long texts count whole; copies and repeated rows share a component; component_id is the
    smallest id reachable (null ids never win unless all are null); an empty table gives no row; other columns are
    ignored."""
    spark, plan = docs.sparkSession, Plan.guaranteed(bits)
    scratch = Scratch(spark, "simhash")
    fps = scratch.table(fingerprints(docs, id_col, text_col, words), "fps")
    classes = scratch.table(fps.groupBy("f0").agg(F.min("id").alias("rep")), "classes")
    postings = classes.select(F.explode(posting_keys(plan)).alias("key"), "f0")
    edges = links(spark, postings, plan, scratch).distinct()
    found = components(edges.select(F.col("a0").alias("a"), F.col("b0").alias("b")), scratch)
    comp = classes.join(found, classes.f0 == found.id, "left").select("f0", "rep", F.coalesce("component", "f0").alias("label"))
    least = comp.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = comp.join(least, "label").select("f0", "component_id")
    out = fps.join(named, "f0").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
    out = scratch.table(out, "result")
    scratch.drop("fps", "classes", "lists", "cc")
    return out
