"""Benchmark decontamination by greedy string tiling.

Token seeds shared with a test item pick the items worth comparing; on these, the longest non-overlapping common
stretches are marked again and again, found by running Karp-Rabin hashing (Wise 1993), until none of at least
`least` tokens is left. A document is contaminated by an item if its tiles cover enough of the item's tokens, in
whatever order they stand.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, text_column

WORD = re.compile(r"\w+")
BASE, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1
LEAST, COVERAGE = 5, 0.5
BROADCAST_BYTES = 8_000_000


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def running_hashes(x: list[int], size: int) -> list[int]:
    """Karp-Rabin hashes of all windows of the given size."""
    if len(x) < size:
        return []
    top, h = pow(BASE, size - 1, 1 << 64), 0
    for v in x[:size]:
        h = (h * BASE + v + 2) & MASK
    out = [h]
    for old, new in zip(x, x[size:]):
        h = ((h - (old + 2) * top) * BASE + new + 2) & MASK
        out.append(h)
    return out


def runs(free: list[bool]) -> list[int]:
    """How many free places follow each other from each place on."""
    out, n = [0] * len(free), 0
    for i in range(len(free) - 1, -1, -1):
        n = n + 1 if free[i] else 0
        out[i] = n
    return out


def tile(a: list[int], b: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in a, start in b, length): running Karp-Rabin greedy string tiling of the token numbers a and b.
    Numbers below 0 match nothing. The longest match is marked first, of equally long ones that with the smallest start
    in a, then in b; what a marked tile leaves of another match is queued again by its own length."""
    free_a, free_b, tiles = [v >= 0 for v in a], [v >= 0 for v in b], []
    size = min(max(least, 20), max(least, len(a)))
    while True:
        table, run_a, run_b = defaultdict(list), runs(free_a), runs(free_b)
        for i, h in enumerate(running_hashes(a, size)):
            if run_a[i] >= size:
                table[h].append(i)
        matches, longest = [], 0
        for j, h in enumerate(running_hashes(b, size) if table else []):
            if h not in table or run_b[j] < size:
                continue
            for i in table[h]:
                if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                    continue  # part of the match one to the left
                n, most = 0, min(run_a[i], run_b[j])
                while n < most and a[i + n] == b[j + n]:
                    n += 1
                if n >= size:
                    matches.append((-n, i, j))
                    longest = max(longest, n)
        if longest > 2 * size:
            size = longest
            continue
        heapify(matches)
        while matches:
            n, i, j = heappop(matches)
            free = [x and y for x, y in zip(free_a[i : i - n], free_b[j : j - n])]
            if all(free):
                free_a[i : i - n] = free_b[j : j - n] = [False] * -n
                tiles.append((i, j, -n))
                continue
            for k, length in enumerate(runs(free)):
                if length >= size and (not k or not free[k - 1]):
                    heappush(matches, (-length, i + k, j + k))
        if size == least:
            return tiles
        size = max(least, size // 2)


def few_copies(doc: np.ndarray, width: int, copies: int) -> np.ndarray:
    """Places of a stretch of token numbers that are needed to tile an item of `width` tokens: the stretch is covered by
    pieces of 2 * width tokens, so that every tile lies in one, and of equal pieces the first `copies` do, as an item has
    room for no more tiles. Keeps a passage that is repeated a thousand times from being compared a thousand times."""
    if len(doc) <= 2 * width * copies:
        return np.arange(len(doc))
    keep, seen = np.zeros(len(doc), dtype=bool), defaultdict(int)
    for at in range(0, max(len(doc) - width, 1), width):
        piece = doc[at : at + 2 * width].tobytes()
        seen[piece] += 1
        if seen[piece] <= copies:
            keep[at : at + 2 * width] = True
    return np.flatnonzero(keep)


class Benchmark:
    """Token numbers and seeds of some test items. A seed is `least` tokens, or all tokens of a shorter item."""

    def __init__(self, items: list[tuple[int, str, int]], least: int):
        """items: (item, text, copies)"""
        self.least, self.number, self.items, self.copies = least, {}, [], []
        for item, text, copies in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in tokens(text)]
            if ids:
                self.items.append((item, ids))
                self.copies.append(copies)
        self.seeds: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        by_size: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        for n, (_, ids) in enumerate(self.items):
            size = min(least, len(ids))
            for h in running_hashes(ids, size):
                by_size[size][h].add(n)
        for size, found in by_size.items():
            keys = sorted(found)
            self.seeds[size] = np.array(keys, dtype=np.uint64), [sorted(found[k]) for k in keys]

    def hits(self, doc: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """For each item number that shares a seed, the seeds' (place, size) in the document's token numbers."""
        out = defaultdict(list)
        for size, (keys, of) in self.seeds.items():
            if len(doc) < size:
                continue
            known = doc >= 0
            run = known[: len(doc) - size + 1].copy()
            for k in range(1, size):
                run &= known[k : len(doc) - size + 1 + k]
            at = np.flatnonzero(run)
            h = np.zeros(len(at), dtype=np.uint64)
            for k in range(size):
                h = h * np.uint64(BASE) + (doc[at + k] + 2).astype(np.uint64)
            slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            for p, s in zip(*(x[keys[slot] == h].tolist() for x in (at, slot))):
                for n in of[s]:
                    out[n].append((p, size))
        return out

    def compare(self, text: str, coverage: float, one: bool = False) -> list[tuple]:
        """(item, item tokens, covered tokens, tiles) for each item that the text covers enough; with `one` for the first
        such item only."""
        get, words = self.number.get, tokens(text)
        doc = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        out = []
        for n, places in self.hits(doc).items():
            item, ids = self.items[n]
            # only stretches with seeds can hold tiles: the rest of the document is left out
            size = min(self.least, len(ids))
            inside = np.zeros(len(doc) + 1, dtype=np.int64)
            p, width = np.array(places, dtype=np.int64).T
            np.add.at(inside, p, 1)
            np.add.at(inside, p + width, -1)
            at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
            near, origin = [], []
            for stretch in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1):
                kept = stretch[few_copies(doc[stretch], len(ids), len(ids) // size + 1)]
                for part in np.split(kept, np.flatnonzero(np.diff(kept) > 1) + 1):
                    near += [*doc[part].tolist(), -1]
                    origin += [*part.tolist(), -1]
            tiles = tile(ids, near, size)
            covered = sum(t[2] for t in tiles)
            if covered >= coverage * len(ids) and covered:
                out += [(item, len(ids), covered, [(origin[j], i, size) for i, j, size in tiles])] * self.copies[n]
                if one:
                    break
        return out


def blocks(items: DataFrame, most: int) -> Iterator[DataFrame]:
    """items(item, text) in blocks of at most `most` bytes of text, or of one item: dealt by hash into so many parts
    that each fits, part sizes being counted before."""
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("item", "text"), F.lit(parts))
        sizes = items.groupBy(part.alias("part")).agg(F.sum(F.octet_length("text") + 16).alias("size"), F.count("*").alias("n"))
        over = sizes.where((F.col("size") > most) & (F.col("n") > 1)).agg(F.max("size")).first()[0]
        if not over:
            break
        parts *= max(2, -(-over // most))
    for number in range(parts):
        yield items.where(part == number)


def distinct_items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.groupBy("item", "text").agg(F.count("*").alias("copies"))


def share(block: DataFrame, least: int) -> Shared:
    """A block, which blocks() has bounded, for all workers."""
    return Shared(block.sparkSession, Benchmark([(r.item, r.text, r.copies) for r in block.collect()], least))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row for each row of docs and test item that it covers by at least `coverage` of the item's tokens: id_col,
    item_col, item_tokens, covered_tokens, coverage, tiles array<struct<doc_start, item_start, length>> in tokens.

    Test items are broadcast in blocks of at most broadcast_bytes of text (their token numbers and seeds are some ten
    times that in a worker), so a larger benchmark takes more passes over the documents and none of it is dropped; equal
    items match alike, repeated ones give repeated results. Null and empty texts and items match nothing; an item of
    fewer than `least` tokens matches where all its tokens stand together; long texts are compared whole, ties go to the
    leftmost place in the item, then in the text; repeated rows give repeated results; an empty table on either side
    gives no row; other columns are ignored."""
    items = distinct_items(benchmark, item_col, item_text_col)
    schema = "id long, item long, item_tokens int, covered_tokens int, coverage double, tiles array<struct<doc_start: int, item_start: int, length: int>>"
    kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))
    names = ["id", "item", "item_tokens", "covered_tokens", "coverage", "tiles"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), kind]
    rows, out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), None
    for block in blocks(items, broadcast_bytes):
        shared = share(block, least)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for b in batches:
                found = []
                for i, text in zip(b.column("id").to_pylist(), text_column(b, "text")):
                    for item, n, covered, tiles in bench.compare(text, coverage):
                        spans = [{"doc_start": d, "item_start": s, "length": k} for d, s, k in tiles]
                        found.append((i, item, n, covered, covered / n, spans))
                cols = list(zip(*found)) if found else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = LEAST, coverage: float = COVERAGE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that cover no test item by `coverage`: the filter that goes with
    contaminated(). Rows are judged one by one, whatever their ids are, and nothing is shuffled."""
    for block in blocks(distinct_items(benchmark, item_col, item_text_col), broadcast_bytes):
        shared = share(block, least)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            bench = shared.value
            for b in batches:
                yield b.filter(pa.array([not bench.compare(t, coverage, one=True) for t in text_column(b, text_col)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
