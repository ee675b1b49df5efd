"""Suffix-array dedup: bytes of long passages that an earlier document has are found by a column-wise suffix order.

Two equal windows of `length` bytes hold the same minimal 16-byte gram at the same place (winnowing), so the work is
dealt out by that gram, the anchor, without losing a match: windows whose anchor stands in one document only are
unique. What is left are short strings around shared anchors. A shard of them is ordered as Bauer, Cox and Rosone
build a collection's Burrows-Wheeler transform: column by column from the right, each round inserts one symbol of
every string where the last round's transform says, and updates the common prefixes of neighbours by range minima over
the last round's. In round t >= length, neighbours that share `length` symbols are equal windows, and every window of a
class with a smaller document id is marked.

Where it departs from the method as published: of the transform and the common prefixes it keeps the part of the current
round's suffixes, as equal windows are suffixes of one round; and that part lies in arrays of a shard, not in files which
each round reads and writes. The files are between the passes: texts, strings around anchors and marks are written tables
in the shared folder. Batches and shards are as many as the bytes of the texts ask for, so that their size does not grow.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, buckets_for, pack, tidy, tidy_pair, unpack

LENGTH, GRAM = 50, 16
BATCH_BYTES = 16_000_000
HOT = 20_000
CHUNK = 1 << 19
NO_ID = np.iinfo(np.int64).max


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, its place p, first window start a, last window start b) for each run of windows with one anchor."""
    parts = [_anchors(data[s : s + CHUNK + length - 1], length, s) for s in range(0, max(len(data) - length + 1, 0), CHUNK)]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)


def _anchors(data: bytes, length: int, shift: int):
    n, wide = len(data) - GRAM + 1, length - GRAM + 1
    low = np.ndarray((n,), "<u8", data, 0, (1,))
    high = np.ndarray((n,), "<u8", data, 8, (1,))
    h = (low * np.uint64(0x9E3779B97F4A7C15)) ^ (high * np.uint64(0xC2B2AE3D27D4EB4F))
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    low = (h & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)  # equal hashes: the leftmost
    best, span = low, 1
    while span * 2 <= wide:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if wide > span:
        best = np.minimum(best[: n - wide + 1], best[wide - span :])
    new = np.flatnonzero(best[1:] != best[:-1]) + 1
    first = np.concatenate(([0], new))
    last = np.concatenate((new - 1, [len(best) - 1]))
    at = (best[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    return h[at], at + shift, first + shift, last + shift


def batch_anchors(texts: list[bytes], length: int):
    """Anchors of a batch's texts and the text number of each."""
    found = [anchors(t, length) for t in texts]
    h, p, a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4))
    return h.astype(np.uint64), p, a, b, np.repeat(np.arange(len(found)), [len(f[0]) for f in found])


def index_batch(length: int, shards: int):
    """Pass 1, a batch of texts -> by bucket its distinct anchors: whether several texts have them, how often they stand."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, _, _, _, text = batch_anchors(pdf.text.tolist(), length)
        order = np.argsort(h, kind="stable")
        h, text = h[order], text[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h)))
        several = text[first] != text[first + count - 1] if len(h) else np.zeros(0, bool)
        keys = h[first]
        bucket = (keys % np.uint64(shards)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(shards + 1))
        batch, rows = int(pdf.batch.iloc[0]), []
        for n in range(shards):
            if (part := order[cuts[n] : cuts[n + 1]]).size:
                rows.append((n, batch, pack(keys[part]), pack((np.minimum(count[part], 2**30) * 2 + several[part]).astype(np.uint32))))
        return pd.DataFrame(rows, columns=["bucket", "batch", "keys", "counts"])

    return run


def shared_anchors(hot: int):
    """Pass 1, a bucket of all batches -> for each batch its anchors that several texts have, and which are hot."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [unpack(k, np.uint64) for k in pdf["keys"]], [unpack(c, np.uint32).astype(np.int64) for c in pdf["counts"]]
        _, where, batches = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        flat = np.concatenate(counts)
        several = (batches > 1) | (np.bincount(where, weights=flat & 1) > 0)
        many = np.bincount(where, weights=flat >> 1) > hot
        rows, at = [], 0
        for batch, k in zip(pdf.batch, keys):
            own = where[at : at + len(k)]
            at += len(k)
            if (on := several[own]).any():
                rows.append((int(batch), pack(k[on]), pack(many[own][on].astype(np.uint8))))
        return pd.DataFrame(rows, columns=["batch", "keys", "hot"])

    return run


def around(data: list[bytes], text: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> np.ndarray:
    """Rows of `width` bytes of the texts from start on, zero outside begin..end."""
    offset = np.cumsum([width, *map(len, data)])[:-1]
    whole = np.frombuffer(b"".join([bytes(width), *data, bytes(width)]), np.uint8)
    m = np.lib.stride_tricks.sliding_window_view(whole, width)[offset[text] + start]
    column = np.arange(width)
    for at in range(0, len(m), 1 << 16):
        part = slice(at, at + (1 << 16))
        m[part] *= (column >= (begin - start)[part, None]) & (column < (end - start)[part, None])
    return m


def cut_strings(length: int, shards: int):
    """Pass 2, a batch's texts and shared anchors -> its strings by shard (kind 1), and the spans that the batch alone
    shows to be repeated (kind 0).

    A string is `width` bytes ending `length` bytes behind its anchor, zero outside its windows' bytes; ahead and
    behind say how far before the anchor its first and last window start. Equal strings are one, owned by the smallest
    id; every place of a larger id is marked at once. A hot anchor's windows are strings of their own, dealt by their
    content, so that no shard gathers all that stands around it."""
    width = 2 * length - GRAM

    def run(texts: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        columns = ["kind", "batch", "shard", "m", "ids", "ahead", "behind", "string", "place"]
        if not len(texts) or not len(shared):
            return pd.DataFrame([], columns=columns)
        batch, data, ids = int(texts.batch.iloc[0]), texts.text.tolist(), texts.id.to_numpy()
        keys = np.concatenate([unpack(k, np.uint64) for k in shared["keys"]])
        hot = np.concatenate([unpack(k, np.uint8) for k in shared["hot"]])
        order = np.argsort(keys)
        keys, hot = keys[order], hot[order]
        h, p, a, b, text = batch_anchors(data, length)
        slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        on = keys[slot] == h
        h, p, a, b, text, hot = h[on], p[on], a[on], b[on], text[on], hot[slot[on]]
        m = around(data, text, p - (width - length), a, b + length, width)
        ahead, behind, ids = (p - a).astype(np.uint8), (p - b).astype(np.uint8), ids[text]
        if hot.any():
            parts = [(m[hot == 0], ahead[hot == 0], behind[hot == 0], ids[hot == 0], p[hot == 0], h[hot == 0])]
            for d in range(width - length + 1):
                if (some := (hot > 0) & (ahead >= d) & (behind <= d)).any():
                    one = np.zeros((int(some.sum()), width), dtype=np.uint8)
                    s = width - length - d
                    one[:, s : s + length] = m[some, s : s + length]
                    key = np.zeros(len(one), dtype=np.uint64)
                    for c in range(s, s + length):
                        key = (key ^ one[:, c]) * np.uint64(0x100000001B3)
                    key ^= key >> np.uint64(31)
                    parts.append((one, np.full(len(one), d, np.uint8), np.full(len(one), d, np.uint8), ids[some], p[some], key))
            m, ahead, behind, ids, p, h = (np.concatenate(x) for x in zip(*parts))
        whole = np.concatenate((m, ahead[:, None], behind[:, None]), axis=1)
        _, first, which = np.unique(np.ascontiguousarray(whole).view(f"V{width + 2}").ravel(), return_index=True, return_inverse=True)
        owner = np.full(len(first), NO_ID)
        np.minimum.at(owner, which, ids)
        later = ids > owner[which]
        rows = []
        if later.any():
            start, end = p[later] - ahead[later], p[later] - behind[later] + length
            rows.append((0, batch, -1, None, pack(ids[later]), pack(start), pack(end), None, None))
        own = np.flatnonzero(~later)  # the owners' places, of which a string has one or more
        shard = (h[first] % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        place_order = own[np.argsort(which[own], kind="stable")]
        place_cut = np.searchsorted(which[place_order], np.arange(len(first) + 1))
        for n in range(shards):
            if (part := order[cuts[n] : cuts[n + 1]]).size:
                sizes = place_cut[part + 1] - place_cut[part]
                places = np.concatenate([place_order[place_cut[s] : place_cut[s + 1]] for s in part.tolist()])
                rows.append((1, batch, n, pack(m[first[part]]), pack(owner[part]), pack(ahead[first[part]]), pack(behind[first[part]]), pack(sizes), pack(p[places])))
        return pd.DataFrame(rows, columns=columns)

    return run


def repeated_windows(m: np.ndarray, ids: np.ndarray, ahead: np.ndarray, behind: np.ndarray, length: int) -> np.ndarray:
    """marks[string, d]: the string's window that starts d before its anchor has an equal one of a smaller id."""
    n, width = m.shape
    order, common = np.arange(n), np.zeros(n, dtype=np.uint8)  # round 0: empty suffixes, in order; common prefixes with the one before
    marks = np.zeros((n, width - length + 1), dtype=bool)
    for t in range(1, width + 1):
        transform = m[order, width - t]  # the symbol before each suffix, in their order
        levels = [common]
        while 2 << len(levels) - 1 <= n:
            last, step = levels[-1], 1 << len(levels) - 1
            levels.append(np.minimum(last[:-step], last[step:]))
        step = np.argsort(transform, kind="stable")  # where each new suffix comes from: insertion by symbol, then by place
        order, symbol = order[step], transform[step]
        same = symbol[1:] == symbol[:-1]
        lo, hi = step[:-1][same] + 1, step[1:][same]
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        found = np.zeros(len(lo), dtype=np.uint8)
        for k in np.unique(level).tolist():
            at = level == k
            found[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << k) + 1])
        common = np.zeros(n, dtype=np.uint8)
        common[1:][same] = np.minimum(found, 254) + 1
        if t < length:
            continue
        d = t - length
        valid = (ahead >= d) & (behind <= d)
        if not valid.any():
            continue
        first = np.flatnonzero(np.concatenate(([True], common[1:] < length)))
        low = np.minimum.reduceat(np.where(valid, ids, NO_ID)[order], first)
        marks[order, d] = valid[order] & (np.repeat(low, np.diff(np.append(first, n))) < ids[order])
    return marks


def order_shard(length: int):
    """Pass 3, a shard of all batches' strings -> by batch the marked spans."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = 2 * length - GRAM
        m = np.concatenate([unpack(x, np.uint8).reshape(-1, width) for x in pdf.m])
        ids, ahead, behind = (np.concatenate([unpack(x, t) for x in pdf[c]]) for c, t in (("ids", np.int64), ("ahead", np.uint8), ("behind", np.uint8)))
        sizes, places = (np.concatenate([unpack(x, np.int64) for x in pdf[c]]) for c in ("string", "place"))
        of_batch = np.repeat(np.arange(len(pdf)), [len(unpack(x, np.int64)) for x in pdf.ids])
        marks = repeated_windows(m, ids, ahead, behind, length)
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        string, lo = np.nonzero(edge == 1)  # runs of marked windows, lo..hi before the anchor
        hi = np.nonzero(edge == -1)[1] - 1
        starts = np.concatenate(([0], np.cumsum(sizes)))
        times = sizes[string]
        which = np.repeat(np.arange(len(string)), times)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        at = places[starts[string[which]] + nth]
        out_ids, begin, end, batch = ids[string[which]], at - hi[which], at - lo[which] + length, of_batch[string[which]]
        rows = []
        for n in np.unique(batch).tolist():
            on = batch == n
            rows.append((int(pdf.batch.iloc[n]), pack(out_ids[on]), pack(begin[on]), pack(end[on])))
        return pd.DataFrame(rows, columns=["batch", "ids", "begin", "end"])

    return run


def merge(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans that touch or overlap."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, reach = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(begin[1:] > reach[:-1]) + 1
    return begin[np.concatenate(([0], new))], reach[np.concatenate((new - 1, [len(reach) - 1]))]


def cut_out(length: int, with_text: bool):
    """Pass 4, a batch's texts and marked spans -> what is left of each text."""

    def run(texts: pd.DataFrame, marked: pd.DataFrame) -> pd.DataFrame:
        if len(marked):
            ids, begin, end = (np.concatenate([unpack(x, np.int64) for x in marked[c]]) for c in ("ids", "begin", "end"))
        else:
            ids = begin = end = np.zeros(0, np.int64)
        order = np.argsort(ids, kind="stable")
        ids, begin, end = ids[order], begin[order], end[order]
        rows = []
        for i, key, data in zip(texts.id.tolist(), texts["key"].tolist(), texts.text.tolist()):
            lo, hi = np.searchsorted(ids, i, "left"), np.searchsorted(ids, i, "right")
            s, e = merge(begin[lo:hi], end[lo:hi])
            kept, at = [], 0
            for x, y in zip(s.tolist(), e.tolist()):
                kept.append(data[at:x])
                at = y
            kept = b"".join([*kept, data[at:]])
            rows.append((i, key, s.tolist(), (e - s).tolist(), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        return pd.DataFrame(rows, columns=["id", "key", "starts", "lengths", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = False, hot: int = HOT, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """One row for each row of docs: id_col, text_key (xxhash64 of the text), n_bytes, starts and lengths (array<long>,
    the maximal removed runs of the text's UTF-8 bytes), kept_sha256 (of the remaining bytes), and kept (these as
    text, without what is left of characters cut in two; null unless with_text); and own, a struct of the columns of
    docs in keep, if there are any.

    A byte goes if a `length`-byte string over it also starts in a document with a smaller id; matches never cross
    documents and are judged on the input. Null and empty texts keep nothing and lose nothing; texts shorter than
    `length` stay whole; of equal texts the smallest id's stands for all, and those of larger ids go entirely; rows
    that repeat an id are one document to each other (none removes the other's bytes by equal ids); a null id is larger
    than all others; long texts are compared whole; an empty table gives no row; other columns are ignored.
    18 <= length <= 128."""
    if not GRAM + 2 <= length <= 128:
        raise ValueError("length must be 18..128")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "suffix")
    own = [F.struct(*keep).alias("own")] if keep else []
    raw = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"), *own)
    parts = buckets_for(raw, "text", BATCH_BYTES)
    # partial aggregation collapses a hot group of copies before the shuffle; the result lies as it is dealt out
    first = raw.groupBy("text").agg(F.min("id").alias("id")).where(F.length("text") >= length)
    first = first.select(F.pmod(F.hash("text"), F.lit(parts)).alias("batch"), "id", F.xxhash64("text").alias("key"), "text")
    name = f"suffix_texts_{uuid.uuid4().hex}"
    first.write.bucketBy(parts, "batch").option("path", f"{scratch.base}/texts").format("parquet").saveAsTable(name)
    scratch.release()
    texts = spark.table(name)
    index = texts.groupBy("batch").applyInPandas(tidy(index_batch(length, parts)), "bucket int, batch int, keys binary, counts binary")
    shared = scratch.table(index.groupBy("bucket").applyInPandas(tidy(shared_anchors(hot)), "batch int, keys binary, hot binary"), "shared")
    scratch.release()
    schema = "kind int, batch int, shard int, m binary, ids binary, ahead binary, behind binary, string binary, place binary"
    strings = scratch.table(texts.groupBy("batch").cogroup(shared.groupBy("batch")).applyInPandas(tidy_pair(cut_strings(length, parts)), schema), "strings", partition_by="kind")
    scratch.drop("shared")
    scratch.release()
    ordered = strings.where("kind = 1").groupBy("shard").applyInPandas(tidy(order_shard(length)), "batch int, ids binary, begin binary, end binary")
    local = strings.where("kind = 0").select("batch", "ids", F.col("ahead").alias("begin"), F.col("behind").alias("end"))
    marked = scratch.table(ordered.unionByName(local), "marked")
    scratch.drop("strings")
    scratch.release()
    schema = "id long, key long, starts array<long>, lengths array<long>, kept_sha256 string, kept string"
    left = scratch.table(texts.groupBy("batch").cogroup(marked.groupBy("batch")).applyInPandas(tidy_pair(cut_out(length, with_text)), schema), "left")
    spark.sql(f"drop table {name}")
    scratch.delete(f"{scratch.base}/texts")
    scratch.drop("marked")
    # the rest are short texts, which stay, and larger copies, which go
    small = F.length("text") < length
    rows = raw.select("id", F.xxhash64("text").alias("key"), F.length("text").cast("long").alias("n_bytes"), F.when(small, F.col("text")).alias("short"), *(["own"] if keep else []))
    rest = F.coalesce("short", F.lit(b""))
    gone = F.col("short").isNull()
    none = F.array().cast("array<long>")
    out = rows.join(left, ["id", "key"], "left")
    return out.select(
        F.when(F.col("id") != F.lit(NO_ID).cast("long"), F.col("id")).alias(id_col), F.col("key").alias("text_key"), "n_bytes",
        F.coalesce("starts", F.when(gone, F.array(F.lit(0).cast("long"))).otherwise(none)).alias("starts"),
        F.coalesce("lengths", F.when(gone, F.array("n_bytes")).otherwise(none)).alias("lengths"),
        F.coalesce("kept_sha256", F.sha2(rest, 256)).alias("kept_sha256"),
        (F.coalesce("kept", rest.cast("string")) if with_text else F.lit(None).cast("string")).alias("kept"), *(["own"] if keep else []),
    )
