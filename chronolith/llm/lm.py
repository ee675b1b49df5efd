"""Language-model scoring with a log-frequency Bloom filter.

The counts of all unigrams, bigrams and trigrams of all training documents go, as levels 1 + floor(log2(count)), into a
Bloom filter (Talbot & Osborne 2007): each level up to the n-gram's own is a member, so a count is read back by probing
level after level until one is missing. A token's probability is smoothed order by order,
  p(w | u v) = (c(u v w) + s3 * p(w | v)) / (c(u v) + s3),  p(w | v) = (c(v w) + s2 * p(w)) / (c(v) + s2),
where p(w) is the add-half estimate, all counts are what the filter gives, and the first token of a text has no trigram.

A filter that is sure to have at most max_bits (there are no more members than n-grams in the training texts) is broadcast,
as the method has it. A filter of a corpus grows with the corpus, and in parts it would take a pass over all texts for each:
beyond max_bits the questions travel instead. Each part of the filter is built in the task that holds the n-grams of its
bucket and probed there by the batches' distinct n-grams, so that work stays linear and nothing that grows is broadcast;
the bits and so the scores are the same.

Plan: one pass cuts documents into batches and writes token numbers and, by hash bucket, distinct tokens with their counts.
Buckets are summed by hash (a word found in every text counts once per batch), and each batch gets its tokens' exact totals
back, for the base score. A second pass over the written numbers gives the n-grams. Everything after the first pass reads
written tables, whose content no retry changes. Tokens are told apart by 64-bit hashes, n-grams by hashes of 32-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Shared, buckets_for, byte_column, pack, tidy, tidy_pair, unpack

BATCH_TOKENS = 800_000
BUCKET_BYTES = 8_000_000
PORTION_BYTES = 2_000_000
AT_ONCE = 1 << 16
SPACE = np.isin(np.arange(256), list(b"\t\n\v\f\r "))
END_HASH = xxhash.xxh64_intdigest(b"", 1)
DOCS, TOKENS = 0, 1
COUNTS, LEVELS = 0, 1
MAX_BITS = 1 << 29
PROBES, BITS_PER_MEMBER = 5, 7.5
NO_ID = np.iinfo(np.int64).min
STRENGTHS = (100.0, 3.0)


def planes(x: np.ndarray) -> bytes:
    """An int32 array as a compressed blob, byte planes apart: small numbers leave three nearly empty."""
    return pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T))


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(unpack(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ordered(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(values below 2 ** bits in ascending order, their places; equal values by place). Values and places are sorted as
    one number if 64 bits hold both, which takes a fifth of the time of sorting places by values."""
    at = np.uint64(max(len(values) - 1, 0).bit_length())
    if bits + int(at) > 64:
        order = np.argsort(values, kind="stable")
        return values[order], order
    both = np.sort(values << at | np.arange(len(values), dtype=np.uint64))
    return both >> at, (both & ((np.uint64(1) << at) - np.uint64(1))).astype(np.int64)


def groups(ascending: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value begins in an ascending array, and the number of each place's value among them."""
    new = np.ones(len(ascending), dtype=bool)
    new[1:] = ascending[1:] != ascending[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def numbered(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values below 2 ** bits, and the number of each place's value among them."""
    ascending, order = ordered(values, bits)
    first, number = groups(ascending)
    out = np.empty(len(values), np.int64)
    out[order] = number
    return ascending[first], out


def distinct_ngrams(flow: np.ndarray, sizes: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts' token numbers `flow` and the upper halves of the tokens' hashes: hashes of all distinct n-grams of a
    batch, and the number of each place's unigram, bigram and trigram among them. Unigrams come first, by token number.
    A text's first token follows the end of a text and has the trigram -1. A bigram is told by the numbers of its tokens, a
    trigram by those of its bigram and its token, so that only distinct ones are hashed."""
    u, starts = upper.astype(np.uint64), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    before = np.concatenate(([0], flow[:-1]))
    before[starts] = 0
    bits = max(len(u) - 1, 1).bit_length()
    shift, mask = np.uint64(bits), np.uint64((1 << bits) - 1)
    pairs, second = numbered((before << bits | flow).astype(np.uint64), 2 * bits)
    two = mix(u[(pairs >> shift).astype(np.int64)] << np.uint64(32) | u[(pairs & mask).astype(np.int64)])
    inner = np.ones(len(flow), dtype=bool)
    inner[starts] = False
    inner = np.flatnonzero(inner)
    triples, at = numbered((second[inner - 1] << bits | flow[inner]).astype(np.uint64), max(len(pairs) - 1, 1).bit_length() + bits)
    three = mix(two[(triples >> shift).astype(np.int64)] + u[(triples & mask).astype(np.int64)] * np.uint64(0x9E3779B97F4A7C15))
    third = np.full(len(flow), -1)
    third[inner] = at + len(u) + len(pairs)
    return np.concatenate((mix(~u), two, three)), flow, second + len(u), third


def dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts hashes by bucket and by as much of the upper half as 64 bits hold beside bucket and place, and
    where buckets begin in it. The same hashes always have the same order."""
    of, at = max(buckets - 1, 1).bit_length(), max(len(hashes) - 1, 0).bit_length()
    upper = min(32, 64 - of - at)
    bucket, order = ordered(hashes % np.uint64(buckets) << np.uint64(upper) | hashes >> np.uint64(64 - upper), of + upper)
    return order, np.append(np.searchsorted(bucket, np.arange(buckets, dtype=np.uint64) << np.uint64(upper)), len(hashes))


def pack_keys(keys: np.ndarray) -> bytes:
    """32-bit keys by their differences, which are small where keys ascend; keys that don't are kept by wrapping around."""
    return planes(np.diff(keys.astype(np.uint32), prepend=np.uint32(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob).astype(np.uint32), dtype=np.uint32).astype(np.uint64)


def portions(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of some PORTION_BYTES; a longer text stands alone."""
    first, size = 0, 0
    for n, text in enumerate(texts):
        if n > first and size + len(text) > PORTION_BYTES:
            yield texts[first:n]
            first, size = n, 0
        size += len(text)
    if texts:
        yield texts[first:]


def tokens(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each text, A-Z in lower case: the number of tokens, their bytes without what parts them, and their lengths. They
    are cut as bytes.split cuts them, all texts at once."""
    joined = np.frombuffer(b"\n".join([*texts, b""]).lower(), dtype=np.uint8)
    inside = ~SPACE[joined]
    edges = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends by turns: a space stands last
    lengths = edges[1::2] - edges[::2]
    cuts = np.searchsorted(edges[::2], np.cumsum([0, *[len(t) + 1 for t in texts]]))
    letters, at = joined[inside], np.append(0, np.cumsum(lengths))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        yield b - a, letters[at[a] : at[b]], lengths[a:b]


def token_array(letters: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(lengths, dtype=np.int64))
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])


def first_pass(docs: DataFrame, buckets: int) -> DataFrame:
    """docs(id, held, text) -> (kind, batch, bucket, a, b, c, d, e).

    DOCS: a = ids, b = token counts of the documents, c = token numbers and, after them, the order that sorts the
    batch's distinct tokens by bucket and hash, d = upper halves of these tokens' hashes, e = which documents are held
    out. TOKENS: a = hashes, b = counts in training texts."""
    names = ["kind", "batch", "bucket", "a", "b", "c", "d", "e"]

    def emit(batch: int, ids: list[int], held: list[bool], sizes: list[int], letters: list[np.ndarray], lengths: list[np.ndarray]) -> list[tuple]:
        sizes = np.array(sizes, dtype=np.int64)
        number = token_array(np.concatenate(letters), np.concatenate(lengths)).dictionary_encode()
        ends = np.cumsum(sizes) - 1
        words = np.ones(sizes.sum(), dtype=bool)
        words[ends] = False
        flow = np.zeros(len(words), dtype=np.int64)  # 0 is the end
        flow[words] = number.indices.to_numpy() + 1
        hashes = np.array([END_HASH, *map(xxhash.xxh64_intdigest, number.dictionary.to_numpy(zero_copy_only=False))], dtype=np.uint64)
        learn = np.repeat(~np.array(held, dtype=bool), sizes)
        counts = np.bincount(flow[learn], minlength=len(hashes))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((hashes, bucket))
        rows = [(DOCS, batch, -1, pack(np.array(ids, dtype=np.int64)), pack(sizes), planes(np.concatenate((flow, order))), pack((hashes >> np.uint64(32)).astype(np.uint32)), pack(np.array(held, dtype=np.uint8)))]
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for n in range(buckets):
            if (part := order[cuts[n] : cuts[n + 1]]).size:
                rows.append((TOKENS, batch, n, pack(hashes[part]), planes(counts[part]), None, None, None))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = TaskContext.get().partitionId() << 32
        ids, held, sizes, letters, lengths, size = [], [], [], [], [], 0

        def close():
            nonlocal seq, ids, held, sizes, letters, lengths, size
            cols = list(zip(*emit(seq, ids, held, sizes, letters, lengths)))
            seq, ids, held, sizes, letters, lengths, size = seq + 1, [], [], [], [], [], 0
            types = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for b in batches:
            row, own_ids, own_held = 0, b.column("id").to_pylist(), b.column("held").to_pylist()
            for texts in portions(byte_column(b, "text")):
                for n, chars, lens in tokens(texts):
                    if size and size + n + 1 > BATCH_TOKENS:
                        yield close()
                    ids.append(own_ids[row] if own_ids[row] is not None else NO_ID)
                    held.append(bool(own_held[row]))
                    sizes.append(n + 1)
                    letters.append(chars)
                    lengths.append(lens)
                    row, size = row + 1, size + n + 1
        if ids:
            yield close()

    return docs.mapInArrow(run, "kind int, batch long, bucket int, a binary, b binary, c binary, d binary, e binary")


def sum_tokens(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket of TOKENS -> for each batch its totals; and (batch null) the bucket's tokens and distinct tokens."""
    hashes, counts = [unpack(x, np.uint64) for x in pdf.a], [unplanes(x) for x in pdf.b]
    _, where = np.unique(np.concatenate(hashes), return_inverse=True)
    totals = np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)
    rows, at = [], 0
    for batch, h in zip(pdf.batch, hashes):
        own = totals[where[at : at + len(h)]]
        at += len(h)
        rows.append((int(batch), int(pdf.bucket.iloc[0]), pack(own), 0, 0))
    rows.append((None, int(pdf.bucket.iloc[0]), None, int(totals.sum()), int((totals > 0).sum())))
    out = pd.DataFrame(rows, columns=["batch", "bucket", "data", "n", "v"])
    return out.astype({"batch": "Int64"})


def count_ngrams(texts: DataFrame, buckets: int) -> DataFrame:
    """DOCS rows -> (bucket, batch, keys, counts): a batch's distinct n-grams and how often training texts have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for batch, sizes, flow, upper, held in zip(pdf.batch, pdf.b, pdf.c, pdf.d, pdf.e):
                sizes = unpack(sizes, np.int64)
                flow = unplanes(flow)[: sizes.sum()]
                hashes, *places = distinct_ngrams(flow, sizes, unpack(upper, np.uint32))
                learn = np.flatnonzero(np.repeat(unpack(held, np.uint8) == 0, sizes))
                counts = np.bincount(np.concatenate([p[learn] for p in places]) + 1, minlength=len(hashes) + 1)[1:]  # less trigram -1
                order, cuts = dealt(hashes, buckets)
                keys, counts = (hashes >> np.uint64(32))[order], counts[order]
                rows = [(n, batch, pack_keys(keys[a:b]), planes(counts[a:b])) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]
                yield pd.DataFrame(rows, columns=["bucket", "batch", "keys", "counts"])

    return texts.select("batch", "b", "c", "d", "e").mapInPandas(run, "bucket int, batch long, keys binary, counts binary")


class BloomCounts:
    """Log-frequency Bloom filter: a segment of bits for each bucket; PROBES bits stand for each (key, level)."""

    def __init__(self, segments: list[np.ndarray]):
        self.segments = segments

    @staticmethod
    def seeds(keys: np.ndarray, level: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and stride, modulo bits, of the places of (key, level)."""
        h = mix(keys.astype(np.uint64) * np.uint64(64) + np.uint64(level) + np.uint64(0x9E3779B97F4A7C15))
        of = np.uint32 if bits < 1 << 31 else np.uint64  # holds the sum of two places
        start, stride = (h >> np.uint64(32)).astype(of), h.astype(np.uint32).astype(of) | of(1)
        return start - start // of(bits) * of(bits), stride - stride // of(bits) * of(bits)  # numpy divides faster than it takes %

    @staticmethod
    def step(at: np.ndarray, stride: np.ndarray, bits: int) -> np.ndarray:
        """The next places: at + stride modulo bits; below zero, unsigned numbers are large."""
        at = at + stride
        return np.minimum(at, at - at.dtype.type(bits))

    @classmethod
    def segment(cls, keys: np.ndarray, levels: np.ndarray, bits: int) -> np.ndarray:
        """A bucket's bits, a multiple of 8."""
        on, level = np.zeros(bits, dtype=bool), 1
        while len(keys):
            for a in range(0, len(keys), AT_ONCE):
                at, stride = cls.seeds(keys[a : a + AT_ONCE], level, bits)
                for _ in range(PROBES):
                    on[at.astype(np.intp)] = True
                    at = cls.step(at, stride, bits)
            more = np.flatnonzero(levels > level)
            keys, levels, level = keys[more], levels[more], level + 1
        return np.packbits(on, bitorder="little")

    @classmethod
    def members(cls, data: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
        """Where in keys those stand whose bits of a level are all set."""
        at, stride = cls.seeds(keys, level, 8 * len(data))
        left, on = np.arange(len(keys)), np.ones(len(keys), dtype=np.uint8)
        for _ in range(PROBES):
            on &= data[(at >> 3).astype(np.intp)] >> (at & 7).astype(np.uint8)
            if 4 * np.count_nonzero(on) < 3 * len(on):  # the missing go
                some = np.flatnonzero(on.view(bool))
                left, at, stride, on = left[some], at[some], stride[some], on[some]
            at = cls.step(at, stride, 8 * len(data))
        return left[np.flatnonzero(on.view(bool))]

    def levels(self, hashes: np.ndarray, buckets: int) -> np.ndarray:
        """The level read back for each n-gram hash, 0 if none is stored."""
        order, cuts = dealt(hashes, buckets)
        keys, out = (hashes >> np.uint64(32))[order], np.empty(len(hashes), dtype=np.uint8)
        out[order] = np.concatenate([self.probe(keys[a:b], n) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))])
        return out

    def probe(self, keys: np.ndarray, bucket: int) -> np.ndarray:
        """The levels of a bucket's keys. Probes go on level by level while a level's bits are all set."""
        data, out, left, level = self.segments[bucket], np.zeros(len(keys), dtype=np.uint8), np.arange(len(keys)), 1
        while len(left) and level < 64:
            some = [left[a : a + AT_ONCE] for a in range(0, len(left), AT_ONCE)]
            left = np.concatenate([x[self.members(data, keys[x], level)] for x in some])
            out[left] = level
            level += 1
        return out


def filter_part(keys: list[np.ndarray], counts: list[np.ndarray], bits_per_member: float) -> tuple[BloomCounts, np.ndarray, np.ndarray, np.ndarray]:
    """The batches' n-grams of one bucket -> its part of the filter, with the levels of all that training texts have; the
    bucket's distinct keys; and of all keys in ascending order, the places and the numbers among the distinct ones."""
    ascending, order = ordered(np.concatenate(keys), 32)
    first, number = groups(ascending)
    distinct, totals = ascending[first], np.add.reduceat(np.concatenate(counts)[order], first)
    learned = np.flatnonzero(totals)
    level = np.frexp(totals[learned])[1].astype(np.uint8)  # 1 + floor(log2(total))
    bits = max(64, int(level.sum(dtype=np.int64) * bits_per_member) // 8 * 8 + 8)
    return BloomCounts([BloomCounts.segment(distinct[learned], level, bits)]), distinct, order, number


def read_back(keys: list[np.ndarray], counts: list[np.ndarray], bits_per_member: float) -> list[np.ndarray]:
    """The batches' n-grams of one bucket -> the level that its part of the filter gives for each; a key that many batches
    have is probed once."""
    part, distinct, order, number = filter_part(keys, counts, bits_per_member)
    levels = np.empty(len(order), np.uint8)
    levels[order] = part.probe(distinct, 0)[number]
    return np.split(levels, np.cumsum([len(x) for x in keys])[:-1])


def level_count(level: np.ndarray) -> np.ndarray:
    """The middle of the counts that a level stands for; 0 for level 0."""
    return np.where(level > 0, 1.5 * np.exp2(level - 1.0) - 0.5, 0.0)


def log_probabilities(count: np.ndarray, places: list[np.ndarray], before: np.ndarray, starts: np.ndarray, floor: float, strengths: tuple[float, float]) -> np.ndarray:
    """log10 p of each token, by the counts of a batch's distinct n-grams and the number of each place's n-gram among
    them; before: the number of the unigram before each place."""
    one, two, three = places
    context, second, third = count[before], count[two], np.where(three >= 0, count[three], 0.0)
    p = (count[one] + 0.5) / floor
    p = (np.minimum(second, context) + strengths[0] * p) / (context + strengths[0])
    context = np.concatenate(([0.0], second[:-1]))
    smooth = (np.minimum(third, context) + strengths[1] * p) / (context + strengths[1])
    smooth[starts] = p[starts]
    return np.log10(smooth)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_col: str | None = None, strengths: tuple[float, float] = STRENGTHS, max_bits: int = MAX_BITS, bits_per_member: float = BITS_PER_MEMBER) -> DataFrame:
    """One row for each row of docs: id_col, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Rows whose held_col is true are scored but not learned from. Null and empty texts are the end token alone; long
    texts are scored whole; repeated rows count and score as often as they stand there; with no training row at all,
    counts are zero and the base probability is that of an empty corpus (N = V = 0); an empty table gives no row; other
    columns are ignored."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    held = F.coalesce(F.col(held_col).cast("boolean"), F.lit(False)) if held_col else F.lit(False)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets_for(rows, "text", BUCKET_BYTES)
    work = scratch.table(first_pass(rows, buckets), "work", partition_by="kind")
    entries = work.where(F.col("kind") == TOKENS).select("batch", "bucket", "a", "b")
    totals = scratch.table(entries.groupBy("bucket").applyInPandas(tidy(sum_tokens), "batch long, bucket int, data binary, n long, v long"), "totals")
    n, v = totals.where("batch is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    scratch.delete(f"{scratch.paths['work']}/kind={TOKENS}")
    scratch.release()
    texts = work.where(F.col("kind") == DOCS).select("batch", "a", "b", "c", "d", "e")
    ngrams = count_ngrams(texts, buckets)
    answers, shared = totals.where("batch is not null").select("batch", F.lit(COUNTS).alias("kind"), "bucket", "data"), None
    if 3 * int(n) * bits_per_member + 128 * buckets <= max_bits:

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            part, *_ = filter_part([unpack_keys(x) for x in pdf["keys"]], [unplanes(x) for x in pdf["counts"]], bits_per_member)
            return pd.DataFrame({"bucket": pdf["bucket"][:1], "data": [part.segments[0].tobytes()]})

        segments = [np.zeros(8, np.uint8) for _ in range(buckets)]
        for r in ngrams.groupBy("bucket").applyInPandas(tidy(build), "bucket int, data binary").toLocalIterator():
            segments[r.bucket] = np.frombuffer(r.data, np.uint8)
        shared = Shared(spark, BloomCounts(segments))  # at most max_bits
    else:

        def ask(pdf: pd.DataFrame) -> pd.DataFrame:
            found = [pack(x) for x in read_back([unpack_keys(x) for x in pdf["keys"]], [unplanes(x) for x in pdf["counts"]], bits_per_member)]
            return pd.DataFrame({"batch": pdf["batch"], "kind": LEVELS, "bucket": pdf["bucket"], "data": found})

        asked = ngrams.groupBy("bucket").applyInPandas(tidy(ask), "batch long, kind int, bucket int, data binary")
        answers = answers.unionByName(scratch.table(asked, "levels"))
    scratch.release()
    floor, whole = float(n) + 0.5 * (float(v) + 1), int(n)

    def per_batch(texts: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out, found = [], found.sort_values(["kind", "bucket"])
        exact = [unpack(x, np.int64) for x in found.data[found.kind == COUNTS]]
        for ids, sizes, flow, upper in zip(texts.a, texts.b, texts.c, texts.d):
            ids, sizes, flow = unpack(ids, np.int64), unpack(sizes, np.int64), unplanes(flow)
            flow, order = flow[: sizes.sum()], flow[sizes.sum() :]
            c = np.empty(len(order), np.int64)
            c[order] = np.concatenate(exact)
            hashes, *places = distinct_ngrams(flow, sizes, unpack(upper, np.uint32))
            if shared:
                level = shared.value.levels(hashes, buckets)
            else:
                level = np.empty(len(hashes), np.uint8)
                level[dealt(hashes, buckets)[0]] = np.concatenate([unpack(x, np.uint8) for x in found.data[found.kind == LEVELS]])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            before = np.concatenate(([0], flow[:-1]))
            before[starts] = 0
            p = log_probabilities(level_count(level), places, before, starts, floor, strengths)
            base = np.log10((c + 0.5) / floor)
            out.append(pd.DataFrame({
                "id": ids, "n_tokens": sizes, "n_known": np.add.reduceat((c[flow] > 0).astype(np.int64), starts), "train_tokens": whole,
                "base_score": np.add.reduceat(base[flow], starts), "score": np.add.reduceat(p, starts),
            }))
        return pd.concat(out)

    schema = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = scratch.table(texts.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(tidy_pair(per_batch), schema), "scored")
    scratch.drop("work", "totals", "levels")
    own_id = F.when(F.col("id") != F.lit(NO_ID).cast("long"), F.col("id")).alias(id_col)
    return scored.select(own_id, "n_tokens", "n_known", "train_tokens", "base_score", "score")
