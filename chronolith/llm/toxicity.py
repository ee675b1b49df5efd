"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words. A term weighs (1 + log tf) * idf * rf: idf = 1 + log((1 + n) / (1 + df)) counts all n documents, and the
relevance frequency rf = log2(2 + a / max(1, c)) of Lan et al. (2009) counts the a and c examples of label 1 and 0 that
have the term. No term of a text or an example is left out; one that no example has makes the text longer, with the idf of
df 0 and an rf of 1.

The index has a posting list for each term, cut in blocks of neighbouring examples with the largest weight of each block.
A text adds up its terms' block maxima, scores the most promising blocks, and then all blocks whose bound reaches its k-th
cosine so far: the k nearest are exact. The lists of frequent terms, which many
examples are in, are kept as vectors, as far as these fit in DENSE_BYTES. Votes are weighted by distance and mapped to probabilities by a sigmoid fitted on
the leave-one-out votes of all examples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Shared, default_parallelism, expand, text_column
from .quality import MAX_BYTES, MAX_EXAMPLES, sample, sigmoid_fit

WORD = re.compile(r"\w+")
BLOCK, FIRST = 128, 8
FREQUENT = 24  # terms that more than one in so many examples have
DENSE_BYTES = 32 << 20  # of their vectors, those of the most frequent first
TOGETHER = 64  # texts whose frequent terms are multiplied together
NEIGHBOURS = 31
PRIOR = 0.3  # votes at the base rate that every text has besides


def hashed(distinct: Collection[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))


def words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of a text's distinct words, which are told apart by 64 bits."""
    found = Counter(WORD.findall(text.lower()))
    return hashed(found), np.fromiter(found.values(), np.int64, len(found))


def places(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The number of each hash among the ascending terms, -1 if it is none."""
    if not len(terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, -1)


class Index:
    """Posting lists of the examples' unit vectors by term, in blocks of BLOCK neighbouring examples.

    terms: hashes of the examples' distinct terms, ascending; rows: for each example its term numbers and counts; df: in
    how many of the n documents each term is. Numbers are kept narrow, as the index is broadcast."""

    def __init__(self, terms: np.ndarray, ids: np.ndarray, y: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], df: np.ndarray, n: int):
        self.terms = terms
        size = np.array([len(t) for t, _ in rows], dtype=np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)]).astype(np.int64)
        count = np.concatenate([np.zeros(0), *(c for _, c in rows)])
        own = np.repeat(np.arange(len(rows)), size)
        a = np.bincount(term[y[own] > 0], minlength=len(terms))
        c = np.bincount(term[y[own] <= 0], minlength=len(terms))
        of_term = (1 + np.log((1 + n) / (1 + df))) * np.log2(2 + a / np.maximum(1, c))
        self.of_term, self.of_other = of_term.astype(np.float32), 1 + np.log(1 + n)
        weight = (1 + np.log(count)) * of_term[term]
        norm = np.sqrt(np.bincount(own, weights=weight * weight, minlength=len(rows)))
        weight /= norm[own]
        # examples with the same most common terms (language, genre) are neighbours, which makes the bounds sharp
        common = [tuple(t[np.argsort(-df[t], kind="stable")[:3]].tolist()) for t, _ in rows]
        order = np.array(sorted(range(len(rows)), key=lambda i: (common[i], ids[i])), dtype=np.int64)
        place = np.empty(len(rows), dtype=np.int64)
        place[order] = np.arange(len(rows))
        self.ids, self.y = ids[order], y[order].astype(np.float64)
        self.base, self.blocks = (self.y.sum() + 1) / (len(rows) + 2), len(rows) // BLOCK + 1
        # lists of frequent terms are whole vectors, with their blocks' maxima
        frequent = np.flatnonzero((a + c) * FREQUENT > len(rows))
        frequent = np.sort(frequent[np.argsort(-(a + c)[frequent], kind="stable")[: DENSE_BYTES // (4 * self.blocks * BLOCK)]])
        self.dense_row = np.full(len(terms), -1, dtype=np.int32)
        self.dense_row[frequent] = np.arange(len(frequent))
        self.dense = np.zeros((len(frequent), self.blocks * BLOCK), dtype=np.float32)
        on = self.dense_row[term] >= 0
        self.dense[self.dense_row[term[on]], place[own[on]]] = weight[on]
        self.dense_most = self.dense.reshape(len(frequent), self.blocks, BLOCK).max(axis=2)
        term, own, weight = term[~on], own[~on], weight[~on]
        at = np.lexsort((place[own], term))
        narrow = np.min_scalar_type(max(len(rows), 1))
        self.example, self.weight = place[own][at].astype(narrow), weight[at].astype(np.float32)
        block = term[at] * (len(rows) // BLOCK + 1) + place[own][at] // BLOCK
        first = np.flatnonzero(np.concatenate((np.ones(min(len(block), 1), bool), block[1:] != block[:-1])))
        self.start = np.append(first, len(block)).astype(np.int32)
        self.block = (self.example[first] // BLOCK).astype(narrow)
        self.most = np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0, np.float32)
        self.term_start = np.searchsorted(term[at][first], np.arange(len(terms) + 1)).astype(np.int32)

    def vector(self, term: np.ndarray, count: np.ndarray, rest: float) -> np.ndarray:
        """Weights of a text's known terms by their counts; rest: the sum of (1 + log tf) ** 2 of its other words."""
        w = (1 + np.log(count)) * self.of_term[term]
        return w / max(float(np.sqrt(w @ w + rest * self.of_other**2)), 1e-12)

    def all_nearest(self, texts: Iterable[tuple[np.ndarray, np.ndarray, float]], skip: Iterable[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """`nearest` of each (term, count, rest), skip being the example that each leaves out. What frequent terms add is one
        product of matrices for some texts together."""
        texts, skip = iter(texts), iter(skip) if skip is not None else repeat(-1)
        while some := list(islice(texts, TOGETHER)):
            vectors = [self.vector(*t) for t in some]
            weights = np.zeros((len(some), len(self.dense)), dtype=np.float32)
            for n, (t, w) in enumerate(zip(some, vectors)):
                row = self.dense_row[t[0]]
                weights[n, row[row >= 0]] = w[row >= 0]
            for t, w, whole, most in zip(some, vectors, weights @ self.dense, weights @ self.dense_most):
                yield self.nearest(t[0], w, whole, most, skip=next(skip))

    def nearest(self, term: np.ndarray, w: np.ndarray, whole: np.ndarray, most: np.ndarray, k: int = NEIGHBOURS, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest to a text of known terms with the weights w, to which frequent ones add `whole`
        by example and at most `most` by block; nearest first, ties by id; only positive cosines count."""
        rare = self.dense_row[term] < 0
        term, w = term[rare], w[rare]
        lists = (self.term_start[term + 1] - self.term_start[term]).astype(np.int64)
        entry, w = expand(self.term_start[term], lists), np.repeat(w, lists)
        block = self.block[entry]
        bound = np.bincount(block, weights=w * self.most[entry], minlength=self.blocks) + most
        at, cosine, done = np.zeros(0, np.int64), np.zeros(0), np.zeros(self.blocks, dtype=bool)
        live = np.zeros(self.blocks, dtype=bool)
        live[np.argpartition(-bound, FIRST)[:FIRST] if self.blocks > FIRST else np.arange(self.blocks)] = True
        while True:
            live &= (bound > 0) & ~done
            if not live.any():
                break
            on = live[block]
            size = (self.start[entry[on] + 1] - self.start[entry[on]]).astype(np.int64)
            posting = expand(self.start[entry[on]], size)
            score = np.bincount(self.example[posting], weights=self.weight[posting] * np.repeat(w[on], size), minlength=len(whole))
            score = np.where(np.repeat(live, BLOCK), score + whole, 0)
            if skip >= 0:
                score[skip] = 0
            new = np.flatnonzero(score)
            at, cosine = np.concatenate((at, new)), np.concatenate((cosine, score[new]))
            if len(at) > k:
                best = np.argpartition(-cosine, k - 1)[:k]
                best = np.flatnonzero(cosine >= cosine[best].min() - 1e-6)  # with all that tie with the last
                at, cosine = at[best], cosine[best]
            done |= live
            live = bound >= (np.partition(cosine, -k)[-k] - 1e-5 if len(cosine) >= k else 0)
        order = np.lexsort((self.ids[at], -np.round(cosine, 6)))[:k]
        return at[order], cosine[order]

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        """Log odds of the votes, each weighted by 1 / distance, and of PRIOR votes at the base rate."""
        w = 1 / (1.02 - np.minimum(cosine, 1.0))
        yes = float(w @ self.y[at]) + PRIOR * self.base
        no = float(w @ (1 - self.y[at])) + PRIOR * (1 - self.base)
        return float(np.log(yes / no))


def numbered(examples: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(terms, ids, labels, rows) of examples(id, text, y), which max_examples and max_bytes bound, by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [words(t) for t in text_column(b, "text")]
            columns = [pa.array([h.tobytes() for h, _ in found], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *columns], ["id", "y", "hashes", "counts"])

    t = examples.select("id", "y", "text").mapInArrow(run, "id long, y int, hashes binary, counts binary").orderBy("id").toArrow()
    hashes = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()]
    counts = [np.frombuffer(x, np.int32) for x in t.column("counts").to_pylist()]
    terms, term = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_inverse=True)
    rows = list(zip(np.split(term, np.cumsum([len(h) for h in hashes])[:-1]), counts)) if hashes else []
    return terms, t.column("id").to_numpy(), t.column("y").to_numpy().astype(np.float64), rows


def known_words(docs: DataFrame, terms: np.ndarray, shared: Shared, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(id, text, *keep) -> (id, *keep, term binary, count binary, rest): the numbers of a text's known terms and
    their counts, and the sum of (1 + log tf) ** 2 of its other words. At each task's end comes a row without id whose
    term and count say in how many of the task's rows each term is, and whose rest says how many rows it had."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        total, n = np.zeros(len(known), dtype=np.int64), 0
        names = ["total", "id", *keep, "term", "count", "rest"]
        for b in batches:
            found = []
            for t in text_column(b, "text"):
                hashes, counts = words(t)
                at = places(known, hashes)
                on = at >= 0
                total[at[on]] += 1
                by = np.argsort(at[on])
                found.append((pack_numbers(at[on][by]), pack_counts(counts[on][by]), float(np.square(1 + np.log(counts[~on])).sum())))
            n += b.num_rows
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.binary(), pa.binary(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([pa.array([False] * b.num_rows), b.column("id"), *(b.column(k) for k in keep), *columns], names)
        at = np.flatnonzero(total)
        last = [[True], [None], *[[None]] * len(keep), [pack_numbers(at)], [pack_counts(total[at])], [float(n)]]
        types = [pa.bool_(), pa.int64(), *[pa.int32()] * len(keep), pa.binary(), pa.binary(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(last, types)], names)

    return docs.mapInArrow(run, "total boolean, id long, " + "".join(f"{k} int, " for k in keep) + "term binary, count binary, rest double")


def pack_numbers(ascending: np.ndarray) -> bytes:
    return np.diff(ascending.astype(np.int32), prepend=np.int32(0)).astype("<i4").tobytes()


def unpack_numbers(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, "<i4"), dtype=np.int64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Numbers below 255 as a byte, larger ones behind them in eight."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return small.tobytes() + counts[small == 255].astype("<i8").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(blob, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(blob, "<i8", offset=n)
    return out


def document_frequencies(found: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many rows each term is, and how many rows there are, from the tasks' totals: these are cut into ranges of
    terms, which are added up apart, so that what the driver gets is one row a range."""
    parts = default_parallelism(found.sparkSession)
    width = len(terms) // parts + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for term, count, rest in zip(*(b.column(c).to_pylist() for c in ("term", "count", "rest"))):
                at = unpack_numbers(term)
                n, ends = unpack_counts(count, len(at)), np.searchsorted(at, np.arange(parts + 1) * width)
                rows = [(k, at[a:z].tobytes(), n[a:z].astype(np.int64).tobytes(), rest if not k else 0.0) for k, (a, z) in enumerate(zip(ends[:-1], ends[1:])) if a < z or not k]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.float64()))], ["part", "term", "n", "rest"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf.part.iloc[0]) * width
        total = np.zeros(width, np.int64)
        for term, n in zip(pdf.term, pdf.n):
            total[np.frombuffer(term, np.int64) - first] += np.frombuffer(n, np.int64)
        return pd.DataFrame({"part": [pdf.part.iloc[0]], "n": [total.tobytes()], "rest": [pdf.rest.sum()]})

    sums = found.where("total").select("term", "count", "rest").mapInArrow(cut, "part int, term binary, n binary, rest double")
    out, rows = np.zeros(width * parts, np.int64), 0.0
    for r in sums.groupBy("part").applyInPandas(add, "part int, n binary, rest double").collect():  # a row a range, the terms are bounded
        out[r.part * width : (r.part + 1) * width] = np.frombuffer(r.n, np.int64)
        rows += r.rest
    return out[: len(terms)], int(rows)


def calibrate(shared: Shared, examples: DataFrame) -> tuple[float, float]:
    """(slope, shift) of the sigmoid that maps votes to probabilities, by all examples' votes without their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        place = {int(i): p for p, i in enumerate(ix.ids)}
        for b in batches:
            odds = [ix.vote(*near) for near in ix.all_nearest(unpacked(b), [place[i] for i in b.column("id").to_pylist()])]
            yield pa.RecordBatch.from_arrays([pa.array(odds, pa.float64()), b.column("y")], ["odds", "y"])

    t = examples.select("id", "y", "term", "count", "rest").mapInArrow(run, "odds double, y int").toArrow()  # max_examples rows
    odds, y = t.column("odds").to_numpy(), t.column("y").to_numpy()
    order = np.lexsort((y, odds))
    return sigmoid_fit(odds[order], y[order]) if 0 < y.sum() < len(y) else (1.0, 0.0)


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    for term, count, rest in zip(*(b.column(c).to_pylist() for c in ("term", "count", "rest"))):
        at = unpack_numbers(term)
        yield at, unpack_counts(count, len(at)), rest


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row for each row of docs: id_col, score (0 to 1), evidence (the three nearest examples with cosine, label).

    labels gives the examples (rows to learn from; the caller leaves out what is held out), of which the index takes
    max_examples of max_bytes together: these bound what is broadcast, not what is scored. Null and empty texts, and
    those without a word of any example, have no neighbour and get the calibrated base rate; without labels of both
    kinds every text gets its smoothed share of votes; equally near examples count by id; long texts are scored whole;
    repeated rows score alike; an empty table gives no row; other columns are ignored."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "toxicity")
    examples = sample(docs, labels, id_col, text_col, label_col, scratch, max_examples, max_bytes)
    terms, ids, y, rows = numbered(examples)
    vocabulary = Shared(spark, terms)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = scratch.table(known_words(texts, terms, vocabulary), "found")
    df, n = document_frequencies(found, terms)
    shared = Shared(spark, Index(terms, ids, y, rows, df, n))
    slope, shift = calibrate(shared, known_words(examples.select("id", "y", "text"), terms, vocabulary, keep=("y",)).where("not total"))
    vocabulary.destroy()
    scratch.drop("examples")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        kind = pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
        for b in batches:
            scores, evidence = [], []
            for at, cosine in ix.all_nearest(unpacked(b)):
                scores.append(float(1 / (1 + np.exp(-np.clip(slope * ix.vote(at, cosine) + shift, -60, 60)))))
                evidence.append([{"id": int(ix.ids[p]), "cosine": float(v), "label": int(ix.y[p])} for p, v in zip(at[:3], cosine[:3])])
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores, pa.float64()), pa.array(evidence, kind)], ["id", "score", "evidence"])

    dealt = found.where("not total").select("id", "term", "count", "rest").repartition(2 * default_parallelism(spark))
    return dealt.mapInArrow(run, "id long, score double, evidence array<struct<id: long, cosine: double, label: int>>").withColumnRenamed("id", id_col)
