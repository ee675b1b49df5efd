"""Quality classifier: naive Bayes support vectors over character n-gram indicators.

Each indicator is scaled by its class log-count ratio, a linear hinge-loss model is fitted by dual coordinate
descent, and margins are mapped to probabilities by a sigmoid fitted on out-of-fold margins. The fit reads a bounded
sample of labelled rows (max_examples, max_bytes, the first by a hash of the id); scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Shared, byte_column, pack, tidy, unpack

BITS = 17
MAX_EXAMPLES, MAX_BYTES = 6000, 64_000_000
CHUNK = 1 << 20


class Grams:
    """N-gram indicators of a text, hashed: its byte n-grams, blanks added at both ends; and the n-grams (n of RUNS) of
    a second view, which writes for each word behind the first whether it equals the word before it. Indicators that
    meet in one slot share it; none is overwritten."""

    RUNS = (2, 4, 8)

    def __init__(self, n: int = 3):
        self.n, self.flags = n, np.zeros(1 << BITS, dtype=bool)

    @staticmethod
    def hashes(symbols: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
        """The slot of each n-gram of symbols."""
        h = symbols[: len(symbols) - n + 1] + np.uint32(salt)
        for k in range(1, n):
            h *= np.uint32(0x9E3779B1)
            h ^= symbols[k : len(symbols) - n + 1 + k]
        if salt:
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h >>= np.uint32(32 - BITS)
        return h

    def of(self, data: bytes) -> np.ndarray:
        symbols = np.frombuffer(b" " + data + b" " * (self.n - 1), dtype=np.uint8)
        for at in range(0, len(symbols) - self.n + 1, CHUNK):  # long texts in pieces of bounded memory
            self.flags[self.hashes(symbols[at : at + CHUNK + self.n - 1].astype(np.uint32), self.n)] = True
        words = data.split()
        same = np.frombuffer(bytes(map(eq, words, words[1:])), dtype=np.uint8).astype(np.uint32)
        for n in self.RUNS:
            if len(same) >= n:
                self.flags[self.hashes(same, n, salt=0x10001 * n)] = True
        found = np.flatnonzero(self.flags)
        self.flags[found] = False
        return found


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * (weights[grams].sum() + bias) + shift)))"""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, grams: np.ndarray) -> float:
        z = self.slope * (float(self.weights[grams].sum()) + self.bias) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = np.full(1 << BITS, smooth), np.full(1 << BITS, smooth)
    for x, label in zip(rows, y):
        (p if label else q)[x] += 1
    return np.log((p / p.sum()) / (q / q.sum()))


def hinge(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = 1.0, epochs: int = 20, blend: float = 0.25) -> tuple[np.ndarray, float]:
    """Weights of the indicators and the bias: dual coordinate descent for L1-loss support vectors over the scaled
    indicators, then interpolated with the mean weight (Wang & Manning 2012)."""
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    norm = np.array([np.square(ratio[x]).sum() + 1 for x in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            x, s = rows[i], 1.0 if y[i] else -1.0
            g = s * (w[x] @ ratio[x] + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost)
            if (step := new - alpha[i]) != 0:
                alpha[i] = new
                w[x] += step * s * ratio[x]
                bias += step * s
                most = max(most, abs(step))
        if most < 1e-3:
            break
    mean = np.abs(w).mean()
    return ((1 - blend) * mean + blend * w) * ratio, blend * bias


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's slope and shift by damped Newton steps, with his smoothed targets."""
    pos, neg = int(y.sum()), int(len(y) - y.sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(margin).mean()), 1e-9)
    m, a, b = margin / scale, 1.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a, b):
        z = a * m + b
        return float(np.sum(np.logaddexp(0, z) - t * z))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -60, 60)))
        d, v = p - t, p * (1 - p) + 1e-12
        h = np.array([[np.sum(v * m * m) + 1e-9, np.sum(v * m)], [np.sum(v * m), np.sum(v) + 1e-9]])
        step = np.linalg.solve(h, [np.sum(d * m), np.sum(d)])
        size, old = 1.0, loss(a, b)
        while size > 1e-8 and loss(a - size * step[0], b - size * step[1]) > old:
            size /= 2
        a, b = a - size * step[0], b - size * step[1]
        if np.abs(size * step).max() < 1e-7:
            break
    return max(a, 0.0) / scale, b


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Without both classes the score is the smoothed share of label 1 (0.5 without labels)."""
    pos = int(y.sum()) if len(y) else 0
    if min(pos, len(y) - pos) < 2:
        share = (pos + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share))))
    margin, fold = np.zeros(len(y)), np.arange(len(y)) % 2
    for f in (0, 1):
        part = [rows[i] for i in np.flatnonzero(fold != f)]
        labels = y[fold != f]
        if labels.min() == labels.max():
            continue
        w, b = hinge(part, labels, log_count_ratio(part, labels))
        for i in np.flatnonzero(fold == f):
            margin[i] = w[rows[i]].sum() + b
    slope, shift = sigmoid_fit(margin, y)
    return Model(*hinge(rows, y, log_count_ratio(rows, y)), slope, shift)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, scratch: Scratch, max_examples: int, max_bytes: int) -> DataFrame:
    """(id, text, y), a written table: at most max_examples labelled rows, the first by a hash of the id, and of these
    the first whose texts have at most max_bytes together. A row without id, text row or label is no example; of several
    labels of one id the largest counts, of several texts the least."""
    one = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    chosen = one.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(max_examples)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text"))  # max_examples bounds what is broadcast
    rows = scratch.table(found, "examples")
    sizes = rows.select("id", F.octet_length("text").alias("size")).orderBy(F.xxhash64("id"), "id").toArrow()  # max_examples rows
    total = np.cumsum(sizes.column("size").to_numpy().astype(np.int64))
    if not len(total) or total[-1] <= max_bytes:
        return rows
    kept = sizes.column("id").to_pylist()[: int(np.searchsorted(total, max_bytes, side="right"))]
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in kept], "id long")), "id")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_examples: int = MAX_EXAMPLES, max_bytes: int = MAX_BYTES) -> Model:
    """Fits on the bounded sample (max_examples rows of max_bytes of text) in one task, and brings the weights (2**17
    numbers) to the driver."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = Grams()
        for b in batches:
            x = [pack(g.of(t).astype(np.int32)) for t in byte_column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(x, pa.binary())], ["id", "y", "x"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = fit([unpack(x, np.int32) for x in pdf.x], pdf.y.to_numpy())
        return pd.DataFrame({"w": [pack(m.weights)], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})

    scratch = Scratch(docs.sparkSession, "quality")
    rows = sample(docs, labels, id_col, text_col, label_col, scratch, max_examples, max_bytes).select("id", "y", "text").mapInArrow(grams, "id long, y int, x binary")
    got = rows.groupBy().applyInPandas(tidy(solve), "w binary, bias double, slope double, shift double").collect()
    scratch.clear()
    if not got:
        return fit([], np.zeros(0))
    return Model(unpack(got[0].w, np.float64), got[0].bias, got[0].slope, got[0].shift)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(id_col, score) for each row of docs: whole texts, null as empty; repeated rows score alike; an empty table
    gives no row. keep: columns of docs to return beside the score (if not empty, only these and the score)."""
    shared = Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, m = Grams(), shared.value
        for b in batches:
            s = [m.score(g.of(t)) for t in byte_column(b, "text")]
            others = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in others), pa.array(s, pa.float64())], [*others, "score"])

    kept = [F.col(k).alias(f"keep_{k}") for k in keep] or [F.col(id_col).cast("long").alias("id")]
    rows = docs.select(*kept, F.col(text_col).alias("text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema[:-1]) + "score double"
    return rows.mapInArrow(run, schema).withColumnsRenamed({"id": id_col} | {f"keep_{k}": k for k in keep})
