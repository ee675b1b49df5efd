"""Best-fit packing by minimum bin slack.

Bin after bin, a bitset subset-sum dynamic programme over the lengths still available finds the fullest feasible
combination, which is then removed. Pieces of one length are alike, so the programme runs over the histogram of
lengths, which has at most `capacity` entries whatever the corpus; and as the fullest combination stays the fullest
until one of its lengths runs out, it is taken as often as the counts allow. The plan is thus a bounded table of
(combination, times), made on the driver from the bounded histogram; Spark ranks the pieces of each length and
looks up where the plan puts each rank.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, default_parallelism, expand, text_column

CACHE_WORDS = 300_000
#: Parts that one call of the tokenizer encodes.
PARTS_A_CALL = 20_000
#: Characters of plain text after which a block is split and looked up.
BLOCK_CHARS = 8 << 20

SPACE, LETTER, DIGIT, OTHER = range(4)
#: What each Latin-1 byte is to the tokenizer below, and its lower case.
KINDS = np.array([SPACE if c in "\t\n\r " else DIGIT if c in "0123456789" else LETTER if c.isalpha() else OTHER for c in map(chr, range(256))], dtype=np.uint8)
LOWER = "".join(map(chr, range(256))).lower().encode("latin-1")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def blobs_of(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The bytes of ids up to each of the ends, from the one before."""
    data, stops = ids.tobytes(), (ids.itemsize * ends).tolist()
    return [data[a:b] for a, b in zip([0, *stops], stops)]


class WordTokenizer:
    """Ids of texts by a tokenizer of the word_bpe kind: it composes (NFC), collapses white space, lower-cases, splits
    into contractions ('s 't 're 've 'm 'll 'd), runs of letters, single digits and runs of anything else, and ends each part
    with a token marked as a word's end.

    Texts of plain characters, which are one Latin-1 byte each and stay so in lower case, are split here in that way, many at
    once: a block's parts become an Arrow dictionary, so that only its distinct ones are looked up in the bounded cache.
    Parts not yet known are encoded together, one call for many, and told apart by their end tokens; they are split and
    lower-cased already, which their tokenizer need not do again. Any other text (control characters, letters beyond
    Latin-1, special tokens' marks) is encoded by the tokenizer as it is."""

    PLAIN = re.compile(r"[\t\n\r\x20-\x7e\u00c0-\u00ff]*")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.of_parts = Tokenizer(self.tokenizer.model)
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "removed"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache: dict[bytes, bytes] = {}

    def ids(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), PARTS_A_CALL):
            some = new[at : at + PARTS_A_CALL]
            ids = self.ids(b" ".join(some).decode("latin-1"), self.of_parts)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) != len(some):  # not told apart: one by one
                self.cache.update((w, self.ids(w.decode("latin-1")).tobytes()) for w in some)
                continue
            self.cache.update(zip(some, blobs_of(ids, cut)))

    def split(self, texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The parts of plain texts in lower case, and where in them each text ends."""
        data = np.frombuffer("\n".join([*texts, "", ""]).encode("latin-1").translate(LOWER), dtype=np.uint8)
        kind = KINDS[data]
        solid = kind != SPACE
        first = solid.copy()
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        at = np.flatnonzero(first & (data == ord("'")))
        one, two = data[at + 1], data[at + 2]
        pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8)), 2, np.where(pair, 3, 0))
        at, size = at[size > 0], size[size > 0]
        first[at + 1] = False
        first[at + size] |= kind[at + size] == LETTER
        ends = np.searchsorted(np.flatnonzero(first), np.cumsum([len(t) + 1 for t in texts]))
        letters = data[solid]
        offsets = np.append(np.flatnonzero(first[solid]), len(letters)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
        return parts.dictionary_encode(), ends

    def plain(self, texts: list[str]) -> list[bytes]:
        parts, ends = self.split(texts)
        words, which = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()
        blobs = list(map(self.cache.get, words))
        if new := [n for n, b in enumerate(blobs) if b is None]:
            self.learn([words[n] for n in new])
            for n in new:
                blobs[n] = self.cache[words[n]]
        if len(self.cache) > CACHE_WORDS:  # what the last block had stays
            self.cache = dict(zip(words, blobs))
        size = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        ids = np.frombuffer(b"".join(blobs), dtype="<u4")[expand((np.cumsum(size) - size)[which], size[which])]
        return blobs_of(ids, np.append(0, np.cumsum(size[which]))[ends])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        out, block, room = [b""] * len(texts), [], BLOCK_CHARS
        for n, text in enumerate(texts):
            if "<|" in text or not self.PLAIN.fullmatch(text):
                out[n] = self.ids(text).tobytes()
                continue
            block.append(n)
            room -= len(text)
            if room <= 0:
                for k, data in zip(block, self.plain([texts[k] for k in block])):
                    out[k] = data
                block, room = [], BLOCK_CHARS
        for k, data in zip(block, self.plain([texts[k] for k in block])):
            out[k] = data
        return out


def tokenize(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """(id, piece, start, length, ids_crc32): each document's ids and the end id, cut every `capacity` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = WordTokenizer(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for b in batches:
            ids, rows = b.column("id").to_pylist(), []
            for i, data in zip(ids, tok.encode(text_column(b, "text"))):
                data += end
                for n, s in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[s : s + 4 * capacity]
                    rows.append((i, n, s // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "piece", "start", "length", "ids_crc32"])

    schema = "id long, piece int, start long, length long, ids_crc32 long"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def fullest(lengths: list[int], counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination [(length, copies)] of at most `capacity`, large lengths first among equals.
    lengths ascend; reach[i] is the bitset of the sums of the first i lengths."""
    mask, reach = (1 << capacity + 1) - 1, [1]
    for length, count in zip(lengths, counts):
        r, left, step = reach[-1], min(count, capacity // length), 1
        while left > 0:
            take = min(step, left)
            r |= r << take * length
            left -= take
            step *= 2
        reach.append(r & mask)
    total, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(lengths) - 1, -1, -1):
        if not total:
            break
        for copies in range(min(counts[i], total // lengths[i]), -1, -1):
            if reach[i] >> total - copies * lengths[i] & 1:
                break
        if copies:
            chosen.append((lengths[i], copies))
            total -= copies * lengths[i]
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """[(combination, times)] which uses every piece of the histogram once."""
    left = {k: v for k, v in histogram.items() if v}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("a length is not in 1..capacity")
    out = []
    while left:
        lengths = sorted(left)
        best = fullest(lengths, [left[k] for k in lengths], capacity)
        times = min(left[k] // c for k, c in best)
        out.append((best, times))
        for k, c in best:
            left[k] -= c * times
            if not left[k]:
                del left[k]
    return out


def layout(steps: list[tuple[list[tuple[int, int]], int]]) -> np.ndarray:
    """Rows (length, first rank, copies, first sequence, offset in the sequence), sorted by length and rank."""
    rows, used, sequence = [], {}, 0
    for combination, times in steps:
        offset = 0
        for length, copies in combination:
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += copies * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces(id, piece, start, length, ids_crc32).

    Ranks within a length come from counts by (length, salt), so that a length which a third of all pieces have is
    ranked by many tasks."""
    spark = pieces.sparkSession
    salts = default_parallelism(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most capacity histogram rows reach the driver
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}
    table = spark.sparkContext.broadcast(layout(plan(histogram, capacity)))
    before = counts.selectExpr("length", "salt", "sum(n) over (partition by length order by salt rows between unbounded preceding and current row) - n as base")
    ranked = salted.selectExpr("*", "row_number() over (partition by length, salt order by id, piece, start, ids_crc32) - 1 as r")
    ranked = ranked.join(before, ["length", "salt"]).selectExpr("id", "piece", "start", "length", "ids_crc32", "cast(base + r as long) as r")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        key = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            length, r = (b.column(n).to_numpy() for n in ("length", "r"))
            row = t[np.searchsorted(key, (length << 48) + r, side="right") - 1]
            nth, slot = np.divmod(r - row[:, 1], row[:, 2])
            cols = [b.column(n) for n in ("id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(row[:, 3] + nth), pa.array(row[:, 4] + slot * length)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tokenizer_path: str | None = None, end_id: int = 0) -> DataFrame:
    """One row for each piece of each row of docs: id_col, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; documents longer than capacity are cut into pieces of it; repeated
    rows and tied lengths are packed like any other; an empty table gives no row; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.table(tokenize(docs, id_col, text_col, capacity, tokenizer_path or default_tokenizer(), end_id), "pieces")
    return pack_pieces(pieces, capacity).withColumnRenamed("id", id_col)
