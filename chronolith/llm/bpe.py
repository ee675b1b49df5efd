"""Byte-level BPE: encoding by a global shuffle of distinct words, decoding by a join with the token-byte table.

A task cuts its documents into blocks of bounded size and their texts into pre-tokens. At each position a document keeps
the number that its word has in the block, so that a word, however frequent, leaves a block at most once: what is shuffled is
aggregated before. By their hash the distinct words of all blocks meet in shards, where each is encoded once; the ids join
their block again by its words' numbers, and are put together by position. The words that a block sends to one shard travel
as one row, and blocks are written in buckets, so that positions are never shuffled.

Decoding joins each id with the token-byte table. The table has one row for each entry of the vocabulary, which is its size
bound, so it is broadcast and the join needs no shuffle.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, Shared, buckets_for, default_parallelism, expand, give_back, pack, text_column, unpack

#: Bytes of text after which a block ends; a longer document is a block by itself.
BLOCK_BYTES = 32 << 20
#: Bytes of text for each shard of words; its distinct words are a fraction of them.
SHARD_BYTES = 64 << 20
MOST_BUCKETS = 10_000
NARROW = 1 << 16


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file's entries: bytes and their id, which is their rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def ranges(codes: np.ndarray) -> str:
    """Ascending code points as the inside of a character class."""
    cuts = np.flatnonzero(np.diff(codes) != 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[[0, *(cuts + 1)]], codes[[*cuts, -1]])) if len(codes) else ""


@lru_cache
def classes() -> tuple[dict[str, str], str]:
    """The letters and the numbers as the encoding library knows them, and the characters on which this one differs."""
    every, known, unlike = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])), {}, np.empty(0, dtype=np.int64)
    for name in (r"\p{L}", r"\p{N}"):
        single = tiktoken.Encoding("bytes", pat_str=name, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        theirs, ours = (np.array([ord(c) for c in found]) for found in (single.decode(single.encode_ordinary(every)), regex.findall(name, every)))
        known[name], unlike = ranges(theirs), np.union1d(unlike, np.setxor1d(theirs, ours))
    return known, ranges(unlike)


class Splitter:
    """Splits texts into pre-tokens. Libraries know letters and numbers of different Unicode versions; texts with characters
    on which they differ are split by the encoding library's classes, spelt out."""

    def __init__(self, pattern: str):
        known, self.unlike = classes()
        self.pattern = self.exact = pattern
        for name, inside in known.items():
            self.exact = self.exact.replace(name, f"[{inside}]")

    def ready(self) -> Splitter:
        """Compiles the patterns, once in a task."""
        self.plain, self.odd = regex.compile(self.pattern), regex.compile(f"[{self.unlike}]") if self.unlike else None
        self.spelt = regex.compile(f"(?V1){self.exact}") if self.unlike else self.plain
        return self

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.odd or not self.odd.search(text):
            return self.plain.findall(text)
        return self.spelt.findall(text)


def joined_words(words: list[str]) -> tuple[bytes, bytes]:
    """Words as one compressed frame, and the sizes of their UTF-8 forms."""
    raw = [w.encode() for w in words]
    return pack(np.frombuffer(b"".join(raw), dtype=np.uint8)), pack(np.array([len(w) for w in raw], dtype="<u4"))


def cut_words(frame: bytes, sizes: bytes) -> list[bytes]:
    """The UTF-8 forms of joined words."""
    data, ends = unpack(frame, np.uint8).tobytes(), np.cumsum(unpack(sizes, "<u4")).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends)]


class Block:
    """Words of some documents by number, in order of their first use."""

    def __init__(self, block: int):
        self.block, self.known, self.size = block, {}, 0

    def sequence(self, text: str, words: list[str]) -> bytes:
        """The words' numbers, compressed, behind how many bytes each takes."""
        self.size += len(text.encode())
        numbers = [self.known.setdefault(w, len(self.known)) for w in words]
        width = b"2" if len(self.known) <= NARROW else b"4"
        return width + pack(np.array(numbers, dtype=f"<u{width.decode()}")) if words else b""

    def by_shard(self, shards: int) -> list[tuple[int, int, bytes, bytes, bytes]]:
        """(block, shard, the words' numbers, the words, their sizes): the distinct words, dealt by their hash."""
        words = np.array(sorted(self.known), dtype=object)
        shard = np.fromiter((xxhash.xxh64_intdigest(w) % shards for w in words), np.int64, len(words))
        out, order = [], np.argsort(shard, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            numbers = np.fromiter((self.known[w] for w in words[some]), "<u4", len(some))
            out.append((self.block, int(shard[some[0]]), pack(numbers), *joined_words(words[some])))
        return out


def into_blocks(docs: DataFrame, text_col: str, keep: list[str], shared: Shared, block_bytes: int, shards: int) -> DataFrame:
    """Rows of two kinds: of each document (block, own, sequence), own being what is kept of it; and of each block's words
    that go to a shard (block, shard, numbers, words, sizes)."""
    rows = docs.select(F.struct(*keep).alias("own"), F.col(text_col).cast("string").alias("text"))
    own = T.StructField("own", rows.schema["own"].dataType)  # null in rows of words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = shared.value[0].ready()
        block, kind = Block(TaskContext.get().partitionId() << 32), None
        names = ["block", "own", "sequence", "shard", "numbers", "words", "sizes"]

        def documents(number, owns, sequences):
            n = len(sequences)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, number), pa.int64()), owns, pa.array(sequences, pa.binary()), *none], names)

        def words(done):
            found = done.by_shard(shards)
            for at in range(0, len(found), 1000):
                cols = list(zip(*found[at : at + 1000]))
                types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                number, *rest = [pa.array(c, t) for c, t in zip(cols, types)]
                yield pa.RecordBatch.from_arrays([number, pa.nulls(len(number), kind), pa.nulls(len(number), pa.binary()), *rest], names)

        for b in batches:
            owns, kind, since, sequences = b.column("own"), b.column("own").type, 0, []
            for n, text in enumerate(text_column(b, "text"), 1):
                sequences.append(block.sequence(text, splitter.split(text)))
                if block.size >= block_bytes:
                    yield documents(block.block, owns.slice(since, n - since), sequences)
                    yield from words(block)
                    block, since, sequences = Block(block.block + 1), n, []
            if sequences:
                yield documents(block.block, owns.slice(since, len(sequences)), sequences)
        yield from words(block)
        give_back()

    rest = [("shard", T.LongType()), ("numbers", T.BinaryType()), ("words", T.BinaryType()), ("sizes", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([T.StructField("block", T.LongType()), own, T.StructField("sequence", T.BinaryType()), *(T.StructField(*f) for f in rest)]))


def encode_shard(shared: Shared) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        splitter, ranks = shared.value
        encoding = tiktoken.Encoding("ranks", pat_str=splitter.pattern, mergeable_ranks=ranks, special_tokens={})
        number_of: dict[bytes, int] = {}
        used = []
        for frame, sizes in zip(rows.column("words").to_pylist(), rows.column("sizes").to_pylist()):
            used.append(np.array([number_of.setdefault(w, len(number_of)) for w in cut_words(frame, sizes)], dtype=np.int64))
        ids = [encoding.encode_ordinary(w.decode()) for w in number_of]  # each distinct word once
        size = np.array(list(map(len, ids)), dtype=np.int64)
        start, values = np.cumsum(size) - size, np.fromiter((i for w in ids for i in w), "<u4", int(size.sum()))
        found = [(pack(size[u].astype("<u4")), pack(values[expand(start[u], size[u])])) for u in used]
        give_back()
        return pa.table({"block": rows.column("of"), "numbers": rows.column("numbers"), "sizes": pa.array([a for a, _ in found], pa.binary()), "ids": pa.array([b for _, b in found], pa.binary())})

    return run


def put_together(docs: pa.Table, found: pa.Table) -> pa.Table:
    """The documents of a block with their ids, by the positions of their words."""
    columns = (found.column(c).to_pylist() for c in ("numbers", "sizes", "ids"))
    number, size, values = (np.concatenate([np.empty(0, "<u4"), *(unpack(x, "<u4") for x in c)]) for c in columns)
    sizes, starts = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
    sizes[number], starts[number] = size, np.cumsum(size, dtype=np.int64) - size
    ids, values = [], values.astype(np.int32)
    for blob in docs.column("sequence").to_pylist():
        sequence = unpack(blob[1:], f"<u{blob[:1].decode()}") if blob else np.empty(0, np.int64)
        ids.append(values[expand(starts[sequence], sizes[sequence])] if blob else values[:0])
    ends = np.cumsum([0, *map(len, ids)])
    column = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([values[:0], *ids]), pa.int32())).cast(pa.list_(pa.int32()))
    give_back()
    return pa.table({"own": docs.column("own"), "ids": column})


def bucketed(rows: DataFrame, column: str, path: str, buckets: int) -> DataFrame:
    """The rows, written in buckets by a column, so that grouping by it needs no shuffle. The catalog keeps no trace."""
    spark, name = rows.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"drop table {name}")  # the files are not the catalog's
    return table


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, ranks_path: str | None = None, pattern: str | None = None, ids_col: str = "ids", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, as far as `keep` names their columns (None: all but the text), with the ids of their whole text.

    A null text is an empty one and has no ids. Repeated rows are encoded as rows; nothing depends on ids or on order, so
    there are no ties. A very long text is a block by itself and has to fit in a task, as its row does. An empty table gives
    no rows. Columns of any name may be kept but `ids_col`. The blocks are written in the shared folder, and the result reads
    them there: the folder's owner deletes them when it is no longer read."""
    spark, keep = docs.sparkSession, [c for c in docs.columns if c != text_col] if keep is None else keep
    if ids_col in keep:
        raise ValueError(f"{ids_col} is a column of the documents: name another for the ids")
    if not keep:
        docs, keep = docs.withColumn("no_column", F.lit(None).cast("int")), ["no_column"]
    scratch = Scratch(spark, "bpe")
    shared = Shared(spark, (Splitter(pattern or default_pattern()), read_ranks(ranks_path or default_ranks())))
    made = into_blocks(docs, text_col, keep, shared, block_bytes, buckets_for(docs, text_col, SHARD_BYTES))
    blocks = bucketed(made, "block", f"{scratch.base}/blocks", min(MOST_BUCKETS, default_parallelism(spark)))
    shards = blocks.where("shard is not null").select("shard", F.col("block").alias("of"), "numbers", "words", "sizes")
    found = shards.groupBy("shard").applyInArrow(encode_shard(shared), "block long, numbers binary, sizes binary, ids binary")
    own = blocks.schema["own"]
    rows = blocks.where("shard is null").select("block", "own", "sequence")
    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(put_together, T.StructType([own, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    return out.select(*([] if keep == ["no_column"] else ["own.*"]), F.col("ids").alias(ids_col))


def token_bytes(spark: SparkSession, ranks_path: str | None = None) -> tuple[np.ndarray, pa.Array]:
    """The token-byte table, ordered by id."""
    ranks = sorted((i, t) for t, i in read_ranks(ranks_path or default_ranks()).items())
    return np.array([i for i, _ in ranks]), pa.array([t for _, t in ranks], pa.binary())


def decode(rows: DataFrame, ids_col: str = "ids", keep: list[str] | None = None, ranks_path: str | None = None, bytes_col: str = "bytes") -> DataFrame:
    """The rows, as far as `keep` names their columns (None: all but the ids), with the bytes that their ids stand for: each
    id is joined with its row of the token-byte table. Bytes need not be UTF-8, as ids may be cut anywhere.

    Null ids give null bytes, no ids empty ones; a list with a null or with an id that the table does not have gives null.
    Repeated rows stay; an empty table gives no rows."""
    keep = [c for c in rows.columns if c != ids_col] if keep is None else keep
    if bytes_col in keep:
        raise ValueError(f"{bytes_col} is a kept column: name another for the bytes")
    shared = Shared(rows.sparkSession, token_bytes(rows.sparkSession, ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = shared.value
        for b in batches:
            out = []
            for row in b.column("ids"):
                ids = None if not row.is_valid else row.values.to_numpy(zero_copy_only=False)
                if ids is None or not len(ids):
                    out.append(None if ids is None else b"")
                    continue
                at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
                if not (known[at] == ids).all():
                    out.append(None)
                    continue
                joined = table.take(pa.array(at))
                data, ends = joined.buffers()[2], np.frombuffer(joined.buffers()[1], dtype=np.int32)
                out.append(data.slice(int(ends[joined.offset]), int(ends[joined.offset + len(joined)] - ends[joined.offset])).to_pybytes())
            yield pa.RecordBatch.from_arrays([b.column("own"), pa.array(out, pa.binary())], names=["own", "bytes"])

    given = rows.select(F.struct(*keep, *([] if keep else [F.lit(0).alias("no_column")])).alias("own"), F.col(ids_col).cast("array<int>").alias("ids"))
    made = given.mapInArrow(run, T.StructType([given.schema["own"], T.StructField("bytes", T.BinaryType())]))
    return made.select(*(["own.*"] if keep else []), F.col("bytes").alias(bytes_col))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), one row for each row of docs: digests of each text's ids, joined by blanks,
    and of the bytes that they decode to. Null and empty texts have no ids and decode to no bytes; null and repeated ids are
    ids like others, and equal texts give equal digests; long texts count whole; other columns are not read, whatever their
    names; an empty table gives no rows. There are no ties."""
    encoded = encode(docs, text_col, [id_col], ranks_path, pattern)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    kept = encoded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), "ids")
    return decode(kept, ranks_path=ranks_path).select(id_col, "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
