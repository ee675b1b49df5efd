"""Media columns by signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over the stored bytes; a validator for
each format walks its structure and confirms it and its length. A format confirmed at offset 0 corrects a wrong
declared type; formats confirmed further inside are carved as (type, offset, length).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_column

UNIT = 64


Memo = dict


def follow(step: Callable, state: tuple, memo: Memo) -> tuple[int, int]:
    """(end, flags) of the structure that starts in a state: step gives the next state, or the end (0: broken), and a
    flag. States lie further and further behind, and each is stepped through once for a whole file, so that many starts
    that lead into the same structure cost its length once."""
    path = []
    while state not in memo:
        after, flag = step(state)
        path.append((state, flag))
        if isinstance(after, int):
            end, flags = after, 0
            break
        state = after
    else:
        end, flags = memo[state]
    for s, flag in reversed(path):
        flags |= flag
        memo[s] = end, flags
    return end, flags


def wav(d: bytes, at: int, memo: Memo) -> int:
    """Length of the RIFF/WAVE file at a place, 0 if there is none. A fmt chunk must come before data."""
    if len(d) < at + 44 or d[at : at + 4] != b"RIFF" or d[at + 8 : at + 12] != b"WAVE":
        return 0

    def step(state):
        p = state[1]
        if p + 8 > len(d):
            return 0, 0
        kind, size = d[p : p + 4], struct.unpack_from("<I", d, p + 4)[0]
        if kind == b"data":
            return p + 8 + size, 0
        return ("chunk", p + 8 + size + size % 2), int(kind == b"fmt " and size >= 16)

    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    last, fmt = follow(step, ("chunk", at + 12), memo)
    return end - at if fmt and last and last <= end <= len(d) else 0


def wav_samples(d: bytes) -> memoryview:
    """The data chunk of a valid file."""
    at = 12
    while d[at : at + 4] != b"data":
        at += 8 + (n := struct.unpack_from("<I", d, at + 4)[0]) + n % 2
    return memoryview(d)[at + 8 : at + 8 + struct.unpack_from("<I", d, at + 4)[0]]


def png(d: bytes, at: int, memo: Memo) -> int:
    if d[at + 8 : at + 16] != b"\0\0\0\x0dIHDR":
        return 0

    def step(state):
        p = state[1]
        if p + 12 > len(d):
            return 0, 0
        end = p + 12 + struct.unpack_from(">I", d, p)[0]
        if end > len(d) or zlib.crc32(memoryview(d)[p + 4 : end - 4]) != struct.unpack_from(">I", d, end - 4)[0]:
            return 0, 0
        return (end if d[p + 4 : p + 8] == b"IEND" else ("chunk", end)), 0

    end = follow(step, ("chunk", at + 8), memo)[0]
    return end - at if end else 0


def gif(d: bytes, at: int, memo: Memo) -> int:
    if len(d) < at + 14:
        return 0

    def step(state):
        kind, p = state
        if p >= len(d):
            return 0, 0
        if kind == "parts":
            return ("parts" if d[p] else "block", p + d[p] + 1), 0
        if d[p] == 0x3B:
            return p + 1, 0
        if d[p] == 0x21:
            return ("parts", p + 2), 0
        if d[p] == 0x2C and p + 10 < len(d):
            return ("parts", p + 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0)), 1
        return 0, 0

    end, image = follow(step, ("block", at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)), memo)
    return end - at if end and image else 0


def jpeg(d: bytes, at: int, memo: Memo) -> int:
    def step(state):
        kind, p = state
        if kind == "scan":
            p = d.find(b"\xff", p)
            if p < 0 or p + 1 >= len(d):
                return 0, 0
            if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                return ("scan", p + 2), 0
            return (p + 2, 0) if d[p + 1] == 0xD9 else (("marker", p), 0)
        if p + 4 > len(d) or d[p] != 0xFF:
            return 0, 0
        mark, size = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if not 0xC0 <= mark <= 0xFE or mark in (0xD8, 0xD9) or size < 2:
            return 0, 0
        return ("scan" if mark == 0xDA else "marker", p + 2 + size), 0

    end = follow(step, ("marker", at + 2), memo)[0]
    return end - at if end else 0


def bmp(d: bytes, at: int, memo: Memo) -> int:
    if len(d) < at + 54:
        return 0
    size, zero, start, header = struct.unpack_from("<IIII", d, at + 2)
    planes, depth = struct.unpack_from("<HH", d, at + 26)
    fits = 54 <= start <= size <= len(d) - at and not zero and header in (40, 108, 124) and planes == 1
    return size if fits and depth in (1, 4, 8, 16, 24, 32) else 0


def gzipped(d: bytes, at: int, memo: Memo) -> int:
    """A member inside a confirmed member is its data, and is not looked for."""
    if len(d) < at + 18 or d[at + 3] & 0xE0 or at < memo.get("end", 0):
        return 0
    unzip, p = zlib.decompressobj(31), at
    try:
        while p < len(d) and not unzip.eof:
            part = d[p : p + (1 << 16)]
            p += len(part)
            while part and not unzip.eof:
                unzip.decompress(part, 1 << 20)
                part = unzip.unconsumed_tail
    except zlib.error:
        return 0
    if not unzip.eof:
        return 0
    memo["end"] = p - len(unzip.unused_data)
    return memo["end"] - at


def pdf(d: bytes, at: int, memo: Memo) -> int:
    """Up to the last end mark before the next header: an updated file has several."""
    stop = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, stop if stop >= 0 else len(d))
    return end + 5 - at if d[at + 5 : at + 6].isdigit() and end > 0 and d.find(b"startxref", at, end) > 0 else 0


#: Magic bytes, media type and validator of each format.
FORMATS: list[tuple[bytes, str, Callable[[bytes, int, Memo], int]]] = [
    (b"RIFF", "audio/wav", wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", png),
    (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif),
    (b"\xff\xd8\xff", "image/jpeg", jpeg),
    (b"BM", "image/bmp", bmp),
    (b"\x1f\x8b\x08", "application/gzip", gzipped),
    (b"%PDF-", "application/pdf", pdf),
]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for n, (magic, _, _) in enumerate(FORMATS):
        a.add_word(magic.decode("latin-1"), (n, len(magic)))
    a.make_automaton()
    return a


def sniff(data: bytes, find: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Confirmed (type, offset, length), by offset. Formats inside another confirmed one are found as well, unless
    they are the same kind of file at the same offset."""
    memos, out = [{} for _ in FORMATS], []
    for last, (n, size) in find.iter(data.decode("latin-1")):
        _, kind, check = FORMATS[n]
        at = last - size + 1
        if length := check(data, at, memos[n]):
            out.append((kind, at, length))
    return sorted(out, key=lambda x: (x[1], -x[2], x[0]))


def little_endian(n: Column) -> Column:
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)]))


def as_wav(payload: Column) -> Column:
    """A binary column stored as 8-bit mono PCM; even payload lengths below 4 GB."""
    n = F.length(payload)
    head = [F.lit(b"RIFF"), little_endian(n + 36), F.lit(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data"), little_endian(n)]
    return F.concat(*head, payload)


def padded(text: Column) -> Column:
    """The text's UTF-8 bytes (null: none) and bytes 0 up to a positive multiple of 64."""
    raw = F.coalesce(text.cast("string"), F.lit("")).cast("binary")
    size = F.greatest(F.ceil(F.length(raw) / UNIT) * UNIT, F.lit(UNIT)).cast("int")
    return F.concat(raw, F.unhex(F.repeat(F.lit("00"), size - F.length(raw))))


def feature(samples: np.ndarray) -> str:
    """Statistics of 8-bit samples: count, mean, deviation, crossings of the middle, and a 16-bin histogram."""
    s = samples.astype(np.int64)
    total, squares = int(s.sum()), int((s * s).sum())
    n = len(s)
    crossings = int(np.count_nonzero((s[1:] >= 128) != (s[:-1] >= 128)))
    bins = ".".join(map(str, np.bincount(s >> 4, minlength=16).tolist()))
    return f"n={n};mean={total / n:.6f};dev={max(squares / n - (total / n) ** 2, 0) ** 0.5:.6f};cross={crossings};hist={bins}"


def inspect(media: DataFrame, id_col: str, media_col: str, declared_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of media: id_col, declared_type, media_type (confirmed at offset 0; else null),
    corrected, media_bytes, media_sha256, payload (of audio/wav: the samples; else null) as payload_bytes,
    payload_sha256, tail_crc32, feature, and carved array<struct<type, offset, length>>; then the columns in keep.

    Null and empty media have no type and nothing carved; long media are read whole, in time that grows with them; of
    several formats at one offset the longest comes first; repeated rows give repeated results; other columns are
    ignored; an empty table gives no row."""
    carved_type = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
    names = ["id", "declared_type", "media_type", "corrected", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature", "carved"]
    types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), carved_type]

    def one(data: bytes, declared: str | None, find) -> tuple:
        found = sniff(data, find)
        kind = next((k for k, at, _ in found if not at), None)
        carved = [{"type": k, "offset": at, "length": n} for k, at, n in found if at]
        row = [declared, kind, kind is not None and kind != declared, len(data), hashlib.sha256(data).hexdigest()]
        if kind != "audio/wav":
            return (*row, None, None, None, None, carved)
        samples = wav_samples(data)
        return (*row, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-UNIT:]), feature(np.frombuffer(samples, np.uint8)) if len(samples) else "n=0", carved)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for b in batches:
            rows = [one(d, t, find) for d, t in zip(byte_column(b, "media"), b.column("declared").to_pylist())]
            cols = list(zip(*rows)) if rows else [[]] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types[1:])), *(b.column(f"keep_{k}") for k in keep)], [*names, *(f"keep_{k}" for k in keep)])

    picked = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"), F.col(declared_col).cast("string").alias("declared"), *(F.col(k).alias(f"keep_{k}") for k in keep))
    schema = "id long, declared_type string, media_type string, corrected boolean, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, carved array<struct<type: string, offset: long, length: long>>"
    schema += "".join(f", {f.name} {f.dataType.simpleString()}" for f in picked.schema if f.name.startswith("keep_"))
    return picked.mapInArrow(run, schema).withColumnsRenamed({"id": id_col} | {f"keep_{k}": k for k in keep})
