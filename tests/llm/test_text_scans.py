import gzip
import hashlib
import re
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from chronolith.llm import decontam, licenses, media
from chronolith.llm.queries import QUERIES

from .awkward import empty, table

PNG = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(b"\0\0")), (b"IEND", b"")))
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x4c\x01\x00\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04ab\x12\xff\x00\x34\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
PDF = b"%PDF-1.4\nstartxref\n9\n%%EOF"


def test_media_query_matches_plain_code(spark, sf):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op6_media_sniffing"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        pay = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        wav = b"RIFF" + struct.pack("<I", 36 + len(pay)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(pay)) + pay
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert (r.media_bytes, r.media_sha256, r.media_type, r.corrected) == (len(wav), hashlib.sha256(wav).hexdigest(), "audio/wav", True)


def test_formats_are_confirmed_corrected_and_carved(spark):
    zipped = gzip.compress(b"hello hello", mtime=0)
    files = {"image/png": PNG, "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/gzip": zipped, "application/pdf": PDF}
    rows = [(n, d, "audio/wav") for n, d in enumerate(files.values())]
    rows += [(20, b"junk" + PNG + b"--" + GIF + b"BM too short", "image/png"), (21, PNG[:-1], "image/png"), (22, None, None), (23, b"", "x"), (24, PNG, "image/png")]
    df = spark.createDataFrame(rows, "id long, media binary, declared string").withColumn("feature", F.lit(1)).withColumn("text", F.lit("t"))
    got = {r.id: r for r in media.inspect(df, "id", "media", "declared").collect()}
    assert [got[n].media_type for n in range(len(files))] == list(files) and all(got[n].corrected for n in range(len(files)))
    assert [tuple(c) for c in got[20].carved] == [("image/png", 4, len(PNG)), ("image/gif", 6 + len(PNG), len(GIF))]
    assert got[20].media_type is got[21].media_type is got[22].media_type is got[23].media_type is None
    assert not got[24].corrected and not got[21].carved


def plain_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = sorted(i for i, _ in hits)
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in hits}))


def test_license_query_matches_plain_code(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op7_license_scan"](spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_base > 0 for r in rows) > 10
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(docs[r.doc_id])
        assert {*r.base_labels.split(",")} - {""} <= {*r.labels.split(",")} and 0 <= r.score <= 1


def test_notices_with_edits(spark):
    texts = ["MIT Licence, see file", "Apache License. Apache license", "Lizenz ÄÖ gnu genral publik license", "permision is hereby granted, free of charge, to any person obtaining copy of this software", "nothing here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[n].labels for n in range(6)] == ["mit", "apache", "gpl", "mit", "", ""]
    assert got[1].n_base == 2 and (got[1].first_word, got[1].last_word) == (0, 2) and got[1].score == 1
    assert 0 < got[0].score < 1 and got[0].spans[0].edits == 1 and got[4].score == 0


def test_seeds_miss_no_fuzzy_match():
    import regex

    scanner = licenses.Scanner()
    base = "some words redistribution and use in source and binry forms wth or without modifcation are permited and all right reserved by nobody mozila public licence"
    for n, (notice, edits, _) in enumerate(licenses.NOTICES):
        whole = [(m.start() - 1, m.end() - 1) for m in scanner.patterns[n].finditer(f" {base} ")]
        near = [(s.start, s.end) for s in scanner.spans(base) if s.notice == notice]
        assert len(whole) == len(near) and all(abs(a - c) <= edits for (a, _), (c, _) in zip(whole, near)), notice
    assert regex.__name__ == "regex"


def test_notices_close_together_against_edit_distances():
    """Of all stretches of whole words within the edits the best go first; each other that overlaps none is a span too."""

    def edits_of(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    def brute(text, notice, edits):
        starts = [0, *[i + 1 for i, c in enumerate(text) if c == " "]]
        ends = [*[i for i, c in enumerate(text) if c == " "], len(text)]
        near = [(a, b) for a in starts for b in ends if abs(b - a - len(notice)) <= edits]
        found = sorted((d, a, b) for a, b in near if (d := edits_of(text[a:b], notice)) <= edits)
        out = []
        for d, a, b in found:
            if all(b <= c or e <= a for c, e, _ in out):
                out.append((a, b, d))
        return sorted(out)

    texts = [
        "mit licence mit license",
        "mit license mit licence",
        "mit licence mit licens mit license and mit licence",
        "bsd licence mit licence apache licence bsd license mit license apache license bsd licens",
        "all right reserved all rights reserved all rigths reserved all rights reservd",
        "mozila public license mozilla public license mozilla public licence gnu generl public license gnu general public license",
        "gnu general public licence gnu general public license gnu lesser general public licence gnu lesser general public license",
    ]
    scanner = licenses.Scanner()
    for text in texts:
        for notice, edits, _ in licenses.NOTICES:
            got = [(s.start, s.end, s.edits) for s in scanner.spans(text) if s.notice == notice]
            assert got == brute(text, notice, edits), (text, notice)


def plain_tiles(a, b, least):
    """Greedy string tiling as it is defined: longest first, by comparing all places."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        covered += n


@pytest.mark.parametrize("seed", range(60))
def test_tiles_equal_greedy_tiling(seed):
    import random

    rng = random.Random(seed)
    kinds = rng.choice([2, 3, 8])
    a, b = [rng.randrange(kinds) for _ in range(rng.randrange(1, 30))], [rng.randrange(kinds) for _ in range(rng.randrange(1, 40))]
    least = rng.choice([1, 2, 3, 5])
    assert sum(t[2] for t in decontam.tile(a, b, least)) == plain_tiles(a, b, least)


def test_leak_query_equals_greedy_tiling_of_every_pair(spark, tmp_path):
    """The whole query on a small fixture against tiling each document with each item, no seeds and no hashes."""
    import random

    rng = random.Random(5)
    words = [f"w{n}" for n in range(40)]
    items = [(n, " ".join(rng.choice(words) for _ in range(rng.choice([3, 6, 14, 30])))) for n in range(12)] + [(12, None), (13, "")]
    docs = []
    for n in range(40):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randrange(12)))]
        for _ in range(rng.randrange(3)):
            cut = items[rng.randrange(12)][1].split()
            at = rng.randrange(len(cut))
            parts += [" ".join(cut[at:]), rng.choice(["", "x y", "z"]), " ".join(cut[:at])]
        docs.append((n, " ".join(parts) if n else None))
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.item_tokens, r.covered_tokens) for r in QUERIES["op1_benchmark_decontamination"](spark, str(tmp_path)).collect()}
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = decontam.tokens(item), decontam.tokens(text)
            covered = plain_tiles(a, b, min(decontam.LEAST, len(a))) if a and b else 0
            if covered and covered >= decontam.COVERAGE * len(a):
                want[d, i] = (len(a), covered)
    assert got == want and len(want) > 15


def seconds(call):
    import time

    start = time.monotonic()
    call()
    return time.monotonic() - start


def test_long_hostile_texts_take_linear_time():
    """A megabyte of one token, magic or phrase."""
    scanner, find = licenses.Scanner(), media.automaton()
    for phrase in ("license ", "mit licens mit license ", "gnu general public license "):
        text = (phrase * (1_000_000 // len(phrase))).strip()
        assert seconds(lambda text=text: (scanner.spans(text), scanner.exact(text.encode()))) < 60
    for magic in (b"%PDF-1 ", b"\x1f\x8b\x08\x00aaaaaa", b"\xff\xd8\xff\xda\x00\x02", b"GIF89a" + bytes(7) + b"\x21\x01", PNG[:16]):
        assert seconds(lambda magic=magic: media.sniff(magic * (1_000_000 // len(magic)), find)) < 60
    for words in (["x"], ["x", "y"]):
        bench = decontam.Benchmark([(1, " ".join((words * 60)[:60]), 1)], decontam.LEAST)
        text = " ".join(words * (250_000 // len(words)))
        assert seconds(lambda bench=bench, text=text: bench.compare(text, 0.5)) < 60
        assert bench.compare(text, 0.5)[0][2] == 60


def test_updated_pdf_and_ties_of_formats():
    updated = PDF + b"\n5 0 obj\nstartxref\n20\n%%EOF"
    data = updated + b"tail" + PDF + JPEG
    assert media.sniff(data, media.automaton()) == [("application/pdf", 0, len(updated)), ("application/pdf", len(updated) + 4, len(PDF)), ("image/jpeg", len(updated) + 4 + len(PDF), len(JPEG))]


@pytest.mark.parametrize("seed", range(12))
def test_running_karp_rabin_tiles(seed):
    import random

    rng = random.Random(seed)
    a = [rng.randrange(30) for _ in range(60)]
    b = [rng.randrange(30) for _ in range(20)] + a[30:55] + [99] + a[0:25] + [rng.randrange(30) for _ in range(20)]
    tiles = decontam.tile(a, b, 4)
    assert sum(t[2] for t in tiles) == plain_tiles(a, b, 4) >= 50
    used = [p for _, j, n in tiles for p in range(j, j + n)]
    assert len(used) == len({*used}) and all(a[i : i + n] == b[j : j + n] for i, j, n in tiles)


def test_leaks_whole_reordered_and_partial(spark):
    items = [(1, "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november"), (2, "one two three"), (3, ""), (4, None), (5, "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november")]
    docs = [
        (1, "x y ALPHA bravo, charlie delta echo foxtrot golf hotel india juliet kilo lima mike november z", "u"),
        (2, "hotel india juliet kilo lima mike november - filler words - alpha bravo charlie delta echo foxtrot golf", "u"),
        (3, "alpha bravo charlie delta echo foxtrot is all", "u"),
        (4, "so: one two three", "u"), (5, "one two and three", "u"), (6, None, "u"), (7, "", "u"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (decontam.BROADCAST_BYTES, 60):
        got = sorted((r.doc_id, r.item_id, r.coverage) for r in decontam.contaminated(df, bench, broadcast_bytes=limit).collect())
        assert got == [(1, 1, 1.0), (1, 5, 1.0), (2, 1, 1.0), (2, 5, 1.0), (4, 2, 1.0)]
    assert decontam.contaminated(df, bench.limit(0)).count() == 0


def test_leak_query_finds_items_that_stand_in_texts(spark):
    sf = "/root/testdata/sf0.01"
    items = [(r.item_id, decontam.tokens(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: " " + " ".join(decontam.tokens(r.text)) + " " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, w in items if w and f" {' '.join(w)} " in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_benchmark_decontamination"](spark, sf).collect()}
    assert whole <= got and len(got) <= len(whole) + 5


def test_awkward_rows(spark):
    df, none = table(spark), empty(spark)
    assert licenses.scan(df).count() == df.count() and licenses.scan(none).count() == 0
    assert decontam.contaminated(none, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
    got = decontam.contaminated(df, spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f")], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [9, 9, 50, 50]
    kept = df.withColumn("media", F.col("text").cast("binary"))
    assert media.inspect(kept, "doc_id", "media", "lang").count() == df.count() and media.inspect(kept.limit(0), "doc_id", "media", "lang").count() == 0
