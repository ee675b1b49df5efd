"""License scans by fuzzy short-notice search.

A notice of n characters with at most k edits holds at least one of its k + 1 disjoint parts unchanged (pigeonhole),
so an automaton over all parts of all notices finds every place a match can be; there the regex library's
bounded-error matching verifies the edits and reports the span. Exact phrases are looked for in every text besides.
"""

from __future__ import annotations

import bisect
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_column

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
KNOWN = 100_000

#: Phrases looked for exactly, with their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: Short notices, the edits allowed in each, and their labels.
NOTICES = (
    ("gnu general public license", 2, "gpl"),
    ("gnu lesser general public license", 3, "lgpl"),
    ("gnu affero general public license", 3, "agpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", 8, "gpl"),
    ("apache license", 1, "apache"),
    ("licensed under the apache license version 2 0", 4, "apache"),
    ("mit license", 1, "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", 8, "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", 8, "bsd"),
    ("bsd license", 1, "bsd"),
    ("mozilla public license", 2, "mpl"),
    ("creative commons attribution", 2, "cc-by"),
    ("this is free and unencumbered software released into the public domain", 6, "unlicense"),
    ("all rights reserved", 1, "proprietary"),
)


@dataclass(frozen=True)
class Span:
    label: str
    notice: str
    start: int  # code points in the normalised text
    end: int
    edits: int

    @property
    def similarity(self) -> float:
        return max(0.0, 1 - self.edits / len(self.notice))


class Scanner:
    def __init__(self, notices=NOTICES, phrases=PHRASES):
        self.notices, self.phrases = notices, [(p.encode(), label) for p, label in phrases]
        self.find, seeds = ahocorasick.Automaton(), {}
        self.patterns, self.known = [], {}
        for n, (text, edits, _) in enumerate(notices):
            self.patterns.append(regex.compile(rf"(?b)(?<= )(?:{regex.escape(text, literal_spaces=True)}){{e<={edits}}}(?= )"))
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                seeds.setdefault(text[a:b], []).append((n, a))
        for seed, of in seeds.items():
            self.find.add_word(seed, (len(seed), of))
        self.find.make_automaton()

    def candidates(self, text: str) -> set[tuple[int, int, int]]:
        """(notice, start, end) of the windows that hold one of its parts and all of a match that has it unchanged."""
        windows = set()
        for last, (size, of) in self.find.iter(text):
            for n, offset in of:
                notice, edits, _ = self.notices[n]
                a = last - size + 1 - offset
                windows.add((n, max(a - edits, 0), min(a + len(notice) + edits, len(text))))
        return windows

    def best(self, n: int, piece: str) -> tuple[int, int, int] | None:
        """(start, end, edits) of notice n's best match in a piece of text between one character before and one behind.
        Pieces that come again are looked up."""
        key = (n, piece)
        if key not in self.known:
            if len(self.known) > KNOWN:
                self.known.clear()
            m = self.patterns[n].search(piece)
            self.known[key] = m and (m.start() - 1, m.end() - 1, sum(m.fuzzy_counts))
        return self.known[key]

    def spans(self, text: str) -> list[Span]:
        """Verified matches in a normalised text, by place: for each notice those with the fewest edits first, then the
        leftmost, and of the others each that overlaps none before it. Each window is searched by itself, so that time
        grows with the text; where its match is taken, what is left before and behind is searched again."""
        padded, queue = f" {text} ", []
        starts, ends = [[] for _ in self.notices], [[] for _ in self.notices]

        def search(n: int, a: int, b: int) -> None:
            if a < b and (m := self.best(n, padded[a : b + 2])):
                heapq.heappush(queue, (m[2], a + m[0], a + m[1], n, a, b))

        for window in self.candidates(text):
            search(*window)
        out = []
        while queue:
            edits, s, e, n, a, b = heapq.heappop(queue)
            at = bisect.bisect_left(ends[n], s + 1)  # the first taken match that ends behind s
            if at < len(starts[n]) and starts[n][at] < e:
                first, last = bisect.bisect_left(ends[n], a + 1), bisect.bisect_left(starts[n], b)
                cuts = [a, *(x for t in range(first, last) for x in (starts[n][t] - 1, ends[n][t] + 1)), b]
                for left, right in zip(cuts[::2], cuts[1::2]):
                    search(n, left, right)
                continue
            starts[n].insert(at, s)
            ends[n].insert(at, e)
            out.append(Span(self.notices[n][2], self.notices[n][0], s, e, edits))
            search(n, a, s - 1)
            search(n, e + 1, b)
        return sorted(out, key=lambda s: (s.start, s.end, s.notice))

    def exact(self, joined: bytes) -> list[tuple[int, str]]:
        """(word number, label) of each place of a phrase in words joined by blanks."""
        padded, found = b" " + joined + b" ", []
        for phrase, label in self.phrases:
            key, at = b" " + phrase + b" ", -1
            while (at := padded.find(key, at + 1)) >= 0:
                found.append((at, label))
        out, word, last = [], 0, 0
        for at, label in sorted(found):
            word += padded.count(b" ", last, at)
            last = at
            out.append((word, label))
        return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """One row for each row of docs: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score and
    spans array<struct<label, notice, start, end, edits>> over the words joined by blanks.

    Null and empty texts have no words, no spans, empty label strings and score 0; long texts are scanned whole, in time
    that grows with them; of equally good matches that overlap the leftmost, shortest is taken; repeated rows give
    repeated results; other columns are ignored; an empty table gives no row. score is the best match's similarity, 1
    for an exact phrase."""
    kind = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), kind]

    def one(data: bytes, scanner: Scanner) -> tuple:
        words = WORD.findall(data.lower())
        joined = b" ".join(words)
        base = scanner.exact(joined)
        spans = scanner.spans(joined.decode("utf-8", "replace"))
        own = {label for _, label in base}
        return (
            len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None,
            ",".join(sorted(own)), ",".join(sorted(own | {s.label for s in spans})),
            1.0 if base else max((s.similarity for s in spans), default=0.0),
            [{"label": s.label, "notice": s.notice, "start": s.start, "end": s.end, "edits": s.edits} for s in spans],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for b in batches:
            rows = [one(d, scanner) for d in byte_column(b, "text")]
            cols = list(zip(*rows)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(c, t) for c, t in zip(cols, types))], ["id", *names])

    schema = "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, notice: string, start: long, end: long, edits: int>>"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
