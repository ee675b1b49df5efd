import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from chronolith.llm import packing
from chronolith.llm.queries import QUERIES

from .awkward import empty, table


def plain_pieces(rows, capacity=2048):
    tok, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), []
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        for n, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out.append((i, n, s, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    return sorted(out)


def assert_whole(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_matches_the_tokenizer_and_fills_sequences(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op2_best_fit_packing"](spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces([tuple(r) for r in docs])
    total = sum(r.length for r in got)
    assert assert_whole(got, 2048) <= -(-total // 2048) + 2


def test_awkward_rows(spark):
    df = table(spark)
    got = packing.pack_documents(df, capacity=64).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == plain_pieces([(r.doc_id, r.text) for r in df.collect()], 64)
    assert_whole(got, 64)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_fullest_is_the_fullest():
    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = sorted(rng.choice(np.arange(1, 60), 8, replace=False).tolist())
        counts = rng.integers(1, 4, 8).tolist()
        sums = {0}
        for k, c in zip(lengths, counts):
            sums = {s + k * n for s in sums for n in range(c + 1)}
        best = packing.fullest(lengths, counts, 50)
        assert sum(k * c for k, c in best) == max([s for s in sums if s <= 50])
        assert all(c <= counts[lengths.index(k)] for k, c in best)


def test_plan_uses_each_piece_once():
    histogram = {k: (k * 7919) % 13 + 1 for k in range(1, 65)} | {40: 5000}
    used = defaultdict(int)
    for combination, times in packing.plan(histogram, 64):
        for k, c in combination:
            used[k] += c * times
    assert dict(used) == histogram


def library_ids(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


class Counted(dict):
    looked_up = 0

    def get(self, *a):
        self.looked_up += 1
        return super().get(*a)

    def __getitem__(self, k):
        self.looked_up += 1
        return super().__getitem__(k)


def test_a_part_is_looked_up_once_for_a_block():
    tok = packing.WordTokenizer(packing.default_tokenizer())
    tok.cache = Counted()
    texts = ["It's the blue-green 42nd THE end.", "\nthe   end of it's"] * 3000
    assert tok.encode(texts) == library_ids(texts[:2]) * 3000
    assert tok.cache.looked_up <= 2 * 12  # it 's the blue - green 4 2 nd end . of; each text has 5 or more


def test_parts_of_the_last_block_stay_known(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    monkeypatch.setattr(packing, "BLOCK_CHARS", 200)
    tok, learnt = packing.WordTokenizer(packing.default_tokenizer()), []
    learn = tok.learn
    monkeypatch.setattr(tok, "learn", lambda new: (learnt.extend(new), learn(new)))
    word = lambda n: "".join(chr(ord("a") + int(d)) for d in str(n))
    texts = [f"{'of the common kind ' * 20}{word(10 * n)} {word(10 * n + 1)} {word(10 * n + 2)}" for n in range(100)]
    assert tok.encode(texts) == library_ids(texts)
    assert len(tok.cache) <= 50 + 7
    assert sum(learnt.count(w) for w in (b"of", b"the", b"common", b"kind")) == 4


def test_parts_are_those_of_the_tokenizer(monkeypatch):
    rng = np.random.default_rng(3)
    signs = [*"stmdrevlabzSTMDREVL''''\"!.-<| \t\n\r0123456789àÀßÿÞ×÷éÉ", "'s", "'LL", "'re", "́", "ª", "²", "’", "\x0b", "\xa0", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 40))) for _ in range(3000)] + ["", " ", "'", "''", "'l", "x'", "'s's", "'llll", "'re5", "'s'", "\n"]
    expected = library_ids(texts)
    for chars, parts in ((packing.BLOCK_CHARS, packing.PARTS_A_CALL), (1, 1), (100, 7)):
        monkeypatch.setattr(packing, "BLOCK_CHARS", chars)
        monkeypatch.setattr(packing, "PARTS_A_CALL", parts)
        assert packing.WordTokenizer(packing.default_tokenizer()).encode(texts) == expected
