import hashlib
import random

import pytest
import public_tokenizers
import tiktoken

from chronolith.llm import bpe
from chronolith.llm.queries import QUERIES

from .awkward import empty, table


@pytest.fixture(scope="module")
def encoding():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def plain(encoding, text):
    ids = encoding.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_matches_the_library(spark, sf, encoding):
    want = {r.doc_id: plain(encoding, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op13_byte_level_bpe"](spark, sf).collect()
    assert len(got) == len(want) and {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want


def test_splits_as_the_library_does(encoding):
    rng, splitter = random.Random(1), bpe.Splitter(public_tokenizers.PATTERN).ready()
    chars = "ab'sté Ωж中 \n\t  12½!?#\x1c\x85\u3000\u0558\u088f\U0003fc3c\U00011de0\x00"
    for _ in range(3000):
        text = "".join(rng.choice(chars) for _ in range(rng.randrange(30)))
        assert [i for w in splitter.split(text) for i in encoding.encode_ordinary(w)] == encoding.encode_ordinary(text)


@pytest.mark.parametrize("block_bytes", [1, 300, 4 << 20])
def test_awkward_rows_in_blocks_of_any_size(spark, encoding, block_bytes):
    df = table(spark).repartition(3)
    kept = [c for c in df.columns if c != "text"]
    got = bpe.encode(df.withColumn("copy", df.text), block_bytes=block_bytes).collect()
    assert [c for c in got[0].asDict()] == [*kept, "copy", "ids"]
    assert sorted((r.doc_id, r.copy or "", r.ids) for r in got) == sorted((r.doc_id, r.text or "", encoding.encode_ordinary(r.text or "")) for r in df.collect())
    assert sorted(map(repr, bpe.round_trip(df).collect())) == sorted(map(repr, spark.createDataFrame([(r.doc_id, *plain(encoding, r.text)) for r in df.collect()], 'doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string').collect()))
    assert bpe.encode(empty(spark)).count() == bpe.round_trip(empty(spark)).count() == 0


def test_more_words_than_two_bytes_tell_apart(spark, encoding):
    texts = [" ".join(f"w{n}" for n in range(70_000)), "w1 w69999 w5", None]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in bpe.encode(df).collect()}
    assert got == {n: encoding.encode_ordinary(t or "") for n, t in enumerate(texts)}


def test_clashing_names_have_to_be_told_apart(spark):
    df = spark.createDataFrame([(1, "a b", 3)], "block long, text string, ids int")
    with pytest.raises(ValueError):
        bpe.encode(df)
    assert bpe.encode(df, ids_col="tokens").first().asDict() == {"block": 1, "ids": 3, "tokens": [64, 275]}
    with pytest.raises(ValueError):
        bpe.decode(df.selectExpr("array(ids) as ids", "1 as bytes"))


def test_decoding_cut_unknown_and_missing_ids(spark, encoding):
    whole = encoding.encode_ordinary("naïve ☃ 🙂")
    rows = [(1, whole), (2, whole[-2:]), (3, []), (4, None), (5, [64, None]), (6, [64, 999_999]), (6, [64]), (7, [-1])]
    got = bpe.decode(spark.createDataFrame(rows, "id long, ids array<int>")).collect()
    want = [(1, encoding.decode_bytes(whole)), (2, encoding.decode_bytes(whole[-2:])), (3, b""), (4, None), (5, None), (6, None), (6, b"a"), (7, None)]
    assert sorted((r.id, bytes(r.bytes) if r.bytes is not None else None) for r in got if r.bytes is not None) == sorted(w for w in want if w[1] is not None)
    assert sorted(r.id for r in got if r.bytes is None) == sorted(w[0] for w in want if w[1] is None)
    assert bpe.decode(spark.createDataFrame([], "ids array<int>")).count() == 0


def test_positions_are_not_shuffled_and_shards_hold_each_word_once(spark, sf):
    df = bpe.encode(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "CartesianProduct" not in plan and "Join" not in plan


def test_few_words_in_many_shards(spark, encoding, monkeypatch):
    monkeypatch.setattr(bpe, "SHARD_BYTES", 10)
    rows = [(n, f"a word {n % 7} and  more\n") for n in range(60)]
    got = bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_bytes=100).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == [(n, encoding.encode_ordinary(t)) for n, t in rows]
