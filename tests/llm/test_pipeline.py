"""Each stage of the corpus pipeline on what the stage before left, against plain code; and the whole run."""

import random

import numpy as np
import pytest

import corpus_pipeline
from chronolith.llm import decontam, quality

from . import test_jaccard, test_packing, test_suffix
from .test_text_scans import plain_tiles

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéfg") for _ in range(rng.randrange(2, 7)))
    body = lambda n: " ".join(word() for _ in range(n))
    items = [body(30) for _ in range(6)]
    shared, texts = body(60), []
    for n in range(60):
        texts.append(body(rng.randrange(40, 160)))
    for n in range(0, 20, 2):  # near and exact copies
        words = texts[n].split()
        words[len(words) // 2 :: 90] = ["new"] * len(words[len(words) // 2 :: 90])
        texts.append(" ".join(words))
    texts += texts[20:25]
    texts += [f"{body(50)} {shared} {body(50)}" for _ in range(6)]
    texts += [f"{body(40)} {item} {body(40)}" for item in items[:4]] + [f"{' '.join(items[4].split()[15:])} x {' '.join(items[4].split()[:15])} {body(20)}"]
    texts += [" ".join([word()] * 40) for _ in range(25)] + [None, "", "one"]
    rng.shuffle(texts)
    rows = [(n, t, "en", "s", len(t) if t is not None else None) for n, t in enumerate(texts)]
    labels = [(n, int(not (t and len(set(t.split())) == 1 and len(t.split()) > 3)), 0) for n, t, *_ in rows if n % 2 == 0]
    return rows, labels, [(n, t) for n, t in enumerate(items)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(folder, [(name, rows before, rows after)])"""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows, labels, items = corpus()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, folder)
        if name != "pack":
            assert result.columns == docs.columns
        result.write.parquet(f"{folder}/out/{name}")
        after = spark.read.parquet(f"{folder}/out/{name}")
        out.append((name, docs.collect(), after.collect()))
        docs = after
    return folder, out, items, labels


def stage(stages, name):
    return next((before, after) for n, before, after in stages[1] if n == name)


def test_quality_keeps_what_the_model_accepts(spark, stages):
    before, after = stage(stages, "quality")
    docs, labels = spark.createDataFrame(before, COLUMNS), spark.createDataFrame(stages[3], "doc_id long, quality int, toxic int")
    model, grams = quality.train(docs, labels), quality.Grams()
    want = {r.doc_id for r in before if model.score(grams.of((r.text or "").encode())) >= 0.5}
    assert {r.doc_id for r in after} == want and sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id in want)
    junk = {r.doc_id for r in before if r.text and len(set(r.text.split())) == 1 and len(r.text.split()) > 3}
    assert not junk & want and len(want) == len(before) - len(junk)


def test_near_dedup_keeps_the_smallest_of_each_group(stages):
    before, after = stage(stages, "near_dedup")
    group = test_jaccard.brute([(r.doc_id, r.text) for r in before])
    want = sorted(tuple(r) for r in before if group[r.doc_id] == r.doc_id)
    assert sorted(map(tuple, after)) == want and len(want) < len(before) - 8


def test_substring_dedup_cuts_repeated_passages(stages):
    before, after = stage(stages, "substring_dedup")
    cut, texts, some = {i: spans for i, _, spans, _ in test_suffix.brute([(r.doc_id, r.text) for r in before])}, {r.doc_id: r for r in after}, 0
    assert len(after) == len(before)
    for r in before:
        data = (r.text or "").encode()
        gone = np.zeros(len(data), bool)
        for s, n in cut[r.doc_id]:
            gone[s : s + n] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert (texts[r.doc_id].text, texts[r.doc_id].n_chars, texts[r.doc_id].lang) == (kept, len(kept), r.lang)
        some += bool(cut[r.doc_id])
    assert some >= 4


def test_decontamination_drops_what_covers_items(stages):
    before, after = stage(stages, "decontaminate")
    items = [decontam.tokens(t) for _, t in stages[2]]
    leaks = {r.doc_id for r in before for item in items if plain_tiles(item, decontam.tokens(r.text), min(decontam.LEAST, len(item))) >= decontam.COVERAGE * len(item)}
    assert sorted(map(tuple, after)) == sorted(tuple(r) for r in before if r.doc_id not in leaks) and len(leaks) >= 4


def test_pack_and_the_whole_run(spark, stages):
    before, after = stage(stages, "pack")
    pieces = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert pieces(after) == test_packing.plain_pieces([(r.doc_id, r.text) for r in before])
    test_packing.assert_whole(after, 2048)
    assert pieces(corpus_pipeline.run(spark, stages[0]).collect()) == pieces(after)


def test_stages_on_awkward_and_empty_tables(spark, stages):
    long = "alpha beta gamma delta " * 3000
    rows = [(None, "no id " * 30, None, None, None), (1, None, "en", "s", 0), (1, "same id", "en", "s", 7), (1, "same id", "en", "s", 7), (2, long, None, "s", None), (3, long, "en", None, 5), (4, "", "en", "s", 0)]
    for docs in (spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([], COLUMNS)):
        for name, f in corpus_pipeline.STAGES:
            got = f(spark, docs, stages[0])
            assert got.count() <= max(docs.count(), 0) or name == "pack"
            if name != "pack":
                assert got.columns == docs.columns
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, COLUMNS), stages[0]).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 1, 2] and sum(r.doc_id is None for r in kept) == 1
