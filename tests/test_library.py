"""Functions, sources, sinks and streams on small fixtures with stated results."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chronolith.functions import plugins
from chronolith.functions import text as T
from chronolith.operators import community, grounding, ingest, pages, report, resolve, search, status
from chronolith.sources import files
from chronolith.streaming import notes


def value(spark, column, **given):
    row = spark.createDataFrame([tuple(given.values()) or (0,)], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'long'}" for k, v in given.items()) or "x int")
    return row.select(column.alias("v")).first().v


def folder():
    return tempfile.mkdtemp(prefix="spark-")


def text_cases():
    return [
        (T.frontmatter(F.lit("---\na: 1\n---\nbody")), "a: 1"),
        (T.body(F.lit("---\na: 1\n---\nbody")), "body"),
        (T.frontmatter(F.lit("no block")), None),
        (T.wikilinks(F.lit("[[A]] `[[code]]` [[B|b]] [[C#h]] [[A]] ```\n[[D]]\n```")), ["A", "B", "C"]),
        (T.slug_timestamp(F.lit("2024-13-01-000000-x")).isNull(), True),
        (F.date_format(T.slug_timestamp(F.lit("2024-02-03-040506-x")), "yyyyMMddHHmmss"), "20240203040506"),
        (T.normalized_question(F.lit("  What  is THIS ?! ")), "what is this"),
        (T.entity_key(F.lit(" My-App.com ")), "myapp"),
        (T.generic_remainder(F.lit("k3s"), F.lit("K3s cluster")), True),
        (T.generic_remainder(F.lit("foo"), F.lit("foo database")), False),
        (T.outcome(F.lit("degraded"), F.lit("not_found"), F.lit("")), "not_found"),
        (T.tool_name(F.lit(None).cast("string"), F.lit("search")), "wiki_search"),
        (T.review_items(F.lit("- before\n## Queue\n- one\n* two\n- (empty)\n")), 2),
        (T.blocked_reason(F.lit("---\nreason: too  odd\n---\n")), "too odd"),
        (T.required_error(F.lit("---\ncaptured: x\nsession: s\n---\n")), "missing topic"),
        (T.first_paragraph(F.lit("# T\n\nSome **bold** [[L|link]].\n\nNext")), "Some bold link."),
        (T.json_object(F.lit("```json\n{\"a\": 1}\n```")), '{"a": 1}'),
        (T.unwrapped(F.lit('{"answer": {"answer": {"b": 1}}}')), '{"b":1}'),
        (T.model_ladder(F.lit("a, b ,a,,"), "d"), ["a", "b"]),
        (T.transient_error(F.lit(429), F.lit(""), F.lit("")), True),
        (T.transient_error(F.lit(404), F.lit(""), F.lit("timeout")), False),
        (T.period_label(F.lit(7)), "weekly"),
        (T.bounded(F.lit("key abc\r x"), ("abc", ""), 100), "key <redacted> x"),
        (T.bounded(F.lit("x" * 120), (), 100), "x" * 100 + "\n... <truncated 20 chars>"),
        (T.transient_error(F.lit(None).cast("int"), F.lit("ValueError"), F.lit("Quota exceeded")), True),
        (T.transient_error(F.lit(None).cast("int"), F.lit("ValueError"), F.lit("bad connection pool")), False),
        (T.transient_error(F.lit(None).cast("int"), F.lit("APIConnectionError"), F.lit(None).cast("string")), True),
        (T.wikilinks(F.lit("[[Page\\|alias]] [[#top]] [[a b #h]] `x [[no]] y` ``` [[no]] ``` [[ c | d ]]")), ["Page", "a b", "c"]),
        (T.first_paragraph(F.lit("---\na: 1\n---\n# T\n\n\n**[[L]]** and `code` *it*\nmore\n\nnext")), "L and code it more"),
        (T.first_paragraph(F.lit("w" * 110 + ". " + "x" * 150)), "w" * 110 + "."),
        (T.first_paragraph(F.lit("w. " + "x" * 250)), "w. " + "x" * 217 + "…"),
        (T.tag_slugs(F.array(F.lit("Big Tag"), F.lit("--"), F.lit("a"))), ["source-note", "big-tag", "a"]),
        (T.safe_error(F.lit("ValueError"), F.lit(3)), "ValueError 3"),
        (T.age_seconds(F.lit("2024-01-01 00:01:00").cast("timestamp"), T.iso_timestamp(F.lit("2024-01-01T00:00:00Z"))), 60.0),
        (T.age_seconds(F.lit("2024-01-01 00:01:00").cast("timestamp"), T.iso_timestamp(F.lit("2024-01-01T02:00:00+01:00"))), 0.0),
        (T.iso_timestamp(F.lit("soon")).isNull(), True),
        (T.fresh(F.lit(2000), F.lit(200), F.lit(True)), True), (T.fresh(F.lit(2001), F.lit(200), F.lit(True)), False), (T.fresh(F.lit(2000), F.lit(200), F.lit(False)), False),
        (T.may_compact(F.lit(9000), F.lit(0), F.lit(True), F.lit(8900), F.lit(False)), True),
        (T.may_compact(F.lit(9000), F.lit(0), F.lit(True), F.lit(8000), F.lit(False)), False),
        (T.may_compact(F.lit(9000), F.lit(None).cast("int"), F.lit(None).cast("boolean"), F.lit(None).cast("int"), F.lit(True)), True),
        (T.month_key(F.lit(None).cast("string"), F.lit("2024-05-01-x"), F.lit("n")), "2024-05"),
        (T.embedding_input(F.lit("n"), F.lit(""), F.lit("body"), 6), "n\n\nbod"),
    ]


def test_text_functions(spark):
    columns, want = zip(*text_cases())
    got = spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first()
    assert list(got) == list(want)


def test_dropped_notes_are_checked(spark):
    def error(slug="ok", note="text", texts=None, binaries=None):
        df = spark.createDataFrame([(slug, note, texts, binaries)], "slug string, note string, texts map<string,string>, binaries map<string,string>")
        return df.select(T.note_error(*map(F.col, df.columns)).alias("e")).first().e

    assert error() is None
    assert error(slug="Bad Slug") == "slug" and error(note="  \n") == "empty note"
    assert error(note="x" * (T.NOTE_MAX + 1)) == "note too large"
    assert error(texts={"a.txt": "x"}, binaries={"a.txt": "eA=="}) == "attachment name collision"
    assert error(texts={"NOTE.md": "x"}) == "reserved name" and error(texts={"../x": "x"}) == "attachment name"
    assert error(binaries={"a.bin": "not base64!"}) == "binary attachment not base64"


def test_payload_hash_ignores_map_order(spark):
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},), ({"a": "1", "b": "3"},)], "m map<string,string>")
    h = [r.h for r in df.select(T.payload_hash(F.lit("n"), F.col("m"), F.lit(None).cast("map<string,binary>")).alias("h")).collect()]
    assert h[0] == h[1] != h[2]


def test_backfilled_source_note(spark):
    folder_ = "2026-07-18-230139-site-domain-registered"
    df = spark.createDataFrame([(folder_, {}), (folder_, {"captured": "c", "capture-session": "s", "topic": "t"})], "f string, m map<string,string>")
    a, b = (r.n for r in df.select(T.source_note(F.col("f"), F.col("m")).alias("n")).collect())
    assert (a.captured, a.topic) == ("2026-07-18T23:01:39Z", "site domain registered")
    assert (b.captured, b.session, b.topic) == ("c", "s", "t")


def test_frontmatter_parser(spark):
    blocks = ["a: 1\ntags: [x, 'y z']\nb: \"q: r\"", "a: 1\na: 2", "session: x: y", None]
    rows = spark.createDataFrame([(b,) for b in blocks], "b string").select(plugins.frontmatter_struct("b").alias("p")).collect()
    assert rows[0].p.fields == {"a": "1", "b": "q: r", "tags": "x, y z"} and rows[0].p.tags == ["x", "y z"]
    assert rows[1].p.repeated == ["a"] and rows[2].p.error.startswith("unquoted colon") and rows[3].p.fields == {}


V, S = "2026-07-18-120000-valid", "2026-07-18-120100-semantic"


@pytest.mark.parametrize(("confidence", "sources", "answer", "want"), [
    ("high", ["invented"], "a", (False, "rejected", "not_found", [], None, True)),
    ("high", [V], "a", (True, "accepted", "high", [V], "a", False)),
    ("high", ["invented", V], "a", (True, "filtered", "high", [V], "a", False)),
    ("high", [S], "a", (True, "downgraded", "medium", [S], "a", False)),
    ("not_found", ["invented"], None, (True, "abstained", "not_found", [], None, True)),
])
def test_grounding(spark, confidence, sources, answer, want):
    schema = "confidence string, answer string, sources array<string>, superseded_note string, escalate boolean, strong array<string>, weak array<string>"
    r = grounding.ground(spark.createDataFrame([(confidence, answer, sources, None, False, [V], [S])], schema)).first()
    assert (r.grounded, r.action, r.confidence, r.sources, r.answer, r.escalate) == want


def test_ingest_dispositions(spark):
    body = "current body"
    day = datetime(2026, 7, 18)
    sha = value(spark, F.sha2(F.lit(body), 256))
    cases = {  # episodes as (complete, hash, content, mentions), newest last
        "missing": ([], "missing", False), "partial": ([(None, None, "old", 0)], "partial", False), "changed": ([(True, "old", None, 0)], "changed", False),
        "legacy": ([(None, None, body, 2)], "done", True), "mismatch": ([(None, None, "before", 2)], "done", False), "same": ([(True, sha, None, 0)], "done", False),
        "no-hash": ([(True, None, None, 0)], "done", False), "older-matches": ([(True, sha, None, 0), (True, "x", None, 0)], "changed", False),
    }
    e = [(n, f"{n}{k}", *ep[:2], ep[2], ep[3], f"2026-0{k + 1}") for n, (eps, _, _) in cases.items() for k, ep in enumerate(eps)]
    episodes = spark.createDataFrame(e, "slug string, uuid string, complete boolean, content_hash string, content string, mention_count long, created_at string")
    rows = spark.createDataFrame([(n, day, body) for n in cases], "slug string, ts timestamp, body string")
    got = {r.slug: (r.disposition, r.upgrade_uuid is not None) for r in ingest.assess(rows, episodes).collect()}
    assert got == {n: c[1:] for n, c in cases.items()}


def test_label_propagation_swings_and_settles(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "d"), ("c", "d"), ("d", "e"), ("d", "e"), ("c", "e"), ("c", "e")], "src string, dst string")
    nodes = spark.createDataFrame([(n,) for n in "abcdef"], "node string")
    got = {r.node: r.label for r in community.label_propagation(community.adjacency(nodes, edges)).collect()}
    assert got["c"] == got["d"] == got["e"] and got["f"] == 5 and got["a"] == got["b"] == 1


def test_merge_groups_of_a_chain(spark):
    pairs = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y")], "canonical string, duplicate string")
    got = {r.id: r.root for r in resolve.merge_groups(pairs).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 43
    entities = spark.createDataFrame([("n007", "a", "the longest summary"), ("n008", "b", "short"), ("y", "c", None), ("x", "d", "")], "uuid string, name string, summary string")
    got = {r.id: r.root for r in resolve.merge_groups(pairs, entities).collect()}
    assert set(got.values()) == {"n007", "x"} and got["n000"] == "n007"


def test_both_tiers_of_entities_meet_in_one_group(spark):
    rows = [("1", "k3s", "s"), ("2", "K3S", "long summary"), ("3", "k3s cluster", ""), ("4", "the k3s", None), ("5", "other", ""), ("6", "k-3-s", "x"), ("7", "東京", ""), ("8", "東京", "")]
    e = spark.createDataFrame(rows, "uuid string, name string, summary string")
    got = {r.id: r.root for r in resolve.merge_groups(resolve.candidates(e), e).collect()}
    assert got == {"1": "2", "2": "2", "3": "2", "4": "2", "6": "2", "7": "7", "8": "7"}
    assert resolve.merge_groups(resolve.candidates(e, lambda a, b: F.lit(False)), e).where("id = '3'").count() == 0
    run = [(r.shorter, r.longer) for r in resolve.confirmed(e, limit=1).collect()]
    assert len(run) == 1 and run[0][0].lower() == "k3s"


def test_tree_of_summaries_keeps_an_odd_last_one(spark):
    rows = [(1, n, f"s{n}.") for n in range(5)] + [(2, 0, "alone")]
    m = spark.createDataFrame(rows, "community long, ord long, summary string")
    got = {r.community: r.summary for r in community.tree_reduce(m, 400).collect()}
    assert got == {1: "s0. s2. s1. s3. s4.", 2: "alone"}
    assert {r.community: r.summary for r in community.tree_reduce(m, 9).collect()}[1] == "s0. s2."


def test_numbers_without_one_window(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert [(r.x, r.number) for r in community.numbered(rows, "x").orderBy("x").collect()] == [(n, n) for n in range(1000)]


def test_index_reads_in_order(spark):
    rows = [("B", "entity", "two", None, "d."), ("a", "entity", "one", None, ""), ("c", "entity", None, None, None), ("D", "decision", None, "decided", "why"), ("s", "source", None, None, None)]
    p = spark.createDataFrame([(*r, f"2024-01-01-{r[0]}.md", "2024-01-05") for r in rows], "name string, type string, category string, status string, description string, path string, created string")
    got = [r.line for r in report.index_lines(p, ("two",)).orderBy("section", "ord").collect()]
    assert got == ["- [[B]] — d.", "- [[a]]", "- [[c]]", "- [[D]] **[decided]** — why", "- **2024-01** — 1 sources"]
    text = report.render(report.index_lines(p, ("two",)))
    assert report.stale(text, text).first().exit_code == 0


def test_note_tree(spark):
    root = folder()
    for path in ("2024-01-01-000000-a/2024-01-01-000000-a.md", ".blocked/2024-01-02-000000-b/2024-01-02-000000-b.md", "2024-13-01-000000-c/2024-13-01-000000-c.md", "2024-01-03-000000-d/other.md"):
        os.makedirs(os.path.dirname(f"{root}/sources/notes/{path}"))
        with open(f"{root}/sources/notes/{path}", "w") as f:
            f.write(path)
    found = files.discover_notes(files.markdown(spark, root))
    assert [r.slug for r in found.collect()] == ["2024-01-01-000000-a"]
    assert pages.catalog(files.markdown(spark, root)).count() == 2  # Spark skips .blocked; mis-nested files are no pages


def test_query_log_round_trip(spark):
    path = folder() + "/log"
    events = spark.createDataFrame([(float(n), "wiki_get", f"q{n}") for n in range(50)], "ts double, tool string, query string")
    files.append_query_log(events.where("ts < 30"), path)
    files.append_query_log(events.where("ts >= 30"), path)
    with open(f"{path}/broken.json", "w") as f:
        f.write('{"ts": 1, \n{"tool": "no_time"}\n')
    got = files.read_query_log(spark, path, 86400.0, 1, most=20).collect()
    assert [r.ts for r in got] == [float(n) for n in range(30, 50)]
    assert files.read_query_log(spark, path, 86400.0, 1).count() == 51


def test_embedding_cache_and_log_entries(spark):
    path = folder()
    rows = spark.createDataFrame([("m", "a", "h", "embedding-input-v1", [1.0, 2.0]), ("m", "b", "h", "odd", [1.0, 2.0]), ("m", "c", "h", "legacy-body-v0", [1.0])], "model string, name string, hash string, hash_format string, vector array<float>")
    assert [r.name for r in files.read_embeddings(spark, files.write_embeddings(rows, path, "v1"), "m", 2).collect()] == ["a"]
    log = spark.createDataFrame([("head\n## [2024-01-02] ingest | x\n- 0 items for review\n- b\n## [2024-01-01 10:00] note | y\n",)], "text string")
    assert [r.date for r in files.log_entries(log).orderBy("seq").collect()] == ["2024-01-02", "2024-01-01"]
    assert "review" not in files.latest_entry(log).first().text
    changed = spark.createDataFrame([(1, "R100\told.md\tnew.md"), (2, "A\tx.md"), (3, "")], "seq long, value string")
    assert [(r.status, r.path) for r in files.change_log(changed).orderBy("seq").collect()] == [("R", "new.md"), ("A", "x.md")]


def finish(query):
    """Runs a stream over what is available; it must end by itself."""
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()


def test_streamed_ingest_and_late_facts(spark):
    source, target = folder(), folder()
    rows = spark.createDataFrame([("s1", "a"), ("s1", "a"), ("s2", "b"), ("s1", "a")], "slug string, body string")
    for n in range(2):  # copies in one batch, in two batches of a run, and in two runs
        rows.repartition(3).write.mode("append").parquet(source)
        if n:
            spark.createDataFrame([("s1", "changed")], rows.schema).write.mode("append").parquet(source)
        finish(notes.ingest(notes.note_stream(spark, source, "slug string, body string", 1), f"{target}/out", f"{target}/cp"))
    assert sorted((r.slug, r.body) for r in spark.read.parquet(f"{target}/out").collect()) == [("s1", "a"), ("s1", "changed"), ("s2", "b")]
    facts, schema = folder(), "uuid long, subject long, valid_at timestamp"
    for uuid, day in ((1, 1), (2, 9), (3, 5)):
        spark.createDataFrame([(uuid, 7, datetime(2024, 1, day)), (uuid + 10, 8 + uuid, datetime(2024, 2, day))], schema).coalesce(1).write.mode("append").parquet(f"{facts}/in")
        finish(notes.late_facts(notes.note_stream(spark, f"{facts}/in", schema), f"{facts}/events", f"{facts}/facts", f"{facts}/cp"))
    got = {r.uuid: r.invalid_at and r.invalid_at.day for r in notes.current_facts(spark.read.parquet(f"{facts}/facts")).collect()}
    assert got == {1: 5, 3: 9, 2: None, 11: None, 12: None, 13: None}
    assert all(d.startswith(("bucket=", "_", ".")) for d in os.listdir(f"{facts}/events"))


def test_streamed_pairs(spark):
    source, schema = folder(), "session string, call_id string, ts double, kind string"

    def more(*rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    more(("s", "c", 1.0, "tool_start"), ("s", "c", 3.0, "tool_end"), ("s", "d", 2.0, "tool_start"), ("s", "e", 9.0, "tool_end"), ("s", "c", 4.0, "tool_start"))
    checkpoint, out = folder(), folder() + "/pairs"
    for late in ((("s", "c", 5.0, "tool_end"),), (("t", "x", 5000.0, "turn_start"), ("t", "y", 5000.0, "tool_start")), (("t", "z", 5001.0, "tool_start"),)):
        pairs = notes.pair_runs(notes.note_stream(spark, source, schema), timeout_seconds=3600)
        finish(pairs.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())
        more(*late)
    finish(notes.pair_runs(notes.note_stream(spark, source, schema)).writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start())
    got = sorted((r.session, r.call_id, r.started, r.ended) for r in spark.read.parquet(out).collect())
    assert got == [("s", "c", 1.0, 3.0), ("s", "c", 4.0, 5.0), ("s", "d", 2.0, None)]


def test_streamed_counts_and_drops(spark):
    source, schema = folder(), "ts timestamp, tool string, outcome string, capture_hash string, slug string"
    rows = [(datetime(2024, 1, 1, 0, m), "wiki_get", "ok", f"h{m % 2}", "s") for m in range(8)] + [(datetime(2024, 1, 1, 5), "wiki_get", "ok", "h9", "s")]
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    for name, df, mode in (("counts", notes.windowed_counts(stream(), "1 minute", "5 minutes"), "append"), ("drops", notes.once(stream(), "1 hour"), "append")):
        finish(df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder()).trigger(availableNow=True).start())
    assert sorted(r.n for r in spark.table("counts").collect()) == [3, 5]
    assert sorted(r.capture_hash for r in spark.table("drops").collect()) == ["h0", "h1", "h9"]
    assert [notes.backoff_seconds(n) for n in (0, 3, 9)] == [1, 8, 20]


REQUEST = "slug string, note_md string, texts map<string,string>, binaries map<string,string>, at timestamp"


def test_drop_notes_once(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    req = spark.createDataFrame([("a", "text", None, None, at), ("a", "text", None, None, at), ("B", "text", None, None, at), ("B", "other", None, None, at)], REQUEST)
    seen = spark.createDataFrame([], "capture_hash string, folder string")
    out = folder() + "/notes"
    got = sorted((r.slug, r.ok, r.already_exists, r.folder) for r in files.drop_notes(req, seen, out).collect())
    assert got == [("B", False, False, "2024-01-02-030405-B"), ("B", False, False, "2024-01-02-030405-B"), ("a", True, False, "2024-01-02-030405-a"), ("a", True, True, "2024-01-02-030405-a")]
    assert spark.read.parquet(out).count() == 1


def test_dropped_attachments_and_foreign_slugs(spark):
    """Attachments are read back; a payload under another slug is kept; the same table can be written and read."""
    out = folder() + "/notes"
    day = lambda n: datetime(2024, 1, n, 3, 4, 5)
    first = spark.createDataFrame([("a", "text", {"x.txt": "hi"}, {"y.bin": "AAEC"}, day(2))], REQUEST)
    files.drop_notes(first, spark.createDataFrame([], "capture_hash string, folder string"), out).collect()
    stored = spark.read.parquet(out).first()
    assert (stored.texts, {k: bytes(v) for k, v in stored.binaries.items()}) == ({"x.txt": "hi"}, {"y.bin": b"\0\1\2"})
    again = spark.createDataFrame([("a", "text", {"x.txt": "hi"}, {"y.bin": "AAEC"}, day(3)), ("b", "text", {"x.txt": "hi"}, {"y.bin": "AAEC"}, day(3)), ("a", "text", {"x.txt": "ho"}, {"y.bin": "AAEC"}, day(2))], REQUEST)
    got = sorted((r.slug, r.folder, r.ok, r.already_exists, r.error) for r in files.drop_notes(again, spark.read.parquet(out), out).collect())
    assert got == [
        ("a", "2024-01-02-030405-a", False, False, "folder exists"), ("a", "2024-01-02-030405-a", True, True, None), ("b", "2024-01-03-030405-b", True, False, None),
    ]
    assert sorted(r.folder for r in spark.read.parquet(out).collect()) == ["2024-01-02-030405-a", "2024-01-03-030405-b"]


def test_source_note_text(spark):
    note = "---\ntopic: t\nextra: e \"q\"\n---\n\nbody\n"
    df = spark.createDataFrame([("2024-01-02-030405-a", note)], "folder string, note string").withColumn("p", plugins.frontmatter_struct(T.frontmatter(F.col("note"))))
    text = df.select(T.source_note_text(F.col("folder"), F.col("p.fields"), F.col("p.tags"), F.col("note"), F.lit("h")).alias("t"))
    got = text.first().t
    assert got.startswith("---\ntype: source\ntags: [source-note]\ncreated: \"2024-01-02\"") and "\n# 2024-01-02-030405-a\n\nbody" in got
    assert 'extra: "e \\"q\\""' in got and 'captured: "2024-01-02T03:04:05Z"' in got and "capture-hash: h" in got
    assert text.select(T.required_error(F.col("t")).alias("e")).first().e is None


def test_log_days_and_groups(spark):
    path = folder() + "/log"
    rows = spark.createDataFrame([(86400.0 * n, f"q{n}") for n in range(5)], "ts double, query string")
    files.append_query_log(rows, path, keep_days=2)
    assert sorted(r.query for r in files.read_query_log(spark, path, 86400.0 * 5, 30).collect()) == ["q3", "q4"]
    nodes = folder() + "/nodes"
    spark.createDataFrame([("a", "g1"), ("b", "g2")], "uuid string, group_id string").write.partitionBy("group_id").parquet(nodes)
    assert [r.uuid for r in files.read_group(spark, nodes, "g2").collect()] == ["b"]
    queue = spark.createDataFrame([("q/2024-01-02-000000-a/NOTE.md", datetime(2024, 5, 1)), ("q/README.md", datetime(2024, 5, 1)), ("q/b.md", datetime(2024, 5, 2))], "path string, modified timestamp")
    assert sorted((r.slug, r.ts.day) for r in files.queue_entries(queue, "inbox").collect()) == [("2024-01-02-000000-a", 2), ("b", 2)]
    lines = spark.createDataFrame([('{"session": "s", "kind": "tool_start", "ts": 1.5}',), ("broken",)], "value string")
    assert [(r.session, r.kind, r.ts) for r in files.agent_events(lines).collect()] == [("s", "tool_start", 1.5)]


def test_listed_rates_and_alerts_in_pieces(spark):
    """What windows over a whole history would give, from pieces of it."""
    rows = [(float(t), t % 97 < 60) for t in range(0, 5000, 7)]
    samples = spark.createDataFrame(rows, "at double, on_ boolean")
    rules = (("r", "on_", 50, "critical"),)
    want, off = [], rows[0][0] - 1
    for t, on in rows:
        off = off if on else t
        if on and t - off > 50:
            want.append(t)
    for width in (100, 10**9):
        assert [r.at for r in status.series_alerts(samples, rules, width).orderBy("at").collect()] == want
    queue = spark.createDataFrame([("a", f"s{n}", datetime(2024, 1, 1 + n)) for n in range(5)] + [(None, "x", None), ("b", "y", None)], "queue string, slug string, ts timestamp")
    assert sorted((r.queue or "", r.slug, r.truncated) for r in status.listed(queue, 2).collect()) == [("", "x", False), ("a", "s0", True), ("a", "s1", True), ("b", "y", False)]


def test_embedder_of_an_outside_model(spark):
    embed = plugins.batch_embedder(lambda texts: [[len(t), 0.0] for t in texts])
    got = [r.v for r in spark.createDataFrame([("abc",), (None,)], "t string").select(embed("t").alias("v")).collect()]
    assert got == [[1.0, 0.0], [0.0, 0.0]]


def test_answer_cache_by_watermark(spark):
    schema = "question string, answer string, confidence string, sources array<string>, grounded boolean"
    none = spark.createDataFrame([], "question_key string, watermark string, expires_at long, answer string, confidence string, sources array<string>")
    answers = spark.createDataFrame([("What IS it?", "a", "high", ["s"], True), ("other", None, "not_found", [], True), ("bad", "x", "high", ["s"], False)], schema)
    cache = grounding.remember(none, answers, "w1", F.lit(0).cast("long"))
    assert [r.question_key for r in cache.collect()] == ["what is it"]
    asked = spark.createDataFrame([("what  is it ?!",)], "question string")
    hit = lambda w, now: grounding.cached(asked, cache, w, F.lit(now).cast("long")).first().hit
    assert [hit("w1", 10), hit("w1", 3600), hit("w2", 10), hit(None, 10)] == [True, False, False, False]
    assert grounding.remember(cache, answers.limit(0), "w2", F.lit(5).cast("long")).count() == 0
    many = spark.createDataFrame([(f"q{n}", "a", "low", [], True) for n in range(9)], schema)
    assert grounding.remember(cache, many, "w1", F.lit(5).cast("long"), most=4).where("question_key = 'what is it'").count() == 0


def test_hashing_embedder_is_unit_and_stable(spark):
    df = spark.createDataFrame([("a b c",), ("a b c",), ("",)], "t string").select(plugins.hashing_embedder()(F.col("t")).alias("v"))
    a, b, none = (r.v for r in df.collect())
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-6 and not any(none)
    assert abs(value(spark, search.dot(search.unit(F.array(F.lit(3.0), F.lit(4.0))), F.array(F.lit(0.6), F.lit(0.8)))) - 1) < 1e-9


def test_generic_names_meet_names_that_end_in_other_characters(spark):
    names = ["C++", "C++ service", "Acme Inc.", "Acme Inc. server", "Gateway (EU)", "the Gateway (EU)", "東京", "東京 cluster", "k3s", "k3s-cluster app", "k3s one", "x", "x service cluster"]
    df = spark.createDataFrame([(str(n), name, "") for n, name in enumerate(names)], "uuid string, name string, summary string")
    want = {("C++", "C++ service"), ("Acme Inc.", "Acme Inc. server"), ("Gateway (EU)", "the Gateway (EU)"), ("東京", "東京 cluster"), ("k3s", "k3s-cluster app")}
    assert {(r.shorter, r.longer) for r in resolve.generic_names(df).collect()} == want


def test_a_reply_is_parsed_once_however_often_it_is_named(spark):
    """Plans grow with the steps, not with their product: a reply's text stands in them a few times."""
    df = spark.createDataFrame([(1, 'x {"answer": {"answer": 5}} y'), (2, None), (3, '[{"answer": 7}]'), (4, "{ {} no")], "n int, said string")
    out = df.select("n", F.get_json_object(T.unwrapped(T.json_object(F.col("said"))), "$.answer").alias("a"))
    assert {r.n: r.a for r in out.collect()} == {1: "5", 2: None, 3: "7", 4: None}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("said#") < 10


def test_an_index_reads_its_pages_once(spark):
    seen = spark.sparkContext.accumulator(0)
    read = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    kinds = ["entity", "concept", "synthesis", "decision", "source", "memo", None]
    rows = [(f"n{i}", f"wiki/n{i}.md", kinds[i % 7], None, "live", "2024-03-01", "about") for i in range(21)]
    p = spark.createDataFrame(rows, "name string, path string, type string, category string, status string, created string, description string").withColumn("type", read("type"))
    lines = report.index_lines(p).collect()
    assert sorted((r.section, r.ord) for r in lines) == [(s, o) for s in (1, 2, 3, 4) for o in (1, 2, 3)] + [(5, 1)]
    assert seen.value <= 2 * len(rows)
