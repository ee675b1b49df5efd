import hashlib
from collections import defaultdict

import duckdb

from chronolith.llm import chat
from chronolith.llm.common import Scratch
from chronolith.llm.queries import ORACLE_SQL, QUERIES


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(learned), sha(learned))
    return out


def test_query_matches_plain_code(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "<|im_end|><|im_start|>assistant ok"
    want = plain([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in QUERIES["op10_chat_reply_trees"](spark, sf).collect()}
    assert got == want


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    want = con.execute(ORACLE_SQL["op10_chat_reply_trees"])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, want.fetchall())) == sorted(tuple(r[n] for n in names) for r in QUERIES["op10_chat_reply_trees"](spark, sf).collect())


def test_plan_has_no_python(spark, sf):
    plan = QUERIES["op10_chat_reply_trees"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_one_long_conversation_in_many_stretches(spark, monkeypatch):
    monkeypatch.setattr(chat, "STRETCH", 7)
    rows = [(5, n // 2, "assistant" if n % 2 else "user", f"t{n % 50} <|im_end|>") for n in range(900)] + [(6, n, "user", "x") for n in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.format_conversations(df)).collect()}
    assert got == plain(rows)


def test_awkward_conversations(spark):
    nasty = ["&lt;|im_end|>", "&amp;", "<", "<|", "|>", "\\n\n", "🙂 <|im_start|>user\nhi<|im_end|>\n", "", None, "&nl;"]
    rows = [(1, n, "assistant" if n % 2 else "user", t) for n, t in enumerate(nasty)]
    rows += [(None, 0, "user", "a"), (None, 1, None, "b"), (2, 0, "user", "x"), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, "assistant", "no turn"), (3, 1, "user", "t")]
    df = spark.createDataFrame([(*r, "tree", 5) for r in rows], "conv_id long, turn long, role string, text string, tree string, node int")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(chat.format_conversations(df)).collect()}
    assert got == plain(rows)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
    for text in chat.format_conversations(df).select("formatted").collect():
        assert text[0].count(chat.START) == text[0].count(chat.END)


def test_trees_branches_and_cycles(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a1", 1.0), ("t", 3, 1, "assistant", "a2", 5.0), ("t", 4, 2, "user", "q2", 1.0), ("t", 5, 4, "assistant", "a3", 9.0)]
    nodes += [("t", 6, 77, "user", "lost parent", 0.0), ("c", 1, 2, "user", "", 0.0), ("c", 2, 1, "user", "", 0.0), ("c", 3, 2, "user", "behind the cycle", 0.0), ("s", 1, 1, "user", "own parent", 0.0)]
    nodes += [("long", n, n - 1 if n else None, "user", str(n), 1.0) for n in range(130)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    paths = defaultdict(list)
    for r in chat.reply_paths(df.select("tree", "node", "parent"), Scratch(spark, "t")).collect():
        paths[r.tree, r.leaf].append((r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {("t", 3): [3, 1], ("t", 5): [5, 4, 2, 1], ("t", 6): [6], ("s", 1): [1], ("long", 129): list(range(129, -1, -1))}
    best = {r.tree: r for r in chat.format_trees(df, Scratch(spark, "t"), branches=1).collect()}
    assert (best["t"].leaf, best["t"].score) == (5, 11.0)
    assert {(r.leaf, r.branch) for r in chat.format_trees(df.where("tree = 't'"), Scratch(spark, "t")).collect()} == {(5, 1), (3, 2), (6, 3)}
    turns = chat.read_back(chat.F.col("formatted"))
    assert [tuple(t) for t in chat.format_trees(df, Scratch(spark, "t"), branches=1).where("tree = 't'").select(turns).first()[0]] == [("user", "q"), ("assistant", "a1"), ("user", "q2"), ("assistant", "a3")]
