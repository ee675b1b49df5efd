"""Lint on parsed frontmatter: errors that end a page, lists that are none, entries that are no strings."""

import pytest

from chronolith.functions.plugins import typed_block
from chronolith.operators import lint, pages


@pytest.mark.parametrize(
    ("block", "kinds"),
    [
        ("type: entity\nn: 12\nf: 1.5\nb: yes\nd: 2024-01-02\nt: 2024-01-02 10:00:00\ne:\nq: '12'\nz: ~", {"type": "str", "n": "int", "f": "float", "b": "bool", "d": "date", "t": "datetime", "e": "NoneType", "q": "str", "z": "NoneType"}),
        ("tags: [a, 'b, c', 3]\nm:\n  k: v\nl:\n- x\n- 2\ns: one\n  more\nj: {a: 1}\nc: x # said", {"tags": "list", "m": "dict", "l": "list", "s": "str", "j": "dict", "c": "str"}),
        ("sources: [[[a]],\n  \"[[b]]\"]\ntext: |\n  a: b\n", {"sources": "list", "text": "str"}),
        ("a: 1\na: x", {"a": "str"}),
        ("", {}),
    ],
)
def test_kinds(block, kinds):
    assert typed_block(block)[:2] == (None, kinds)


@pytest.mark.parametrize("block", ["a: b: c", "a: 'open", "tags: [a, b", "just words", "a: 1\n- b", " indented: 1", "a: @b", "\ta: 1", "tags: [a]]"])
def test_what_does_not_parse(block):
    assert typed_block(block)[0] and typed_block(block)[1:] == ({}, {})


def test_items():
    assert typed_block("tags: [a, 'b, c', 3, True, [[x]]]")[2] == {"tags": [("a", "str"), ("b, c", "str"), ("3", "int"), ("True", "bool"), ("[[x]]", "list")]}
    assert typed_block("sources:\n- \"[[a]]\"\n- [[b]]\n- k: v\n-")[2] == {"sources": [("[[a]]", "str"), ("[[b]]", "list"), ("k: v", "dict"), ("", "NoneType")]}


def test_rules(spark):
    front = {
        "good": "type: concept\ntags: [a]\ncreated: 2024-01-01\nupdated: '2024-01-01'\nsources: [\"[[good]]\"]", "broken": "type: concept\ntags: [Big Tag\n", "tags": "type: concept\ntags: one", "numbers": "type: concept\ntags:\n- 1\n- Ab\nsources: [[good]]",
        "none": "type: concept\ntags:\nsources:\ncreated:\nupdated: 20240101", "moment": "type: concept\ncreated: 2024-01-01 10:00:00",
    }
    rows = [(f"wiki/{n}.md", n, f"---\n{b}\n---\n# {n}\n") for n, b in front.items()]
    found = pages.catalog(spark.createDataFrame(rows, "path string, name string, content string"))
    got = sorted((r.file[5:-3], r.severity, r.rule) for r in lint.lint(found).collect())
    assert got == [
        ("broken", "error", "frontmatter_parse"), ("none", "warning", "created"), ("none", "warning", "sources"), ("none", "warning", "updated"),
        ("numbers", "warning", "source_string"), ("numbers", "warning", "tag_case"), ("numbers", "warning", "tag_string"), ("tags", "warning", "tags"),
    ]
