"""Boundaries to models, each with a deterministic default that needs none.

A plug-in is a function on columns or DataFrames; callers may pass their own of the same shape."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.functions import pandas_udf

from chronolith.functions import text as T

DIM = 64


def hashing_embedder(dim: int = DIM) -> Callable[[Column], Column]:
    """Signed feature hashing of words into a unit vector: equal texts, equal vectors. All in the JVM."""

    def embed(text: Column) -> Column:
        words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
        slots = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(dim)).cast("int").alias("at"), F.when(F.pmod(F.hash(w), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("by")))
        raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda n: F.aggregate(slots, F.lit(0.0), lambda s, x: s + F.when(x.at == n, x.by).otherwise(0.0)))
        norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
        return F.transform(raw, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)).cast("float"))

    return embed


def batch_embedder(call: Callable[[list[str]], np.ndarray]) -> Callable[[Column], Column]:
    """An outside embedder of many texts at a time as an Arrow-batched function, vectors made unit length."""

    @pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        v = np.asarray(call(texts.fillna("").tolist()), dtype=np.float64).reshape(len(texts), -1)
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return pd.Series(list((v / np.where(n > 0, n, 1)).astype(np.float32)))

    return embed


def extract_claims(notes: DataFrame) -> DataFrame:
    """notes(slug, body) -> (slug, ord, fact, entities): the bullets below `## Durable claims` and their wikilinks."""
    section = F.regexp_extract("body", r"(?s)(?:\A|\n)## Durable claims[^\n]*\n(.*?)(?:\n## |\z)", 1)
    bullets = F.regexp_extract_all(section, F.lit(r"(?m)^[ \t]*[-*][ \t]+(.+)$"), F.lit(1))
    rows = notes.select("slug", F.posexplode(bullets).alias("ord", "fact"))
    return rows.select("slug", "ord", F.trim("fact").alias("fact"), T.wikilinks(F.col("fact")).alias("entities"))


def extractive_answer(packets: DataFrame) -> DataFrame:
    """packets(query_id, facts, …) -> a candidate answer: the first current fact, medium confidence, its source."""
    first = F.try_element_at(F.filter("facts", lambda f: f.current), F.lit(1))
    has = first.isNotNull()
    return packets.select(
        "query_id", F.when(has, "medium").otherwise("not_found").alias("confidence"), first["fact"].alias("answer"),
        F.when(has, F.array(first["source_slug"])).otherwise(F.array().cast("array<string>")).alias("sources"), F.lit(None).cast("string").alias("superseded_note"), (~has).alias("escalate"),
    )


def same_entity(a: Column, b: Column) -> Column:
    """The default judge: equal normalised names, or generic words more."""
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return ((T.entity_key(a) == T.entity_key(b)) & (T.entity_key(a) != "")) | T.generic_remainder(shorter, longer)


def combine(a: Column, b: Column, limit: int = 400) -> Column:
    """The default combiner of two summaries: joined, cut at the last sentence within the limit."""
    text = F.concat_ws(" ", a, b)
    cut = F.substring(text, 1, limit)
    whole = F.regexp_extract(cut, r"(?s)\A(.*\.)", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.coalesce(F.nullif(whole, F.lit("")), cut))


PARSED = S.StructType([
    S.StructField("fields", S.MapType(S.StringType(), S.StringType())), S.StructField("tags", S.ArrayType(S.StringType())),
    S.StructField("repeated", S.ArrayType(S.StringType())), S.StructField("error", S.StringType()),
])
KEY = re.compile(r"^([A-Za-z0-9_-]+):[ \t]*(.*)$")


def parse_block(block: str | None) -> tuple[dict[str, str], list[str], list[str], str | None]:
    """(fields, tags, duplicate keys, error) of a plain YAML block: scalars, flow and dash lists, quoted values."""
    fields: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    repeated, last = [], None
    for line in (block or "").split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line.lstrip().startswith("- ") and last:
            lists.setdefault(last, []).append(line.lstrip()[2:].strip().strip("'\""))
            continue
        m = KEY.match(line)
        if not m:
            if line[:1] in " \t" and last:
                fields[last] = f"{fields.get(last, '')} {line.strip()}".strip()
                continue
            return {}, [], [], f"not a mapping line: {line.strip()[:60]}"
        key, value = m[1], m[2].strip()
        if key in fields or key in lists:
            repeated.append(key)
        last = key
        if value[:1] in "'\"":
            if len(value) < 2 or value[-1] != value[0]:
                return {}, [], [], f"open quote in {key}"
            fields[key] = value[1:-1]
        elif value[:1] == "[":
            if value[-1] != "]":
                return {}, [], [], f"open list in {key}"
            lists[key] = [v.strip().strip("'\"") for v in value[1:-1].split(",") if v.strip()]
        elif ": " in value:
            return {}, [], [], f"unquoted colon in {key}"
        else:
            fields[key] = value
    for key, values in lists.items():
        fields.setdefault(key, ", ".join(values))
    return fields, lists.get("tags", []), repeated, None


@pandas_udf(PARSED)
def frontmatter_struct(block: pd.Series) -> pd.DataFrame:
    """The only parser that columns cannot express: an Arrow-batched function over frontmatter blocks."""
    rows = [parse_block(b) for b in block]
    return pd.DataFrame({"fields": [r[0] for r in rows], "tags": [r[1] for r in rows], "repeated": [r[2] for r in rows], "error": [r[3] for r in rows]})


KINDS = S.StructType([
    S.StructField("error", S.StringType()), S.StructField("kinds", S.MapType(S.StringType(), S.StringType())),
    *(S.StructField(c, S.ArrayType(S.StructType([S.StructField("text", S.StringType()), S.StructField("kind", S.StringType())]))) for c in ("tags", "sources")),
])
#: What an unquoted scalar is, by the first pattern that it matches whole; anything else is a string.
SCALARS = (
    ("NoneType", r"|~|null|Null|NULL"), ("bool", r"(?i:true|false|yes|no|on|off)"), ("int", r"[-+]?(0|[1-9][0-9_]*|0[0-7_]+|0x[0-9a-fA-F_]+)"), ("float", r"[-+]?([0-9][0-9_]*\.[0-9_]*|\.[0-9]+)([eE][-+][0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)"),
    ("date", r"\d{4}-\d\d-\d\d"), ("datetime", r"\d{4}-\d\d?-\d\d?([Tt]|[ \t]+)\d\d?:\d\d:\d\d(\.\d*)?([ \t]*(Z|[-+]\d\d?(:?\d\d)?))?"),
)


def scalar_kind(text: str) -> str:
    if text[:1] in "'\"" and len(text) > 1:
        return "str"
    if text.startswith(("[", "{")):
        return "list" if text[0] == "[" else "dict"
    return next((kind for kind, pattern in SCALARS if re.fullmatch(pattern, text)), "str")


def flow_items(inside: str) -> list[str] | None:
    """The items between the brackets of a flow list; None if a quote or a bracket in it stays open."""
    items, item, depth, quote = [], "", 0, ""
    for c in inside:
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"" and not item.strip():
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        if c == "," and not depth and not quote:
            items.append(item.strip())
            item = ""
        else:
            item += c
        if depth < 0:
            return None
    return None if depth or quote else [*items, item.strip()] if item.strip() else items


def typed_block(block: str | None) -> tuple[str | None, dict[str, str], dict[str, list[tuple[str, str]]]]:
    """(error, kinds, lists) of a frontmatter block: the kind of each key's value, and the items of its lists with theirs.
    Lists may be in brackets, over several lines, or of lines that begin with a dash; deeper mappings count as one value."""
    kinds: dict[str, str] = {}
    lists: dict[str, list[tuple[str, str]]] = {}
    rows, key, n = (block or "").split("\n"), None, 0
    bare = lambda v: v[1:-1] if v[:1] in "'\"" and len(v) > 1 else v
    while n < len(rows):
        line, n = re.sub(r"(^|\s)#.*", "", rows[n]) if "'" not in rows[n] and '"' not in rows[n] else rows[n], n + 1
        text = line.strip()
        if not text or text.startswith("#"):
            continue
        if line[0] == "\t":
            return "a tab indents", {}, {}
        if (text == "-" or text.startswith("- ")) and key:
            if kinds[key] not in ("NoneType", "list"):
                return f"a list item below {key}", {}, {}
            item = text[1:].strip()
            kinds[key] = "list"
            lists.setdefault(key, []).append((bare(item), "dict" if scalar_kind(item) == "str" and item[:1] not in "'\"" and re.search(r":( |$)", item) else scalar_kind(item)))
            continue
        if line[0] == " ":
            if not key:
                return f"not a mapping line: {text[:60]}", {}, {}
            kinds[key] = "dict" if kinds[key] == "NoneType" and re.match(r"[^\s:]+:( |$)", text) else "str" if kinds[key] == "NoneType" else kinds[key]
            continue
        m = KEY.match(line)
        if not m:
            return f"not a mapping line: {text[:60]}", {}, {}
        key, value = m[1], m[2].strip()
        lists.pop(key, None)  # the last of equal keys counts
        if value[:1] == "[":
            whole = lambda v: flow_items(v[1:-1]) if v[-1] == "]" and len(v) > 1 else None
            while n < len(rows) and whole(value) is None:
                value, n = f"{value} {rows[n].strip()}", n + 1
            items = whole(value)
            if items is None:
                return f"open list in {key}", {}, {}
            lists[key] = [(bare(v), scalar_kind(v)) for v in items]
        elif value[:1] in "'\"" and value and (len(value) < 2 or value[-1] != value[0]):
            return f"open quote in {key}", {}, {}
        elif value[:1] not in "'\"{" and re.search(r":( |$)", value):
            return f"unquoted colon in {key}", {}, {}
        elif value[:1] in "@`%&*!" and value:
            return f"{key} begins with {value[0]}", {}, {}
        kinds[key] = scalar_kind(value) if value[:1] not in "|>" or not value else "str"
    return None, kinds, lists


@pandas_udf(KINDS)
def frontmatter_kinds(block: pd.Series) -> pd.DataFrame:
    """What the lint rules need of a frontmatter block beyond its text: whether it parses, and what its values are."""
    rows = [typed_block(b) for b in block]
    items = lambda r, key: [{"text": t, "kind": k} for t, k in r[2][key]] if key in r[2] else None
    return pd.DataFrame({"error": [r[0] for r in rows], "kinds": [r[1] for r in rows], "tags": [items(r, "tags") for r in rows], "sources": [items(r, "sources") for r in rows]})
