"""Publication of the page index: what is known at once is served as degraded, then the whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.sources.files import HASH_FORMATS
from chronolith.sources.published import DEGRADED, READY, Published, Version

from .order import saved
from .search import few

#: What a cached vector's hash was taken of: the body, or the embedding's input.
LEGACY, EXACT = HASH_FORMATS
PAGES = "pages"


def with_cached(scanned: DataFrame, cached: DataFrame | None) -> DataFrame:
    """scanned(name, text, embedding_hash, body_hash, …) with the vector, or null, that cached(name, vector, embedding_hash,
    body_hash, hash_format) has for the same input, and how it was found: by the exact hash, or once more by the body's."""
    if cached is None:
        return scanned.withColumns({"vector": F.lit(None).cast("array<double>"), "legacy": F.lit(False)})
    known = cached.where("vector is not null").select("name", F.col("vector"), F.col("embedding_hash").alias("was"), F.col("body_hash").alias("was_body"), "hash_format")
    joined = scanned.join(known, "name", "left")
    legacy = (F.col("hash_format") == LEGACY) & (F.col("was_body") == F.col("body_hash"))
    same = (F.col("hash_format") == EXACT) & (F.col("was") == F.col("embedding_hash"))
    return joined.withColumn("vector", F.when(same | legacy, F.col("vector"))).withColumn("legacy", F.coalesce(legacy & ~same, F.lit(False))).drop("was", "was_body", "hash_format")


def texts(scanned: DataFrame, rows: DataFrame, some: bool) -> DataFrame:
    """(name, text) of the pages without a vector; some: not of all pages. A page that changed since is none of them."""
    if not some:
        return scanned.select("name", "text")
    want = few(rows.where("vector is null").select(F.col("name").alias("of"), F.col("embedding_hash").alias("was")))
    return scanned.join(want, F.col("name").eqNullSafe(F.col("of")) & F.col("embedding_hash").eqNullSafe(F.col("was")), "left_semi").select("name", "text")


def reindex(store: Published, scanned: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> dict:
    """Publishes scanned(name, text, embedding_hash, body_hash, …), names unique, with vectors: those whose input is unchanged
    from the last version, and `embed` of the rest, rows(name, text) -> (name, vector). While there is something to embed
    and something cached, the catalog with the cached vectors is published first, as degraded. If embedding fails, or returns
    another number of vectors, that stays, or is published, with the error's name; vectors already paid for are kept. A scan
    without pages publishes nothing and is an error. Returns what was done."""
    last = store.latest()
    cached = store.table(last.tables[PAGES]) if last else None
    rows = saved(with_cached(scanned.drop("text"), cached))  # texts are neither joined nor written
    count = rows.agg(F.count("*").alias("pages"), F.count("vector").alias("unchanged"), F.count_if("legacy").alias("migrated")).first()
    if not count.pages:
        return {"ok": False, "retry_needed": True, "error": "NoPages", "version": last.number if last else None}
    removed = cached.join(rows, "name", "left_anti").count() if cached is not None else 0
    missing = count.pages - count.unchanged
    said = {"pages": count.pages, "unchanged": count.unchanged, "legacy_migrated": count.migrated, "removed": removed}
    shown = rows.drop("legacy").withColumn("hash_format", F.lit(EXACT))

    def publish(pages: DataFrame, status: str, after: Version | None, omitted: int, error: str | None) -> Version:
        return store.commit({PAGES: store.write(pages, PAGES)}, status, {"omitted": omitted, "scanned": count.pages, "error": error}, after)

    if not missing:
        done = publish(shown, READY, last, 0, None)
        return {"ok": True, "retry_needed": False, "embedded": 0, "omitted": 0, "error": None, "version": done.number, **said}
    if count.unchanged:
        last = publish(shown, DEGRADED, last, missing, None)
    try:
        new = saved(embed(texts(scanned, rows, missing < count.pages)).select("name", F.col("vector").alias("made")).where("made is not null"))
        if (got := new.select("name").distinct().count()) != missing:
            raise ValueError(f"{got} vectors for {missing} pages")
    except Exception as e:  # whatever a provider raises: the catalog stays readable
        done = publish(shown, DEGRADED, last, missing, type(e).__name__)
        return {"ok": False, "retry_needed": True, "embedded": 0, "omitted": missing, "error": type(e).__name__, "version": done.number, **said}
    whole = shown.join(new, "name", "left").withColumn("vector", F.coalesce("vector", "made")).drop("made")
    done = publish(whole, READY, last, 0, None)
    return {"ok": True, "retry_needed": False, "embedded": missing, "omitted": 0, "error": None, "version": done.number, **said}
