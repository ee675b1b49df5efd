"""A full-text index that outlives a call: segments of postings in the shared store, published by version.

A segment holds the documents of one ingest: slots of some SLOT documents of like length, a row each, with the slot's documents
and for each of its terms the places of those that have it; postings, a row for each term and slot with the number of its
documents, their largest frequency and their smallest length; its documents; and what it takes from earlier segments' counts. A
document that is added again or removed lives on in its old segment only as dead. Postings lie in folders by term hash, ordered
by it, so that a search opens those of its own terms. Merging writes the living documents as one segment.

Texts are read where they lie: each task makes slots of its own texts, so no text is shuffled or written, and a place in a slot is
a small number at any size.

A search reads the postings' bounds first, scores the most promising slots, and then only those whose bound reaches the k-th
score so far: the same scores and ranks as `search.bm25` over all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.sources.published import Published, Version

from . import scoring
from .order import numbered, saved
from .search import K1, B, few, none_ranked, terms, top_k

#: Documents of a slot, folders of postings and their slices by slot, slots that a query scores first, slots whose postings
#: travel in one row of a folder.
SLOT, FOLDERS, SLICES, FIRST, TOGETHER = 256, 64, 16, 16, 32
#: Up to so many slots are named when the slots are read; bytes of an Arrow batch, and of a row group of slots, whose rows have
#: some 0.5 MB each.
NAMED, BATCH = 1_000, 16 << 20
ID = "id long"
#: Of a slot: its documents by id, its terms in order, how many documents have each, and for term after term their places and frequencies.
SLOTS = "slot long, ids array<long>, dls array<int>, terms array<string>, n array<int>, at array<int>, tf array<int>"
#: Postings of some slots and one folder: its terms, joined by blanks, in how many slots each is, and slot after slot.
PACKED = "folder int, slice int, terms string, count array<int>, slot array<long>, n array<int>, most array<int>, shortest array<int>"
LISTS = "term string, slot long, n long, most long, shortest long"


def folder(h: Column) -> Column:
    return F.shiftrightunsigned(h, 58).cast("int")


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have at most BATCH bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)


def flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def listed(values: np.ndarray, sizes: np.ndarray | list[int], kind: pa.DataType) -> pa.ListArray:
    """The values cut into lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values, kind))


def slot_row(slot: int, ids: np.ndarray, dls: np.ndarray, told: pa.Array, term: np.ndarray, at: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """The row of a slot from its cells (number of a term of `told`, place, frequency), a cell once."""
    used = np.unique(term)
    words = told.take(pa.array(used))
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(used), np.int64)
    place[order] = np.arange(len(used))
    by = np.searchsorted(used, term)
    cells = np.lexsort((at, place[by]))
    n = np.bincount(place[by], minlength=len(used))
    one = lambda values, kind: listed(values, [len(values)], kind)
    words = words.take(pa.array(order))
    columns = [pa.array([slot], pa.int64()), one(ids, pa.int64()), one(dls.astype(np.int32), pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words)]
    columns += [one(n.astype(np.int32), pa.int32()), one(at[cells].astype(np.int32), pa.int32()), one(tf[cells].astype(np.int32), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["slot", "ids", "dls", "terms", "n", "at", "tf"])


def slots_of(docs: DataFrame) -> DataFrame:
    """docs(id, words array) -> SLOTS: the documents of a batch, by length, in slots of at most SLOT."""
    most = SLOT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for b in batches:
            words, ids = b.column("words"), b.column("id").to_numpy()
            dl = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            for own in np.array_split(np.lexsort((ids, dl)), -(-len(ids) // most)) if len(ids) else ():
                own = own[np.argsort(ids[own])]
                told = pc.dictionary_encode(words.take(pa.array(own)).flatten())
                key, tf = np.unique(told.indices.to_numpy().astype(np.int64) * len(own) + np.repeat(np.arange(len(own)), dl[own]), return_counts=True)
                yield slot_row(number, ids[own], dl[own], told.dictionary, key // len(own), key % len(own), tf)
                number += 1

    return docs.select("id", "words").mapInArrow(run, SLOTS)


def cells(b: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """ids, lengths, terms, how many documents each term has, places and frequencies of a batch's row of SLOTS."""
    one = b.slice(row, 1)
    ids, dls, n, at, tf = (flat(one.column(c)) for c in ("ids", "dls", "n", "at", "tf"))
    return ids, dls.astype(np.int64), one.column("terms").flatten(), n.astype(np.int64), at.astype(np.int64), tf.astype(np.int64)


def postings_of(slots: DataFrame) -> DataFrame:
    """SLOTS -> LISTS in folders: each in a few files by slot, ordered by the terms' hashes. They travel packed, the terms of
    some TOGETHER slots once."""
    together, slices = TOGETHER, SLICES
    hashed = slots.select("slot", "dls", "terms", F.transform("terms", lambda t: folder(F.xxhash64(t))).alias("folders"), "n", "at", "tf")

    def pack(some: list[tuple], number: int) -> Iterator[pa.RecordBatch]:
        told = pc.dictionary_encode(pa.concat_arrays([s[1] for s in some]))
        term, size = told.indices.to_numpy().astype(np.int64), [len(s[1]) for s in some]
        slot = np.repeat(np.array([s[0] for s in some], np.int64), size)
        folders, n, most, shortest = (np.concatenate([s[c] for s in some]) for c in (2, 3, 4, 5))
        order = np.lexsort((slot, term, folders))
        ends = np.searchsorted(folders[order], np.arange(FOLDERS + 1))
        for f in range(FOLDERS):
            own = order[ends[f] : ends[f + 1]]
            if not len(own):
                continue
            used, start, count = np.unique(term[own], return_index=True, return_counts=True)
            text = " ".join(told.dictionary.take(pa.array(used)).to_pylist())
            row = [pa.array([f], pa.int32()), pa.array([number % slices], pa.int32()), pa.array([text]), listed(count.astype(np.int32), [len(used)], pa.int32()), listed(slot[own], [len(own)], pa.int64())]
            row += [listed(c[own].astype(np.int32), [len(own)], pa.int32()) for c in (n, most, shortest)]
            yield pa.RecordBatch.from_arrays(row, ["folder", "slice", "terms", "count", "slot", "n", "most", "shortest"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, number = [], TaskContext.get().partitionId()
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                n, at, tf, dls = (flat(one.column(c)) for c in ("n", "at", "tf", "dls"))
                if not len(n):
                    continue
                start = np.cumsum(n.astype(np.int64)) - n
                some.append((one.column("slot")[0].as_py(), one.column("terms").flatten(), flat(one.column("folders")), n, np.maximum.reduceat(tf, start), np.minimum.reduceat(dls[at], start)))
                if len(some) == together:
                    yield from pack(some, number)
                    some, number = [], number + 1
        if some:
            yield from pack(some, number)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                words = pa.array(one.column("terms")[0].as_py().split(" "), pa.string())
                term = words.take(pa.array(np.repeat(np.arange(len(words)), flat(one.column("count")))))
                yield pa.RecordBatch.from_arrays([term, *[pa.array(flat(one.column(c)).astype(np.int64)) for c in ("slot", "n", "most", "shortest")]], ["term", "slot", "n", "most", "shortest"])

    lists = hashed.mapInArrow(packed, PACKED).repartition("folder", "slice").mapInArrow(unpacked, LISTS).withColumn("h", F.xxhash64("term"))
    return lists.withColumn("folder", folder(F.col("h"))).sortWithinPartitions("folder", "h", "slot")


def stored(store: Published, slots: DataFrame) -> dict[str, str]:
    """Writes slots, and by what is written their postings and documents."""
    small_batches(store.spark)
    made = {"slots": store.write(slots, "slots", row_group=BATCH)}
    slots = store.table(made["slots"])
    made["postings"] = store.write(postings_of(slots), "postings", "folder")
    documents = slots.select("slot", F.posexplode(F.arrays_zip("ids", "dls")).alias("at", "of")).select(F.col("of.ids").alias("id"), F.col("of.dls").cast("long").alias("dl"), "slot", "at")
    made["documents"] = store.write(documents.withColumn("folder", folder(F.xxhash64("id"))).repartition("folder"), "documents", "folder")
    return made


def segment(store: Published, docs: DataFrame, removed: DataFrame, earlier: Version | None) -> dict[str, str]:
    """Writes the tables of a segment of docs(id, text), ids unique, over removed(id) and the earlier version."""
    made = stored(store, slots_of(docs.select("id", terms(F.col("text")).alias("words"))))
    ids, old = store.table(made["documents"]).select("id").unionByName(removed.select(F.col("id").cast("long"))), parts(store, earlier, "documents")
    if old is None:
        made["dead"] = store.write(ids.limit(0).select("id", F.lit(0).alias("segment"), F.lit(0).cast("long").alias("slot"), F.lit(0).alias("at")), "dead")
        made["minus"] = store.write(ids.limit(0).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("words")), "minus")
        return made
    ids = saved(ids.distinct())
    touched = old.join(few(ids.withColumn("folder", folder(F.xxhash64("id")))), ["folder", "id"])  # opens the ids' folders
    alive = saved(without_dead(store, earlier, touched).select("id", "segment", "slot", "at", "dl"))
    made["dead"] = store.write(alive.select("id", "segment", "slot", "at"), "dead")
    # what no longer counts: documents and words under no term, and documents by term
    gone = alive.agg(F.lit("").alias("term"), F.lit(0).cast("long").alias("n"), F.count("*").alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("words"))
    lost = parts(store, earlier, "slots").join(few(alive.groupBy("segment", "slot").agg(F.collect_set("at").alias("gone"))), ["segment", "slot"])
    made["minus"] = store.write(gone.unionByName(lost_terms(lost).select("term", "n", F.lit(0).cast("long").alias("docs"), F.lit(0).cast("long").alias("words"))), "minus")
    return made


def lost_terms(slots: DataFrame) -> DataFrame:
    """SLOTS with gone, the places of documents that go -> (term, n): how many of them have a term, in one row or several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, _, words, n, at, _ = cells(b, i)
                dead = np.zeros(len(ids), bool)
                dead[flat(b.column("gone").slice(i, 1))] = True
                count = np.bincount(np.repeat(np.arange(len(n)), n)[dead[at]], minlength=len(n))
                used = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([words.take(pa.array(used)), pa.array(count[used].astype(np.int64))], ["term", "n"])

    return slots.select("ids", "dls", "terms", "n", "at", "tf", "gone").mapInArrow(run, "term string, n long")


def parts(store: Published, version: Version | None, name: str) -> DataFrame | None:
    """A table of all segments, with the segment's number."""
    out = None
    for at, path in sorted(version.tables.items()) if version else []:
        n, kind = at.split("/")
        if kind == name:
            one = store.table(path)
            one = one if name == "dead" else one.withColumn("segment", F.lit(int(n)))
            out = one if out is None else out.unionByName(one)
    return out


def dead_by_slot(store: Published, version: Version) -> DataFrame:
    """(segment, slot, gone): the places of a slot's documents that no longer live."""
    return parts(store, version, "dead").groupBy("segment", "slot").agg(F.collect_set("at").alias("gone"))


def without_dead(store: Published, version: Version, rows: DataFrame) -> DataFrame:
    """rows(at, segment, slot, …) of documents that live in their segment."""
    return rows.join(few(dead_by_slot(store, version)), ["segment", "slot"], "left").where(~F.coalesce(F.array_contains("gone", F.col("at")), F.lit(False))).drop("gone")


def statistics(store: Published, version: Version) -> tuple[int, float]:
    """How many documents live, and their mean length."""
    docs = parts(store, version, "documents").agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("w")).first()
    minus = parts(store, version, "minus").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("w")).first()
    n = docs.n - minus.n
    return n, (docs.w - minus.w) / n if n else 0.0


def once(docs: DataFrame) -> DataFrame:
    """docs(id, text) with each id once, with its largest text; null ids are left out, null texts are empty. Only texts whose id
    is repeated are shuffled."""
    docs = docs.where("id is not null").select(F.col("id").cast("long").alias("id"), "text")
    repeated = saved(docs.groupBy("id").count().where("count > 1").select("id"))
    if repeated.limit(1).count():
        some = few(repeated)
        docs = docs.join(some, "id", "left_anti").unionByName(docs.join(some, "id", "left_semi").groupBy("id").agg(F.max("text").alias("text")))
    return docs.select("id", F.coalesce("text", F.lit("")).alias("text"))


def ingest(store: Published, docs: DataFrame, removed: DataFrame | None = None) -> Version:
    """Adds or replaces docs(id, text) and takes removed(id) away, as one new segment and one new version. Of rows that repeat
    an id one counts, the largest text; null ids are left out; a null text has no words."""
    spark, last = store.spark, store.latest()
    removed = removed if removed is not None else spark.createDataFrame([], ID)
    number = 1 + max((int(at.split("/")[0]) for at in last.tables), default=0) if last else 1
    tables = {f"{number}/{k}": v for k, v in segment(store, once(docs), removed, last).items()}
    version = Version(0, "", {**(last.tables if last else {}), **tables})
    n, mean = statistics(store, version)
    return store.commit(version.tables, about={"documents": n, "mean_length": mean}, after=last)


def merge(store: Published) -> Version:
    """All living documents as one segment. Slots are kept together: the dead leave them, they are numbered anew by their shortest
    document, and where they are less than half full several become one. No text is read."""
    last = store.latest()
    living = without_dead(store, last, parts(store, last, "documents"))
    sizes = saved(living.groupBy("segment", "slot").agg(F.count("*").alias("living"), F.min("dl").alias("shortest")))
    held = sizes.agg(F.count("*").alias("slots"), F.coalesce(F.sum("living"), F.lit(0)).alias("living")).first()
    full = held.living / (SLOT * max(held.slots, 1))
    joined = full < 0.5
    to = F.floor(F.col("number") * full) if joined else F.col("number")
    slots = numbered(sizes.drop("living"), "shortest", "segment", "slot").select("segment", "slot", to.cast("long").alias("to"))
    kept = saved(slots.join(few(dead_by_slot(store, last)), ["segment", "slot"], "left"))

    def together(rows: list[tuple], slot: int) -> pa.RecordBatch:
        """Slots as one: documents by id, each term once."""
        ids, dls = (np.concatenate([r[c] for r in rows]) for c in (0, 1))
        place = np.argsort(np.argsort(ids))
        before = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        told = pc.dictionary_encode(pa.concat_arrays([r[2] for r in rows]))
        term = np.repeat(told.indices.to_numpy().astype(np.int64), np.concatenate([r[3] for r in rows]))
        at = place[np.concatenate([r[4] + b for r, b in zip(rows, before)])]
        order = np.argsort(ids)
        return slot_row(slot, ids[order], dls[order], told.dictionary, term, at, np.concatenate([r[5] for r in rows]))

    def living_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, dls, words, n, at, tf = cells(b, i)
                on = np.ones(len(ids), bool)
                on[flat(b.column("gone").slice(i, 1))] = False
                cell = on[at]
                n = np.bincount(np.repeat(np.arange(len(n)), n)[cell], minlength=len(n))
                yield together([(ids[on], dls[on], words, n, (np.cumsum(on) - 1)[at[cell]], tf[cell])], b.column("to")[i].as_py())

    def joint(rows: pa.Table) -> pa.Table:
        b = rows.combine_chunks().to_batches()[0]
        return pa.Table.from_batches([together([cells(b, i) for i in range(b.num_rows)], b.column("slot")[0].as_py())])

    merged = parts(store, last, "slots").join(few(kept), ["segment", "slot"]).drop("segment", "slot").mapInArrow(living_only, SLOTS)
    made = stored(store, merged.groupBy("slot").applyInArrow(joint, SLOTS) if joined else merged)
    number = 1 + max(int(at.split("/")[0]) for at in last.tables)
    made["dead"] = store.write(parts(store, last, "dead").limit(0), "dead")
    made["minus"] = store.write(parts(store, last, "minus").drop("segment").limit(0), "minus")
    return store.commit({f"{number}/{k}": v for k, v in made.items()}, about=last.about, after=last)


def search(store: Published, queries: DataFrame, k: int, digits: int = 6, version: Version | None = None, most_terms: int = 100_000) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each of queries(query_id, query) by BM25, of the latest version
    or the one given. Queries are a stated set; up to `most_terms` different terms of them choose the folders and pages that
    are read, more are joined. Queries without a known term, and an empty index, give no rows."""
    version, out = version or store.latest(), None
    small_batches(store.spark)
    for some in scoring.blocks(queries, scoring.ASKED):
        best = top_k(search_block(store, some, k, digits, version, most_terms), k, "id")
        out = best if out is None else out.unionByName(best)
    return out if out is not None else none_ranked(queries, parts(store, version, "documents"))


def search_block(store: Published, queries: DataFrame, k: int, digits: int, version: Version, most_terms: int) -> DataFrame:
    """(query_id, id, score) with the k best documents of each of a block of queries."""
    n, mean = version.about["documents"], version.about["mean_length"] or 1.0
    asked = saved(queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).withColumn("h", F.xxhash64("term")))
    hashes = [r.h for r in asked.select("h").distinct().limit(most_terms + 1).collect()]
    postings, minus = parts(store, version, "postings"), parts(store, version, "minus")
    if len(hashes) <= most_terms:
        folders = sorted({(h % 2**64) >> 58 for h in hashes})
        postings = postings.where(F.col("folder").isin(folders) & F.col("h").isin(hashes))
    # read twice, for what the terms weigh and for the slots' bounds: fewer bytes than writing those of all questions' terms
    bounds = postings.join(few(asked.select("term").distinct()), "term", "left_semi").select("term", "segment", "slot", "n", "most", "shortest")
    lost = minus.where("term <> ''").join(few(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("lost"))
    df = bounds.groupBy("term").agg(F.sum("n").alias("df")).join(lost, "term", "left").select("term", (F.col("df") - F.coalesce("lost", F.lit(0))).alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = saved(asked.join(df, "term").where("df > 0").select("query_id", "term", idf.alias("idf")))
    part = F.col("idf") * F.col("most") * (K1 + 1) / (F.col("most") + K1 * (1 - B + B * F.col("shortest") / F.lit(mean)))
    by_slot = bounds.join(few(weights), "term").groupBy("query_id", "segment", "slot").agg(F.sum(part).alias("score"))
    slots = saved(top_k(by_slot, 2**31 - 1, "segment", "slot").select("query_id", "segment", "slot", F.col("score").alias("bound"), "rank"))
    of = scoring.Question(weights)
    by_term = {r.term: r.idf for r in weights.select("term", "idf").distinct().collect()}  # the block's terms
    weighed = of.cells * np.array([by_term[t] for t in of.terms.to_pylist()])
    # bounds are sums of the same terms in another order: half a unit of the last digit is far more than they may be off
    off = 10.0**-digits

    def scored(chosen: DataFrame, first: bool, least: np.ndarray) -> DataFrame:
        """Of the slots of chosen(query_id, segment, slot) the living documents that may be best, with their scores. first: for
        the chosen questions; else for all but the chosen ones whose bound reaches `least`."""
        told, names = queries.sparkSession.sparkContext.broadcast((of, weighed, least)), ["query_id", "id", "score"]
        numbers = queries.sparkSession.createDataFrame(pa.table({"query_id": of.ids, "query": pa.array(np.arange(len(of.ids)), pa.int32())}))
        opened = chosen.join(F.broadcast(numbers), "query_id").groupBy("segment", "slot").agg(F.collect_set(F.when(F.col("rank") <= FIRST, F.col("query"))).alias("asking"))
        rows = parts(store, version, "slots")
        named = [r.slot for r in opened.select("slot").distinct().limit(NAMED + 1).collect()]
        if len(named) <= NAMED:
            rows = rows.where(F.col("slot").isin(named))
        opened = saved(opened.join(few(dead_by_slot(store, version)), ["segment", "slot"], "left"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, weighed, least = told.value
            least = least.copy()
            for b in batches:
                for i in range(b.num_rows):
                    ids, dls, words, size, at, tf = cells(b, i)
                    code = of.codes(words)
                    if not (code >= 0).any():
                        continue
                    on = np.ones(len(ids), bool)
                    on[flat(b.column("gone").slice(i, 1))] = False
                    asking = flat(b.column("asking").slice(i, 1)).astype(np.int64)
                    if not first:
                        start = np.cumsum(size) - size
                        most, shortest = np.maximum.reduceat(tf, start), np.minimum.reduceat(dls[at], start)
                        top = np.zeros(len(of.terms))
                        top[code[code >= 0]] = scoring.weight(most.astype(np.float64), shortest.astype(np.float64), mean)[code >= 0]
                        may = weighed @ top
                        may = (may > 0) & ((may + off) * 10.0**digits >= least)
                        may[asking] = False
                        asking = np.flatnonzero(may)
                    used = np.flatnonzero((weighed[asking] > 0).any(axis=0))
                    column = np.full(len(of.terms) + 1, -1)
                    column[used] = np.arange(len(used))
                    term = np.repeat(column[code], size)
                    cell = np.flatnonzero((term >= 0) & on[at])
                    cell = cell[np.argsort(at[cell], kind="stable")]
                    value = scoring.weight(tf[cell].astype(np.float64), dls[at[cell]].astype(np.float64), mean)
                    own = least[asking]
                    for q, j, score in scoring.scored(weighed[asking][:, used], of, at[cell], term[cell], value, len(ids), k, digits, own):
                        if len(q):
                            yield pa.RecordBatch.from_arrays([of.ids.take(pa.array(asking[q])), pa.array(ids[j]), pa.array(score)], names)
                    least[asking] = own

        met = rows.join(few(opened), ["segment", "slot"]).drop("segment", "slot").mapInArrow(run, scoring.schema(queries, parts(store, version, "documents")))
        return met.withColumn("score", F.round("score", digits))

    best = saved(scored(slots.where(F.col("rank") <= FIRST), True, np.full(len(of.ids), -np.inf)))
    reached = top_k(best, k, "id").groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("least"))
    by_query = {r.query_id: r.least for r in reached.collect() if r.least is not None}  # a row a question of the block
    least = np.array([np.floor(by_query[q] * 10.0**digits + 0.5) if q in by_query else -np.inf for q in of.ids.to_pylist()])
    over = slots.join(few(reached), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - off))
    rest = over.where(F.col("rank") > FIRST).select("segment", "slot").distinct()
    return best.unionByName(scored(slots.join(few(rest), ["segment", "slot"], "left_semi"), False, least))
