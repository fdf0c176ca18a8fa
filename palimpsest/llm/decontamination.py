"""Benchmark decontamination by winnowing.

Of every ``window - gram + 1`` consecutive k-grams the one with the least hash
is kept, on the benchmark and on the documents alike.  Two texts that share
``window`` words share the k-grams of those words, so they share the least one:
every shared span of that length has a kept fingerprint in common, and extending
the hits to whole windows finds all of them.

The benchmark's size is summed first.  While it is below ``broadcast_bytes`` its
fingerprints are broadcast: the join is a look-up, and the documents are read once,
without a shuffle.  A larger benchmark is joined by shuffles: fingerprints of documents
meet those of items, the documents that have one in common extend it to the windows
that hold it, and these meet the items' windows.  Only hashes are shuffled for
documents without a common fingerprint, and nothing but lengths is brought to the
driver.  Both ways give the same rows.

Null and empty texts have no words: documents without words are clean, items
without words match nothing.  An item with a null id still marks words but is
not listed.  Repeated rows give repeated results.  Other columns are ignored by
``contamination`` and kept by ``decontaminated``, whatever their names.  Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.frames import arrow_map, free_name, text_rows
from palimpsest.llm.staging import staged
from palimpsest.llm.workers import tidy

WINDOW = 10
GRAM = 4
BROADCAST_BYTES = 16 << 20


def winnow(grams: np.ndarray, reach: int) -> np.ndarray:
    """Positions of the least of each ``reach`` consecutive hashes, the last one on ties."""
    n = len(grams) - reach + 1
    if n <= 0:
        return np.empty(0, np.int64)
    least, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, reach):
        lower = grams[j : j + n] <= least
        np.copyto(least, grams[j : j + n], where=lower)
        at[lower] = j
    kept = np.zeros(len(grams), bool)
    kept[at + np.arange(n)] = True
    return np.flatnonzero(kept)


@dataclass
class Index:
    """What documents are compared with: by window length, fingerprints and whole windows of items."""

    prints: dict[int, np.ndarray] = field(default_factory=dict)
    whole: dict[int, np.ndarray] = field(default_factory=dict)
    #: for whole[n][i], items rows[n][first[n][i]:first[n][i + 1]]
    first: dict[int, np.ndarray] = field(default_factory=dict)
    rows: dict[int, np.ndarray] = field(default_factory=dict)
    names: list[str | None] = field(default_factory=list)


def shape(length: int, window: int, gram: int) -> tuple[int, int]:
    """k and the number of k-grams of a window of so many words."""
    k = min(gram, length)
    return k, length - k + 1


def index_items(names: list[str | None], texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> Index:
    out = Index(names=names)
    found = W.split(texts, W.ALNUM, lower=True)
    hashes, counts = found.hashes(), found.counts
    lengths = np.minimum(counts, window)
    for n in np.unique(lengths[lengths > 0]).tolist():
        prints, whole, owner = [], [], []
        for item in np.flatnonzero(lengths == n).tolist():
            own = hashes[found.first[item] : found.first[item + 1]]
            k, reach = shape(n, window, gram)
            grams = W.windows(own, k)
            prints.append(grams[winnow(grams, reach)])
            whole.append(np.unique(W.windows(own, n)))
            owner.append(np.full(len(whole[-1]), item))
        every, rows = np.concatenate(whole), np.concatenate(owner)
        order = np.argsort(every, kind="stable")
        out.prints[n] = np.unique(np.concatenate(prints))
        out.whole[n], at = np.unique(every[order], return_index=True)
        out.first[n], out.rows[n] = np.append(at, len(every)), rows[order]
    return out


def member(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in a sorted table, and where."""
    if not len(table):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values, at


def match(found: W.Words, index: Index, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks of hit words, and pairs (document, item row) with an occurring window."""
    marks = np.zeros(len(found.start) + 1, np.int32)
    docs, items = [], []
    owner = found.owner
    for n, prints in index.prints.items():
        starts, hashes = windows_with(found, prints, n, gram)
        if not len(starts):
            continue
        same, at = member(hashes, index.whole[n])
        starts, at = starts[same], at[same]
        np.add.at(marks, starts, 1)
        np.add.at(marks, starts + n, -1)
        first, last = index.first[n][at], index.first[n][at + 1]
        docs.append(np.repeat(owner[starts], last - first))
        items.append(index.rows[n][np.repeat(first - np.cumsum(np.append(0, (last - first)[:-1])), last - first) + np.arange((last - first).sum())])
    pairs = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1) if docs else np.empty((2, 0), np.int64)
    return np.cumsum(marks[:-1]) > 0, pairs[0], pairs[1]


def spans_of(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of marked words inside documents: start, end, and runs before each document."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[first] = True
    solid = np.concatenate([[False], hit, [False]])
    start = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    end = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    return start, end, np.searchsorted(start, first)


def item_rows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    return benchmark.select(F.col(key).cast("string").alias("name"), F.col(text).cast("string").alias("text")).where("text IS NOT NULL")


def windows_with(found: W.Words, prints: np.ndarray, n: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of n words inside documents that hold one of the fingerprints."""
    hashes, owner = found.hashes(), found.owner
    k, reach = shape(n, n, gram)
    grams = W.windows(hashes, k)
    kept = winnow(grams, reach) if reach > 1 else np.arange(len(grams))
    anchors = kept[member(grams[kept], prints)[0]]
    starts = np.unique((anchors[:, None] - np.arange(reach)).ravel())
    starts = starts[(starts >= 0) & (starts + n <= len(hashes))]
    starts = starts[owner[starts] == owner[starts + n - 1]] if len(starts) else starts
    total = hashes[starts].copy()
    for j in range(1, n):
        total *= np.uint64(W._ODD)
        total += hashes[starts + j]
    return starts, W.mix(total) if n > 1 else W.windows(hashes, 1)[starts]


def _scan(batch: pa.RecordBatch, index: Index, window: int, gram: int, text: str) -> Iterator[tuple[int, int, dict]]:
    for a, b, texts in W.slices(batch.column(batch.schema.get_field_index(text))):
        found = W.split(texts, W.ALNUM, lower=True)
        hit, doc, item = match(found, index, window, gram)
        start, end, upto = spans_of(hit, found.first)
        origin = np.repeat(found.first[:-1], np.diff(upto))
        spans = pa.ListArray.from_arrays(upto.astype(np.int32), pa.StructArray.from_arrays([pa.array(start - origin, pa.int32()), pa.array(end - origin, pa.int32())], ["start", "end"]))
        names = [index.names[i] for i in item.tolist()]
        at = np.searchsorted(doc, np.arange(b - a + 1))
        lists = [sorted({x for x in names[s:e] if x is not None}) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield a, b, {"n_words": found.counts, "spans": spans, "items": pa.array(lists, pa.list_(pa.string()))}


def broadcast_scan(docs: DataFrame, items: DataFrame, names: list[str], window: int, gram: int, text: str) -> DataFrame:
    """The documents read once against a broadcast index of all items."""
    told = items.toArrow()
    texts = told["text"].combine_chunks()
    index = index_items(told["name"].to_pylist(), texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts, window, gram)
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.withColumns({n: F.lit(None).cast(t) for n, t in zip(names, KINDS, strict=True)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        tidy()
        to = to_arrow_schema(schema)
        for batch in batches:
            for a, b, new in _scan(batch, held.value, window, gram, text):
                rows = batch.slice(a, b - a)
                columns = {f.name: rows.column(i) for i, f in enumerate(rows.schema)}
                columns |= {n: new[x] if isinstance(new[x], pa.Array) else pa.array(new[x], pa.int64()) for n, x in zip(names, ("n_words", "spans", "items"), strict=True)}
                yield pa.RecordBatch.from_arrays([columns[f.name] if columns[f.name].type == f.type else columns[f.name].cast(f.type) for f in to], schema=to)

    return docs.mapInArrow(run, schema)


def item_hashes(items: DataFrame, window: int, gram: int) -> DataFrame:
    """Fingerprints (whole false) and windows (whole true) of items: whole, n, hash, name."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, texts in W.slices(batch.column("text")):
            index = index_items(batch.column("name").slice(a, b - a).to_pylist(), texts, window, gram)
            for n, prints in index.prints.items():
                yield {"whole": np.zeros(len(prints), bool), "n": np.full(len(prints), n, np.int32), "hash": prints, "name": pa.nulls(len(prints), pa.string())}
                each = np.diff(index.first[n])
                names = pa.array([index.names[i] for i in index.rows[n].tolist()], pa.string())
                yield {"whole": np.ones(len(names), bool), "n": np.full(len(names), n, np.int32), "hash": np.repeat(index.whole[n], each), "name": names}

    return arrow_map(items, run, "whole boolean, n int, hash long, name string")


def shuffled_hits(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """place, place2, spans and items of the documents (place, place2, text) that hold a window, joined by shuffles."""
    hashes = staged(item_hashes(items, window, gram), "item-hashes", ["whole"])
    prints = hashes.where("NOT whole").select("n", "hash").distinct()
    lengths = sorted(r["n"] for r in prints.select("n").distinct().collect())  # ``window`` at most

    def fingerprints(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, texts in W.slices(batch.column("text")):
            found = W.split(texts, W.ALNUM, lower=True)
            own, owner = found.hashes(), found.owner
            for n in lengths:
                k, reach = shape(n, n, gram)
                grams = W.windows(own, k)
                at = winnow(grams, reach) if reach > 1 else np.arange(len(grams))
                at = at[owner[at] == owner[at + k - 1]]
                pairs = np.unique(np.stack([owner[at].astype(np.uint64), grams[at]]), axis=1)
                where = pa.array(pairs[0].astype(np.int64))
                yield {"n": np.full(len(where), n, np.int32), "hash": pairs[1]} | {c: batch.column(c).slice(a, b - a).take(where) for c in ("place", "place2")}

    def extend(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, texts in W.slices(batch.column("text")):
            found = W.split(texts, W.ALNUM, lower=True)
            own = batch.column("prints").slice(a, b - a).flatten()
            size, value = own.field("n").to_numpy(zero_copy_only=False), own.field("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for n in lengths:
                starts, whole = windows_with(found, np.unique(value[size == n]), n, gram)
                owner = found.owner[starts]
                yield {"n": np.full(len(starts), n, np.int32), "start": starts - found.first[owner], "hash": whole} | {c: batch.column(c).slice(a, b - a).take(pa.array(owner)) for c in ("place", "place2")}

    def runs(batch: pa.RecordBatch) -> Iterator[dict]:
        spans = []
        for windows in batch.column("windows").to_pylist():
            row: list[dict] = []
            for w in sorted(windows, key=lambda w: (w["start"], w["n"])):
                if row and w["start"] <= row[-1]["end"]:
                    row[-1]["end"] = max(row[-1]["end"], w["start"] + w["n"])
                else:
                    row.append({"start": w["start"], "end": w["start"] + w["n"]})
            spans.append(row)
        yield {"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))} | {c: batch.column(c) for c in ("place", "place2", "items")}

    place = ["place", "place2"]
    met = arrow_map(docs, fingerprints, "place long, place2 long, n int, hash long").join(prints, ["n", "hash"], "left_semi")
    met = met.groupBy(place).agg(F.collect_set(F.struct("n", "hash")).alias("prints"))
    near = docs.dropDuplicates(place).join(met, place)
    windows = arrow_map(near, extend, "place long, place2 long, n int, start int, hash long")
    hits = windows.join(hashes.where("whole").select("n", "hash", "name"), ["n", "hash"]).groupBy(place).agg(F.collect_set(F.struct("start", "n")).alias("windows"), F.array_sort(F.collect_set("name")).alias("items"))
    return arrow_map(hits, runs, "place long, place2 long, spans array<struct<start:int,end:int>>, items array<string>")


def shuffled_scan(docs: DataFrame, items: DataFrame, names: list[str], window: int, gram: int, text: str) -> DataFrame:
    own = docs.columns
    place, place2 = free_name("place", docs), free_name("place2", docs)
    said = F.col(text).cast("string")
    placed = docs.withColumns({place: F.xxhash64(said), place2: F.xxhash64(said, F.lit(1))})
    hits = shuffled_hits(placed.select(F.col(place).alias("place"), F.col(place2).alias("place2"), said.alias("text")), items, window, gram)
    hits = hits.select(F.col("place").alias(place), F.col("place2").alias(place2), F.col("spans").alias(names[1]), F.col("items").alias(names[2]))
    lower = F.translate(F.coalesce(said, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.regexp_count(lower, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    rows = placed.join(hits, [place, place2], "left")
    return rows.select(*[F.col(f"`{c}`") for c in own], n_words.alias(names[0]), F.coalesce(names[1], F.array().cast(KINDS[1])).alias(names[1]), F.coalesce(names[2], F.array().cast(KINDS[2])).alias(names[2]))


KINDS = ("long", "array<struct<start:int,end:int>>", "array<string>")


def hit_names(docs: DataFrame) -> list[str]:
    """Names of the columns that ``scan`` adds: ``hit_n_words``, ``hit_spans`` and ``hit_items``, with underscores if taken."""
    return [free_name(f"hit_{x}", docs) for x in ("n_words", "spans", "items")]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES, text: str = "text") -> DataFrame:
    """All columns of ``docs``, the number of words, hit spans (word ranges) and hit items (sorted ids), named by ``hit_names``."""
    items = item_rows(benchmark)
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    way = broadcast_scan if size <= broadcast_bytes else shuffled_scan
    return way(docs, items, hit_names(docs), window, gram, text)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans and items of every document."""
    rows = scan(text_rows(docs), benchmark, **options)
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return rows.select(
        "doc_id",
        F.col("hit_n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
        F.col("hit_spans").alias("spans"),
        F.col("hit_items").alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents without any shared window, with the columns of ``docs``."""
    return scan(docs, benchmark, **options).where(F.size(hit_names(docs)[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
