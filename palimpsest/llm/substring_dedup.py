"""Exact substring deduplication with suffix automata of reference shards.

A word is removed if some window of ``window`` words over it also starts in a
document with a smaller id.  The reference of a document is all others, so it
grows with the corpus and can't be broadcast whole.  It is cut into shards by
content instead, in such a way that a window meets all its copies in one shard:

1. Of each window the least of its ``gram``-word hashes is its anchor.  Equal
   windows have equal anchors; consecutive windows mostly share one, and together
   make a run.  Anchors that two documents hold are found by exchanging packed
   hashes between groups of documents and buckets of anchors.
2. Only runs with a shared anchor are sent to the anchor's shard, each distinct
   run once per group, with the least document that holds it.  A shard adds its
   runs to suffix automata of a bounded size in ascending order of documents; before
   a run is added it is streamed through the automaton, and the matching statistics
   tell for each of its windows the first document that has it.
3. The answers go back to the groups, which remove the words of all windows whose
   first document has a smaller id.

An anchor in more than ``hot`` documents may have any number of different runs, so
its runs are sent window by window: each distinct window is a run of its own, whose
shard is that of its own hash.  It takes the same way through an automaton; no
shard has to hold what surrounds a frequent phrase, and nothing is left out.

Null texts have no words.  A null id counts as larger than all others, and as no
smaller id than any.  Rows with equal ids never remove each other's words.  Empty
tables give empty results.  Columns besides id and text are carried along, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from palimpsest.llm import words as W
from palimpsest.llm.frames import free_name, text_rows
from palimpsest.llm.groups import GROUP, GROUPS_PER_TASK, bucket_count, bucket_of, dealt, group_count, group_of, joined, packed, rows_schema, short, table, tidied, unpacked
from palimpsest.llm.staging import staged
from palimpsest.llm.suffix_automaton import SuffixAutomaton

WINDOW = 13
GRAM = 7
HOT = 4096
#: Items that one automaton holds at most, unless one anchor alone has more.
AUTOMATON_ITEMS = 50_000
LAST_ID = np.iinfo(np.int64).max

_ALONE = np.uint64(0x8CB92BA72F3D8DD7)


class Runs:
    """The runs of windows of a group's documents."""

    def __init__(self, texts: pa.ChunkedArray, ids: np.ndarray, window: int, gram: int):
        self.texts, self.ids = texts, ids
        hashes, firsts, at = [], [np.zeros(1, np.int64)], 0
        for _, _, part in W.slices(texts):
            found = W.split(part)
            hashes.append(found.hashes())
            firsts.append(found.first[1:] + at)
            at += len(hashes[-1])
        self.hashes = joined(hashes, "u8")
        self.first = np.concatenate(firsts)
        self.windows = W.windows(self.hashes, window)
        grams = W.windows(self.hashes, gram)
        n, reach = len(self.windows), window - gram + 1
        least, at_ = grams[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, reach):
            lower = grams[j : j + n] <= least
            np.copyto(least, grams[j : j + n], where=lower)
            at_[lower] = j
        valid = np.flatnonzero(W.inside(self.first, window, n)) if n > 0 else np.empty(0, np.int64)
        anchor = valid + at_[valid]
        new = np.ones(len(valid), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1] + 1)
        self.start = valid[new]
        self.size = np.diff(np.append(np.flatnonzero(new), len(valid)))
        self.anchor = W.mix(least[self.start])
        self.doc = np.searchsorted(self.first, self.start, "right") - 1

    def keys(self) -> np.ndarray:
        """A run is told by its first and its last window, which overlap."""
        last = self.windows[self.start + self.size - 1] if len(self.start) else np.empty(0, np.uint64)
        return W.mix(self.windows[self.start] ^ W.mix(last + self.size.astype(np.uint64)))

    def keep(self, some: np.ndarray, apart: np.ndarray) -> None:
        """Go on with the runs ``some``, and with the windows of the runs ``apart`` as runs of their own."""
        n = self.size[apart]
        start = np.repeat(self.start[apart] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.anchor = np.concatenate([self.anchor[some], W.mix(self.windows[start] ^ _ALONE)])
        self.doc = np.concatenate([self.doc[some], np.repeat(self.doc[apart], n)])
        self.start, self.size = np.concatenate([self.start[some], start]), np.concatenate([self.size[some], np.ones(len(start), np.int64)])


def _runs(group: pa.Table, window: int, gram: int) -> Runs:
    ids = pc.fill_null(group["id"], LAST_ID).to_numpy().astype(np.int64)
    return Runs(group["text"], ids, window, gram)


def _distinct(runs: Runs, buckets: int):
    """Distinct runs in the order in which they are sent: a row for each, where each run is among them, their least ids, buckets and keys."""
    keys = runs.keys()
    bucket = bucket_of(runs.anchor, buckets)
    order = np.lexsort((keys, bucket))
    new = np.ones(len(order), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(runs.ids[runs.doc][order], np.flatnonzero(new)) if len(order) else np.empty(0, np.int64)
    return order[new], where, least, bucket[order][new], keys[order][new]


def _cuts(bucket: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _keep_shared(runs: Runs, answers: dict[int, tuple[np.ndarray, np.ndarray]], buckets: int) -> None:
    """Go on with runs that have a shared anchor; those with a hot one come apart."""
    bucket, low = bucket_of(runs.anchor, buckets), short(runs.anchor)
    state = np.zeros(len(low), np.int8)
    order = np.argsort(bucket, kind="stable")
    cut = _cuts(bucket[order], buckets)
    for b, (some, hot) in answers.items():
        own = order[cut[b] : cut[b + 1]]
        state[own[np.isin(low[own], some)]] = 1
        state[own[np.isin(low[own], hot)]] = 2
    runs.keep(np.flatnonzero(state == 1), np.flatnonzero(state == 2))


def first_documents(parts: list[dict[str, np.ndarray]], window: int) -> list[np.ndarray]:
    """For each group's runs in a shard, the least id that has each window, run by run."""
    count = [len(p["low"]) for p in parts]
    low, size, key, doc = (joined([p[k] for p in parts], kind) for k, kind in (("low", "u4"), ("size", "u1"), ("key", "u8"), ("doc", "i8")))
    if not len(low):
        return [np.empty(0, np.int64) for _ in parts]
    size = size.astype(np.int64)
    # distinct runs over all groups, by anchor, with their least ids
    order = np.lexsort((doc, key, low))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (low[order][1:] != low[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    length = size[one]
    offset = np.concatenate([[0], np.cumsum(length)])
    answer = np.repeat(doc[one], length)
    codes = joined([p["vocab"][p["code"]] for p in parts], "u8")
    word_offset = np.concatenate([[0], np.cumsum(size + window - 1)])
    automaton, held = SuffixAutomaton(), 0
    # anchor by anchor; equal windows have equal anchors, so a full automaton can give way to a new one between them
    anchors = low[one]
    begins = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
    for members in np.split(np.arange(len(one)), begins[1:]):
        if held > AUTOMATON_ITEMS:
            automaton, held = SuffixAutomaton(), 0
        for m in members[np.argsort(doc[one[members]], kind="stable")].tolist():
            row = one[m]
            words = codes[word_offset[row] : word_offset[row + 1]].tolist()
            own = int(doc[row])
            owners = automaton.owners(words, window)
            answer[offset[m] : offset[m + 1]] = [own if x == -1 else x for x in owners]
            if -1 in owners:
                automaton.add(words, own)
                held += len(words)
    upto = np.concatenate([[0], np.cumsum(count)])
    out = []
    for i in range(len(parts)):
        mine = number[upto[i] : upto[i + 1]]
        n = length[mine]
        where = np.repeat(offset[mine] - np.cumsum(np.append(0, n[:-1])), n) + np.arange(n.sum()) if len(mine) else np.empty(0, np.int64)
        out.append(answer[where])
    return out


def _kept(runs: Runs, gone: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The kept words of each document joined by one space; words and removed words of each."""
    texts, removed, at = [], [], 0
    for _, _, part in W.slices(runs.texts):
        found = W.split(part)
        n = len(found.start)
        keep = ~gone[at : at + n]
        own = found.owner[keep]
        start, size = found.start[keep], (found.end - found.start)[keep] + 1
        ends = np.cumsum(size)
        where = np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        letters = np.append(found.data, 32)[np.minimum(where, len(found.data))]
        letters[ends - 1] = 32
        counts = np.bincount(own, minlength=len(part))
        last = np.concatenate([[0], np.cumsum(np.bincount(own, size, len(part)).astype(np.int64))])
        # a space after every word; the last one of a document goes
        drop = np.zeros(len(letters), bool)
        drop[last[1:][counts > 0] - 1] = True
        letters = letters[~drop]
        offsets = last - np.concatenate([[0], np.cumsum(counts > 0)])
        texts.append(pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(letters.astype(np.uint8).tobytes())))
        removed.append(found.counts - counts)
        at += n
    return pa.chunked_array(texts, pa.large_string()), np.diff(runs.first), joined(removed, "i8")


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` with three more: the kept text, the number of words and that of removed words."""
    groups = group_count(docs)
    buckets = bucket_count(groups)
    own = docs.columns
    ids, texts = F.col(key).cast("long"), F.col(text).cast("string")
    # the columns of docs travel in a struct, so no name of theirs can clash
    grouped = dealt(docs.select(group_of(ids, texts, groups=groups).alias(GROUP), ids.alias("id"), texts.alias("text"), F.struct(*[F.col(f"`{c}`") for c in own if c != text]).alias("rest")), GROUP, groups, GROUPS_PER_TASK)
    slim = dealt(docs.select(group_of(ids, texts, groups=groups).alias(GROUP), ids.alias("id"), texts.alias("text")), GROUP, groups, GROUPS_PER_TASK)

    # 1. which anchors do two documents hold
    sent, sent_arrow = rows_schema("bucket int, grp int, one binary, more binary, count binary")

    @tidied
    def anchors(group: pa.Table) -> pa.Table:
        runs = _runs(group, window, gram)
        pairs = np.unique(np.stack([runs.anchor, runs.ids[runs.doc].view(np.uint64)]), axis=1)[0] if len(runs.anchor) else np.empty(0, np.uint64)
        anchor, count = np.unique(pairs, return_counts=True)
        cut = _cuts(bucket_of(anchor, buckets), buckets)
        low, several = short(anchor), count > 1
        parts = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        full = [b for b, p in enumerate(parts) if p.stop > p.start]
        return table(
            {
                "bucket": full,
                "grp": [group[GROUP][0].as_py()] * len(full),
                "one": [packed(low[parts[b]][~several[parts[b]]]) for b in full],
                "more": [packed(low[parts[b]][several[parts[b]]]) for b in full],
                "count": [packed(np.minimum(count[parts[b]][several[parts[b]]], 1 << 30).astype(np.uint32)) for b in full],
            },
            sent_arrow,
        )

    told, told_arrow = rows_schema(f"{GROUP} int, bucket int, kind int, one binary, two binary")

    @tidied
    def meet(part: pa.Table) -> pa.Table:
        one, more, count = unpacked(part["one"], "u4"), unpacked(part["more"], "u4"), unpacked(part["count"], "u4")
        every = joined([*one, *more], "u4")
        weight = np.concatenate([np.ones(sum(map(len, one)), np.int64), *(c.astype(np.int64) for c in count)])
        low, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, weight, len(low)).astype(np.int64) if len(low) else np.empty(0, np.int64)
        some, many = low[(total > 1) & (total <= hot)], low[total > hot]
        own = [np.concatenate([a, b]) for a, b in zip(one, more, strict=True)]
        return table({GROUP: part["grp"], "bucket": part["bucket"], "kind": [0] * len(part), "one": [packed(x[np.isin(x, some)]) for x in own], "two": [packed(x[np.isin(x, many)]) for x in own]}, told_arrow)

    shared = staged(dealt(slim.groupBy(GROUP).applyInArrow(anchors, sent), "bucket", buckets).groupBy("bucket").applyInArrow(meet, told), "shared-anchors")

    # 2. runs with shared anchors meet in shards
    fragments, fragments_arrow = rows_schema("bucket int, grp int, low binary, size binary, key binary, doc binary, vocab binary, code binary")

    def answers_of(rows: pa.Table, kind: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        rows = rows.filter(pc.equal(rows["kind"], kind))
        return dict(zip(rows["bucket"].to_pylist(), zip(unpacked(rows["one"], "i8" if kind else "u4"), unpacked(rows["two"], "u4"), strict=True), strict=True))

    @tidied
    def send(group: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(group):
            return fragments_arrow.empty_table()
        runs = _runs(group, window, gram)
        _keep_shared(runs, answers_of(rows, 0), buckets)
        one, _, least, bucket, keys = _distinct(runs, buckets)
        cut = _cuts(bucket, buckets)
        out: dict[str, list] = {f.name: [] for f in fragments_arrow}
        for b in range(buckets):
            mine = slice(cut[b], cut[b + 1])
            if mine.start == mine.stop:
                continue
            own = one[mine]
            span = runs.size[own] + window - 1
            where = np.repeat(runs.start[own] - np.cumsum(np.append(0, span[:-1])), span) + np.arange(span.sum())
            vocab, code = np.unique(runs.hashes[where], return_inverse=True)
            wide = len(vocab) > 1 << 16
            for name, value in (
                ("bucket", b),
                ("grp", group[GROUP][0].as_py()),
                ("low", packed(short(runs.anchor[own]))),
                ("size", packed(runs.size[own].astype(np.uint32))),
                ("key", packed(keys[mine])),
                ("doc", packed(least[mine])),
                ("vocab", packed(vocab)),
                ("code", packed(code.astype(np.uint32 if wide else np.uint16))),
            ):
                out[name].append(value)
        return table(out, fragments_arrow)

    @tidied
    def shard(part: pa.Table) -> pa.Table:
        vocab = unpacked(part["vocab"], "u8")
        code = [np.frombuffer(x, np.uint32 if len(v) > 1 << 16 else np.uint16) for x, v in zip(part["code"].to_pylist(), vocab, strict=True)]
        columns = {n: unpacked(part[n], kind) for n, kind in (("low", "u4"), ("size", "u4"), ("key", "u8"), ("doc", "i8"))}
        parts = [{"vocab": vocab[i], "code": code[i], **{n: c[i] for n, c in columns.items()}} for i in range(len(part))]
        found = first_documents(parts, window)
        return table({GROUP: part["grp"], "bucket": part["bucket"], "kind": [1] * len(part), "one": [packed(x) for x in found], "two": [b""] * len(part)}, told_arrow)

    met = slim.groupBy(GROUP).cogroup(dealt(shared, GROUP, groups, GROUPS_PER_TASK).groupBy(GROUP)).applyInArrow(send, fragments)
    firsts = staged(dealt(met, "bucket", buckets).groupBy("bucket").applyInArrow(shard, told), "first-documents")

    # 3. back to the documents
    new = ("text", "kept", "n_words", "n_removed")
    schema = StructType([grouped.schema["rest"], StructField("text", StringType()), StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    arrow = _arrow_schema(schema)

    @tidied
    def remove(group: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(group):
            return arrow.empty_table()
        runs = _runs(group, window, gram)
        _keep_shared(runs, answers_of(rows, 0), buckets)
        one, where, _, bucket, _ = _distinct(runs, buckets)
        told = answers_of(rows, 1)
        gone = np.zeros(len(runs.hashes) + 1, np.int64)
        if len(one):
            answer = np.concatenate([told[b][0] for b in np.unique(bucket).tolist()])
            offset = np.concatenate([[0], np.cumsum(runs.size[one])])
            n = runs.size
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first = answer[np.repeat(offset[where], n) + step]
            hit = (np.repeat(runs.start, n) + step)[first < runs.ids[np.repeat(runs.doc, n)]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + window, -1)
        kept, words, removed = _kept(runs, np.cumsum(gone[:-1]) > 0)
        return table({"rest": group["rest"], **dict(zip(new, (group["text"], kept, words, removed), strict=True))}, arrow)

    done = grouped.groupBy(GROUP).cogroup(dealt(shared.unionByName(firsts), GROUP, groups, GROUPS_PER_TASK).groupBy(GROUP)).applyInArrow(remove, schema)
    return done.select(*[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in own], *[F.col(a).alias(b) for a, b in zip(new[1:], added(docs), strict=True)])


def added(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the three columns that ``deduplicated`` adds, with underscores if ``docs`` has such columns."""
    return tuple(free_name(n, docs) for n in ("kept_text", "dedup_n_words", "dedup_n_removed"))


def _arrow_schema(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def cleaned(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated words taken out of ``text``; untouched texts stay as they are.

    ``n_chars``, where there is such a column, follows the text.
    """
    kept, _, removed = added(docs)
    rows = deduplicated(docs, **options)
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    changed = {"text": F.when(F.col(removed) > 0, F.col(kept)).otherwise(F.col("text")).cast(kinds["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(removed) > 0, F.length(kept).cast(kinds["n_chars"])).otherwise(F.col("n_chars"))
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def removals(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    rows = deduplicated(text_rows(docs), **options)
    return rows.select("doc_id", F.col("dedup_n_words").alias("n_words"), F.col("dedup_n_removed").alias("n_removed"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))
