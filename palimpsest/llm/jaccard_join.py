"""Exact Jaccard join of documents as sets of word n-grams, by pivots and Voronoi regions.

Documents link when their sets have a Jaccard similarity of ``percent`` or more.
The Jaccard distance is a metric, so distances to pivots bound all others; but
documents that share nothing are all at distance one of each other, where the
triangle inequality says nothing.  The space is therefore first cut by what the
documents hold, and pivots divide these first regions further:

1. Equal sets become one (a digest of the set); only one row of it goes on.
2. N-grams have a global order: rare before frequent, long before short.  Two
   linked sets share an n-gram among the first ``n - ceil(t n) + 1`` of each, and
   several among a few more.  Sets whose first n-grams are hardly shared by any
   other set can't link and leave.  What is left is small.
3. Each shared n-gram among the first of a set is a first region; a set is put into
   all regions of its own, so linked sets meet in one at least.  The first member of
   a region is its first pivot: members within the radius are linked to it and
   thereby to one another.  Regions whose members are all connected are done, and of
   regions with the same members one goes on.
4. Of a region only the members outside its largest connected part have to be compared
   with the others.  Pivots out of these are compared with all others, again and again,
   while that connects them.  If what is left is at most ``leaf`` pairs the region is
   joined: pairs that are not connected, whose sizes allow a link and whose parities of n-grams in a fixed
   number of cells differ in no more places than linked sets could (each n-gram that
   only one set has flips one place) are measured.
5. A larger region takes ``pivots`` pivots.  Distances of all members to them are
   measured.  A member's cell is that of its nearest pivot, and it is replicated to
   every cell whose pivot is no more than two radii farther (the triangle inequality:
   a member within the radius of it may have its home there).  Cells are the regions
   of the next round.
6. Where the pivots do not divide a region, since all its members are about as far
   from one another, its members outside the largest part take turns, each of which
   makes at most ``leaf`` comparisons.  So no task is ever given more than that.

Nothing is sampled or capped: the order of n-grams uses counted frequencies, but
any order gives the same links, and rounds go on until no region is open.

Each row is a document of its own, whatever rows share its id: it has the component
of its own text, the least id that any row of linked sets has.  A null id is never
the least; a component of null ids only is null.  Null and empty texts have an empty
set, link with nothing and are their own component.  Repeated rows repeat.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.components import components
from palimpsest.llm.frames import arrow_map, free_name, text_rows
from palimpsest.llm.groups import GROUP, GROUPS_PER_TASK, bucket_count, bucket_of, dealt, group_count, group_of, joined, packed, rows_schema, short, table, tidied, unpacked
from palimpsest.llm.staging import discard, staged

SIZE = 4
PERCENT = 85
#: Frequent n-grams that the order knows of: the bound of what is broadcast.
FREQUENT = 1 << 16
#: Pairs that a region may compare to be joined; those that would compare more are divided.
LEAF = 1 << 22
#: Pivots of a region that is divided.
PIVOTS = 8
#: A division that leaves a cell with more than this share of its region is none.
DIVIDED = 0.75
#: Pairs of sets that a worker holds at once.
SETS_AT_ONCE = 1024
#: Regions that a member knows as its first.
FIRST_REGIONS = 16
#: 64-bit words of the parities that a set is told apart by.
PARITY_WORDS = 16

_OTHER = np.uint64(0xA0761D6478BD642F)


class Sets:
    """The distinct n-grams of some texts, each text's in ascending order of hash."""

    def __init__(self, found: W.Words, size: int):
        hashes, counts, first = found.hashes(), found.counts, found.first
        grams = W.windows(hashes, size)
        at = np.flatnonzero(W.inside(first, size, len(grams))) if len(grams) else np.empty(0, np.int64)
        letters = np.concatenate([[0], np.cumsum(found.end - found.start)])
        owner, value, long = [found.owner[at]], [grams[at]], [letters[at + size] - letters[at]]
        for m in range(1, size):  # texts with fewer words are one n-gram
            few = np.flatnonzero(counts == m)
            if len(few):
                owner.append(few)
                value.append(W.mix(W.windows(hashes, m)[first[few]] + np.uint64(m)))
                long.append(letters[first[few] + m] - letters[first[few]])
        owner, value, long = np.concatenate(owner), np.concatenate(value), np.concatenate(long)
        order = np.lexsort((value, owner))
        owner, value = owner[order], value[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
        self.owner, self.value, self.long = owner[new], value[new], long[order][new]
        self.n = np.bincount(self.owner, minlength=len(counts))
        self.first = np.concatenate([[0], np.cumsum(self.n)])

    def digest(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each set."""
        out = []
        for salt in (np.uint64(0), _OTHER):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(self.value ^ salt))])
            out.append(W.mix(total[self.first[1:]] - total[self.first[:-1]] + self.n.astype(np.uint64)))
        return out[0], out[1]

    def parities(self, i: int) -> list[int]:
        """Whether an odd number of n-grams falls into each cell, 64 cells a word."""
        cell = (W.mix(self.value[self.first[i] : self.first[i + 1]]) % np.uint64(64 * PARITY_WORDS)).astype(np.int64)
        return np.packbits((np.bincount(cell, minlength=64 * PARITY_WORDS) & 1).astype(np.uint8)).view(np.int64).tolist()

    def ranked(self, frequent: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """N-grams of each set from rare to frequent, and their places in it."""
        late = np.zeros(len(self.value), np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, self.value), len(frequent) - 1)
            late = np.where(frequent[at] == self.value, rank[at] + 1, 0)
        order = np.lexsort((self.value, -np.minimum(self.long, 255), late, self.owner))
        return self.value[order], np.arange(len(order)) - np.repeat(self.first[:-1], self.n)


def prefix(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of the first n-grams linked sets share one of."""
    return n - -(-percent * n // 100) + 1


def asked(n: np.ndarray) -> np.ndarray:
    """How many of the first prefix + asked - 1 n-grams linked sets share."""
    return np.maximum(1, -(-n // 20))


def offered(n: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams a set offers: enough for what any set it may link with asks."""
    most = -(-100 * n // percent)  # the largest partner
    return np.minimum(n, prefix(n, percent) - 1 + np.maximum(1, -(-most // 20)))


def _size_allows(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def placed_column(which: int) -> Column:
    key, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(key, text) if which == 1 else F.xxhash64(text, F.lit(1), key)


def placed(docs: DataFrame) -> DataFrame:
    """Id and text with two hashes of both: rows with the same ``place`` and ``place2`` are repeated rows."""
    return text_rows(docs).withColumns({"place": placed_column(1), "place2": placed_column(2)})


def set_rows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """kind 0: doc_id, places, n, k1, k2 of each document; kind 1: n-gram k1 found in n documents of a slice."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, texts in W.slices(batch.column("text")):
            sets = Sets(W.split(texts, lower=True), size)
            k1, k2 = sets.digest()
            own = {c: batch.column(c).slice(a, b - a) for c in ("doc_id", "place", "place2")}
            yield own | {"kind": np.zeros(b - a, np.int32), "n": sets.n, "k1": k1.view(np.int64), "k2": k2.view(np.int64)}
            value, count = np.unique(sets.value, return_counts=True)
            often = count >= 3
            k = int(often.sum())
            yield {"kind": np.ones(k, np.int32), **{c: pa.nulls(k, pa.int64()) for c in own}, "n": count[often], "k1": value[often].view(np.int64), "k2": np.zeros(k, np.int64)}

    return arrow_map(docs, run, "kind int, doc_id long, place long, place2 long, n long, k1 long, k2 long")


def candidates(docs: DataFrame, firsts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], groups: int, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Sets that may link with another: node, n, lack (first n-grams that no other set offers), parities, grams (packed, ascending) and regions (hashes)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(frequent)
    buckets = bucket_count(groups)
    group = group_of(F.col("place"), groups=groups).alias(GROUP)
    grouped = dealt(docs.select(group, "place", "text"), GROUP, groups, GROUPS_PER_TASK)
    wanted = firsts.select(group, "place", "k1", "node")

    def members(group: pa.Table, chosen: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, Sets]]:
        """Nodes of the group's chosen sets, which texts they are, and all sets, slice by slice."""
        nodes = {(p, k): n for p, k, n in zip(chosen["place"].to_pylist(), chosen["k1"].to_pylist(), chosen["node"].to_pylist(), strict=True)}
        rows = group.filter(pc.is_in(group["place"], pa.array(chosen["place"].to_pylist(), pa.int64())))
        places = rows["place"].to_pylist()
        for a, _, texts in W.slices(rows["text"]):
            sets = Sets(W.split(texts, lower=True), size)
            # a set is taken from the first row that has it
            found = [nodes.pop((places[a + i], k), -1) for i, k in enumerate(sets.digest()[0].view(np.int64).tolist())]
            node = np.array(found, np.int64)
            yield node, (node >= 0) & (sets.n > 0), sets

    sent, sent_arrow = rows_schema("bucket int, grp int, one binary, more binary")

    @tidied
    def offer(group: pa.Table, chosen: pa.Table) -> pa.Table:
        every = []
        for _, use, sets in members(group, chosen):
            value, place = sets.ranked(*held.value)
            every.append(value[use[sets.owner] & (place < offered(sets.n, percent)[sets.owner])])
        value, count = np.unique(joined(every, "u8"), return_counts=True)
        cut = np.searchsorted(bucket_of(value, buckets), np.arange(buckets + 1))
        full = [b for b in range(buckets) if cut[b + 1] > cut[b]]
        low, several = short(value), count > 1
        return table({"bucket": full, "grp": [group[GROUP][0].as_py()] * len(full), "one": [packed(low[cut[b] : cut[b + 1]][~several[cut[b] : cut[b + 1]]]) for b in full], "more": [packed(low[cut[b] : cut[b + 1]][several[cut[b] : cut[b + 1]]]) for b in full]}, sent_arrow)

    told, told_arrow = rows_schema(f"{GROUP} int, bucket int, shared binary")

    @tidied
    def meet(part: pa.Table) -> pa.Table:
        one, more = unpacked(part["one"], "u4"), unpacked(part["more"], "u4")
        low, count = np.unique(joined([*one, *more, *more], "u4"), return_counts=True)
        shared = low[count > 1]
        return table({GROUP: part["grp"], "bucket": part["bucket"], "shared": [packed(np.concatenate([x[np.isin(x, shared)], y])) for x, y in zip(one, more, strict=True)]}, told_arrow)

    met = grouped.groupBy(GROUP).cogroup(dealt(wanted, GROUP, groups, GROUPS_PER_TASK).groupBy(GROUP)).applyInArrow(offer, sent)
    shared = staged(dealt(met, "bucket", buckets).groupBy("bucket").applyInArrow(meet, told), "shared-grams")

    # chosen documents and shared n-grams of a group in one table
    none = F.lit(None)
    both = wanted.withColumns({"bucket": none.cast("int"), "shared": none.cast("binary")}).unionByName(shared.withColumns({c: none.cast("long") for c in ("place", "k1", "node")}))
    found, found_arrow = rows_schema("node long, n long, lack int, parities array<bigint>, grams binary, regions array<bigint>")

    @tidied
    def choose(group: pa.Table, rows: pa.Table) -> pa.Table:
        chosen, answers = rows.filter(pc.is_valid(rows["node"])), rows.filter(pc.is_valid(rows["bucket"]))
        lows = dict(zip(answers["bucket"].to_pylist(), unpacked(answers["shared"], "u4"), strict=True))
        # the bucket and the low bits as one number
        known = np.sort(joined([(np.uint64(b) << np.uint64(32)) | x.astype(np.uint64) for b, x in lows.items()], "u8"))
        out: dict[str, list] = {f.name: [] for f in found_arrow}
        for nodes, use, sets in members(group, chosen):
            value, place = sets.ranked(*held.value)
            mine = (bucket_of(value, buckets).astype(np.uint64) << np.uint64(32)) | short(value).astype(np.uint64)
            at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
            common = known[at] == mine if len(known) else np.zeros(len(mine), bool)
            base = prefix(sets.n, percent)
            tested = common & (place < (base + asked(sets.n) - 1)[sets.owner])
            use &= np.bincount(sets.owner, tested, len(use)) >= asked(sets.n)
            region = common & (place < base[sets.owner])
            for i in np.flatnonzero(use).tolist():
                a, b = sets.first[i], sets.first[i + 1]
                out["node"].append(int(nodes[i]))
                out["n"].append(int(sets.n[i]))
                out["grams"].append(packed(sets.value[a:b]))
                out["lack"].append(int(base[i] - region[a:b].sum()))
                out["parities"].append(sets.parities(i))
                out["regions"].append(value[a:b][region[a:b]].view(np.int64))
        return table(out, found_arrow)

    met = grouped.groupBy(GROUP).cogroup(dealt(both, GROUP, groups, GROUPS_PER_TASK).groupBy(GROUP)).applyInArrow(choose, found)
    met = staged(met, "candidates")
    discard(shared)
    return met


def measured(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs with their intersection, exactly: a, b, na, nb, common, linked."""
    one = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        a, b = unpacked(batch.column("ga"), "u8"), unpacked(batch.column("gb"), "u8")
        common = np.empty(len(a), np.int64)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if len(x) > len(y):
                x, y = y, x
            common[i] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        na, nb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        yield {"a": batch.column("a"), "b": batch.column("b"), "na": na, "nb": nb, "common": common, "linked": 100 * common >= percent * (na + nb - common)}

    return arrow_map(pairs.join(one, "a").join(two, "b").select("a", "b", "ga", "gb"), run, "a long, b long, na long, nb long, common long, linked boolean")


def _pairs(pairs: DataFrame, known: DataFrame | None) -> DataFrame:
    """Pairs of two nodes, each once, without those that are measured."""
    pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).where("a <> b").distinct()
    return pairs if known is None else pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _open(members: DataFrame) -> DataFrame:
    """Members of regions that are not all connected, and of regions with the same members only one.

    ``minor`` members are not of the largest connected part; only they have to be compared
    with all others, in ``work`` pairs.
    """
    low, high = (F.sum(F.xxhash64("node", F.lit(i)).cast("decimal(38,0)")) for i in (1, 2))
    parts = members.groupBy("region", "root").agg(F.count("*").alias("part"), low.alias("low"), high.alias("high"))
    size = F.sum("part").alias("size")
    regions = parts.groupBy("region").agg(size, F.max(F.struct("part", "root")).alias("main"), F.count("*").alias("parts"), F.sum("low").alias("low"), F.sum("high").alias("high")).where("parts > 1")
    regions = regions.groupBy("size", "low", "high").agg(F.min(F.struct("region", "main")).alias("one"))
    regions = regions.select("one.region", "size", F.col("one.main.root").alias("main"), ((F.col("size") - F.col("one.main.part")) * F.col("size")).alias("work"))
    return members.join(regions, "region").withColumn("minor", F.col("root") != F.col("main")).drop("main")


def leaf_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs p, q of a minor member and any other that may link and are not connected, region by region.

    Sets that share many n-grams meet in many regions (``base``).  Each member knows the
    first of its own; a pair is told in the first that both know, in all if there is none.
    """
    cells = [f"c{i}" for i in range(PARITY_WORDS)]
    own = members.select("node", "base").distinct().groupBy("node").agg(F.slice(F.array_sort(F.collect_list("base")), 1, FIRST_REGIONS).alias("known"))
    rows = members.join(sets.select("node", *[F.get("parities", F.lit(i)).alias(c) for i, c in enumerate(cells)]), "node").join(own, "node")
    rows = staged(rows.select("region", "base", "node", "n", "root", "minor", "known", *cells), "leaves")
    one, two = (x.select("region", *[F.col(c).alias(f"{c}{i}") for c in ("base", "node", "n", "root", "known", *cells)]) for i, x in (("1", rows.where("minor")), ("2", rows)))
    flips = sum((F.bit_count(F.col(f"{c}1").bitwiseXOR(F.col(f"{c}2"))) for c in cells), F.lit(0))
    alike = (100 + percent) * flips <= (100 - percent) * (F.col("n1") + F.col("n2"))
    common = F.get(F.array_intersect("known1", "known2"), F.lit(0))
    met = (one["region"] == two["region"]) & (F.col("root1") != F.col("root2")) & _size_allows(F.col("n1"), F.col("n2"), percent) & alike & (F.coalesce(common, F.col("base1")) == F.col("base1"))
    return one.join(two, met).select(F.col("node1").alias("p"), F.col("node2").alias("q"))


def pivots_of(members: DataFrame, pivots: int, turn: int) -> DataFrame:
    """region and pivot: about twice ``pivots`` of the members (of ``count``) of each region, one at least.

    They are chosen by a hash of the member, so regions that are much alike have the
    same pivots and share their distances.
    """
    place = F.xxhash64("node", F.lit(turn))
    share = F.least(F.lit(1.0), 2.0 * pivots / F.col("count"))
    some = members.where(F.pmod(place, F.lit(1 << 30)) <= share * (1 << 30))
    # should the hash spare a region, its least member serves
    least = members.groupBy("region").agg(F.min(F.struct(place.alias("place"), "node"))["node"].alias("pivot"))
    return some.select("region", F.col("node").alias("pivot")).unionByName(least).distinct()


def voronoi(members: DataFrame, pivots: DataFrame, known: DataFrame, radius: float) -> DataFrame:
    """Members of the cells of each region: region (the cell), parent, node, n.

    ``known`` holds the distance of each member to each pivot of its region.
    """
    d = 1.0 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    far = known.select("a", "b", d.alias("d"))
    far = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).select(F.col("a").alias("node"), F.col("b").alias("pivot"), "d")
    rows = members.select("region", "node", "n").join(pivots, "region")
    rows = rows.join(far, ["node", "pivot"], "left").withColumn("d", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("d")))
    home = rows.groupBy("region", "node").agg(F.min("d").alias("home"))
    rows = rows.join(home, ["region", "node"]).where(F.col("d") <= F.col("home") + 2 * radius)
    return rows.select(F.xxhash64("region", "pivot").alias("region"), F.col("region").alias("parent"), "node", "n")


def _starred(members: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Open regions, and what is known once pivots out of their minor members have been compared with all others.

    Each round connects what is near its pivots, so dense parts of a region cost a few
    comparisons for each member, not one for each pair.  Rounds go on as long as they
    connect a sixteenth of the minor members or more.
    """
    before = None
    for turn in itertools.count(1):
        roots = staged(components(known.where("linked")), "roots")
        here = staged(_open(_rooted(members, roots)), "open-regions")
        left = here.where("minor").count()
        if not left or (before is not None and 16 * left > 15 * before):
            return here, known
        before = left
        chosen = pivots_of(here.where("minor").withColumn("count", F.col("work") / F.col("size")), 1, turn)
        chosen = chosen.withColumnRenamed("pivot", "node").join(here.select("region", "node", "n", "root"), ["region", "node"]).select("region", F.col("node").alias("p"), F.col("n").alias("n_p"), F.col("root").alias("root_p"))
        spokes = here.join(staged(chosen, "pivots"), "region").where((F.col("root") != F.col("root_p")) & _size_allows(F.col("n"), F.col("n_p"), percent)).select("p", F.col("node").alias("q"))
        known = known.unionByName(staged(measured(_pairs(spokes, known), sets, percent), "measured", batch_rows=SETS_AT_ONCE))


def in_turns(members: DataFrame, leaf: int) -> DataFrame:
    """Regions cut by their minor members, so that each compares its share of them with all members in about ``leaf`` pairs."""
    count = F.ceil(F.col("work") / leaf).cast("int")
    rows = members.withColumn("turn", F.explode(F.sequence(F.lit(0), count - 1)))
    mine = F.pmod(F.xxhash64("node", "region"), count) == F.col("turn")
    return rows.select(F.xxhash64("region", "turn").alias("region"), F.col("region").alias("base"), "node", "n", "root", (F.col("minor") & mine).alias("minor"))


def joined_links(sets: DataFrame, percent: int = PERCENT, leaf: int = LEAF, pivots: int = PIVOTS) -> DataFrame:
    """a, b: links that connect all linked sets of the candidates, found region by region."""
    radius = (100 - percent) / 100 + 1e-9
    members = staged(sets.select(F.explode("regions").alias("region"), "node", "n", "lack"), "regions")
    # the member with the fewest n-grams of its own is most likely in the middle of the others
    first = F.min(F.struct("lack", F.xxhash64("node").alias("place"), "node", "n")).alias("first")
    starred = members.join(members.groupBy("region").agg(first), "region").where(_size_allows(F.col("n"), F.col("first")["n"], percent))
    known = staged(measured(_pairs(starred.select(F.col("first")["node"].alias("p"), F.col("node").alias("q")), None), sets, percent), "measured", batch_rows=SETS_AT_ONCE)
    members, turn = members.drop("lack"), 0  # turns of Voronoi pivots
    while True:
        here, known = _starred(members, sets, known, percent)
        fits, large = here.where(F.col("work") <= leaf), here.where(F.col("work") > leaf)
        fits = fits.select("region", F.col("region").alias("base"), "node", "n", "root", "minor")
        divided = large.limit(1).count() > 0
        if divided:
            chosen = staged(pivots_of(large.withColumn("count", F.col("size")), pivots, turn), "pivots")
            spokes = large.join(chosen, "region").select(F.col("pivot").alias("p"), F.col("node").alias("q"))
            known = known.unionByName(staged(measured(_pairs(spokes, known), sets, percent), "measured", batch_rows=SETS_AT_ONCE))
            cells = staged(voronoi(large, chosen, known, radius), "cells")
            # regions with a cell almost as large as themselves are not divided but joined in turns
            whole = large.groupBy("region").agg(F.first("size").alias("size")).withColumnRenamed("region", "parent")
            stuck = staged(cells.groupBy("parent", "region").count().join(whole, "parent").where(F.col("count") > DIVIDED * F.col("size")).select("parent").distinct(), "undivided")
            members = staged(cells.join(stuck, "parent", "left_anti").select("region", "node", "n"), "regions")
            stuck = large.join(stuck.withColumnRenamed("parent", "region"), "region", "left_semi")
            # the pivots have connected some of their members by now
            stuck = _open(_rooted(stuck.select("region", "node", "n"), components(known.where("linked"))))
            fits = fits.unionByName(in_turns(stuck, leaf))
        pairs = _pairs(leaf_pairs(fits, sets, percent), known)
        known = known.unionByName(staged(measured(pairs, sets, percent), "measured", batch_rows=SETS_AT_ONCE))
        if not divided:
            return known.where("linked").select("a", "b")
        turn += 1


def classes(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, **options) -> tuple[DataFrame, DataFrame]:
    """(sets of all documents, component and first row of each distinct set)."""
    docs = placed(docs)
    groups = group_count(docs)
    rows = staged(set_rows(docs, size), "sets", ["kind"])
    sets = rows.where("kind = 0")
    often = rows.where("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k1").limit(FREQUENT).toArrow()
    value, rank = often["k1"].to_numpy().astype(np.int64).view(np.uint64), np.argsort(np.argsort(often["n"].to_numpy(), kind="stable"), kind="stable")
    order = np.argsort(value)
    # of each distinct set the row with the least id, null last
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "place2")
    firsts = sets.where("n > 0").groupBy("k1", "k2").agg(F.min(row).alias("row"), F.first("n").alias("n"))
    firsts = staged(firsts.select("k1", "k2", "n", "row.doc_id", "row.place", "row.place2", F.monotonically_increasing_id().alias("node")), "distinct-sets")
    found = candidates(docs, firsts, (value[order], rank[order]), groups, size, percent)
    roots = components(joined_links(found, percent, **options))
    rooted = firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    named = rooted.join(rooted.groupBy("root").agg(first.alias("first")), "root")
    return sets, staged(named.select("k1", "k2", "place", "place2", F.col("first.doc_id").alias("component_id"), (F.col("first.node") == F.col("node")).alias("is_first")), "classes")


def near_duplicates(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets, named = classes(docs, size, percent, **options)
    return sets.join(named.select("k1", "k2", "component_id"), ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def representatives(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, **options) -> DataFrame:
    """One row of each component, that of its least id, and all rows without words.

    The choice is by row: rows that share an id stay or go by their own texts.  Of
    repeated rows one stays, whichever where other columns differ.
    """
    _, named = classes(docs, size, percent, **options)
    places = [free_name(c, docs) for c in ("place", "place2")]
    rows = docs.withColumns(dict(zip(places, (placed_column(c) for c in (1, 2)), strict=True)))
    chosen = named.where("is_first").select(F.col("place").alias(places[0]), F.col("place2").alias(places[1]))
    number = free_name("number", rows)
    worded = F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    stay = rows.where(worded).join(chosen, places, "left_semi").withColumn(number, F.row_number().over(Window.partitionBy(*places).orderBy(places[0]))).where(F.col(number) == 1)
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(docs.where(~worded))
