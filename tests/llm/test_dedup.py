"""Substring dedup, the Jaccard join and decontamination against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import decontamination as D
from palimpsest.llm import jaccard_join as J
from palimpsest.llm import substring_dedup as S
from palimpsest.llm.suffix_automaton import SuffixAutomaton
from tests.llm.conftest import sha, words

DDL = "doc_id long, text string"


def test_automaton_finds_first_owners():
    r = random.Random(1)
    texts = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(40)]
    automaton = SuffixAutomaton()
    for owner, t in enumerate(texts):
        want = [next((k for k in range(owner) if any(texts[k][j : j + 4] == t[i : i + 4] for j in range(len(texts[k]) - 3))), -1) for i in range(len(t) - 3)]
        assert automaton.owners(t, 4) == want
        automaton.add(t, owner)


def brute_removals(rows, window):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, S.LAST_ID), S.LAST_ID if d is None else d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (S.LAST_ID if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot,window,gram", [(4096, 13, 7), (3, 13, 7), (1, 5, 2), (4096, 300, 7)])
def test_substring_dedup(spark, corpus, hot, window, gram):
    long = " ".join(f"v{i}" for i in range(900))
    rows = [*corpus, (7, long), (7, long), (7, corpus[0][1]), (8, "x " + long), (9, long[:2000])]
    got = S.removals(spark.createDataFrame(rows, DDL), hot=hot, window=window, gram=gram).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_removals(rows, window)


def test_hot_anchors_go_through_automata(spark, corpus, monkeypatch):
    """Windows of a hot anchor are runs of one window, and shards answer them by their automata."""
    runs = S._runs(pa.table({"id": [1, 2], "text": ["a b c d e f g h", "x b c d e y"]}), 4, 2)
    n = int(runs.size.sum())
    runs.keep(np.empty(0, np.int64), np.arange(len(runs.start)))
    assert len(runs.start) == n and (runs.size == 1).all()
    one, where, least, bucket, keys = S._distinct(runs, 1)
    parts = [{"low": S.short(runs.anchor[one]), "size": runs.size[one].astype("u4"), "key": keys, "doc": least, "vocab": runs.hashes, "code": (runs.start[one][:, None] + np.arange(4)).ravel()}]
    asked = []
    monkeypatch.setattr(S.SuffixAutomaton, "owners", lambda self, words, size, owners=S.SuffixAutomaton.owners: asked.append(len(words)) or owners(self, words, size))
    first = S.first_documents(parts, 4)[0]
    assert len(asked) == len(one) and set(asked) == {4} and (first == least).all()


def test_dedup_of_nothing_and_extra_columns(spark):
    assert S.removals(spark.createDataFrame([], DDL)).collect() == []
    df = spark.createDataFrame([(1, "a b", "k", 3), (2, None, "n", 0)], "doc_id long, text string, n_words string, n_chars int")
    assert sorted(S.cleaned(df).collect()) == sorted(df.collect())
    clash = df.selectExpr("*", "1 AS kept_text", "2 AS dedup_n_words", "3 AS __group__", "4 AS rest", "5 AS id")
    assert sorted(S.cleaned(clash).collect()) == sorted(clash.collect()) and S.cleaned(clash).columns == clash.columns
    assert S.deduplicated(clash).columns[-3:] == ["kept_text_", "dedup_n_words_", "dedup_n_removed"]


def test_cleaned_takes_out_later_words_only(spark):
    p = " ".join(f"p{i}" for i in range(20))
    df = spark.createDataFrame([(5, f"x\n{p} y", 9), (3, f"z {p}", 9)], "doc_id long, text string, n_chars int")
    rows = {r["doc_id"]: r for r in S.cleaned(df).collect()}
    assert rows[3]["text"] == f"z {p}" and rows[3]["n_chars"] == 9 and rows[5]["text"] == "x y" and rows[5]["n_chars"] == 3


def brute_sets(rows, size):
    for d, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        yield d, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_roots(sets, percent):
    """The component of each row as the number of its first row."""
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return [find(i) for i in range(len(sets))]


def brute_components(rows, size, percent):
    sets = list(brute_sets(rows, size))
    roots = brute_roots(sets, percent)
    least = {}
    for (d, _), r in zip(sets, roots, strict=True):
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(x), least.get(r) if x else d) for (d, x), r in zip(sets, roots, strict=True)), key=str)


def with_equal_ids(corpus):
    """The corpus with ids that several texts share, and texts that have null ids only."""
    texts = [t for _, t in corpus if t]
    return [*corpus, (7, texts[0]), (7, texts[3]), (7, "alone " * 9 + "in all " * 5), (7, "one two three four five six seven"), (7, "one two three four five six seven"), (None, "no id at all but these words"), (None, "no id at all but these words"), (None, texts[0])]


@pytest.mark.parametrize("size,percent,leaf", [(4, 85, J.LEAF), (5, 80, J.LEAF), (4, 85, 3), (5, 60, 9)])
def test_jaccard_join(spark, corpus, size, percent, leaf):
    rows = with_equal_ids(corpus)
    got = J.near_duplicates(spark.createDataFrame(rows, DDL), size, percent, leaf=leaf, pivots=2).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, size, percent)


@pytest.mark.parametrize("leaf,pivots", [(50, 2), (300, 4)])
def test_join_of_near_misses(spark, leaf, pivots):
    """One region of many members just below the threshold, which pivots can't divide, and families which they can."""
    r = random.Random(5)
    rows, page = [], [f"p{i}" for i in range(60)]
    for i in range(60):
        rows.append((i, " ".join([*page, *(f"own{i}x{k}" for k in range(12))])))
    for f in range(6):
        head = [f"f{f}w{i}" for i in range(40)]
        for k in range(12):
            text = page[:30] + head
            for _ in range(k % 4):
                text[r.randrange(30, 70)] = f"z{r.randrange(9)}"
            rows.append((1000 + 100 * f + k, " ".join(text)))
    got = J.near_duplicates(spark.createDataFrame(rows, DDL), 4, 85, leaf=leaf, pivots=pivots).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_components(rows, 4, 85)


def test_cells_hold_all_near_pairs(spark):
    """Voronoi cells with their windows: two members within the radius share a cell, and cells are smaller than the region."""
    r = random.Random(2)
    bases = [frozenset(r.sample(range(1000), 40)) for _ in range(8)]
    sets = [frozenset(list(b)[k // 2 :]) | {5000 + k} for b in bases for k in range(10)]
    far = lambda i, j: 1 - len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    pivots = [0, 10, 20, 30, 40, 50]
    known = [(min(i, p), max(i, p), len(sets[min(i, p)]), len(sets[max(i, p)]), len(sets[i] & sets[p]), False) for i in range(len(sets)) for p in pivots if i != p]
    members = spark.createDataFrame([(1, i, len(s)) for i, s in enumerate(sets)], "region long, node long, n long")
    cells = J.voronoi(members, spark.createDataFrame([(1, p) for p in pivots], "region long, pivot long"), spark.createDataFrame(known, "a long, b long, na long, nb long, common long, linked boolean"), 0.15).collect()
    held = {}
    for c in cells:
        held.setdefault(c["region"], set()).add(c["node"])
    assert len(held) == len(pivots) and max(map(len, held.values())) < 0.75 * len(sets)
    assert all(any({i, j} <= m for m in held.values()) for i in range(len(sets)) for j in range(i) if far(i, j) <= 0.15)


def test_join_of_nothing(spark):
    assert J.near_duplicates(spark.createDataFrame([], DDL)).collect() == []
    got = J.near_duplicates(spark.createDataFrame([(1, None), (2, ""), (None, "a b c d")], DDL)).collect()
    assert sorted((tuple(r) for r in got), key=str) == [(1, 0, 1), (2, 0, 2), (None, 1, None)]


def test_representatives_keep_one_row_of_each_component(spark, corpus):
    rows = with_equal_ids(corpus)
    sets = list(brute_sets(rows, 5))
    roots = brute_roots(sets, 80)
    df = spark.createDataFrame([(d, t, i, i, i) for i, (d, t) in enumerate(rows)], DDL + ", place int, number int, node int")
    kept = sorted(r["node"] for r in J.representatives(df, 5, 80).collect())
    assert [i for i in kept if not sets[i][1]] == [i for i, (_, x) in enumerate(sets) if not x]
    kept = [i for i in kept if sets[i][1]]
    assert sorted(roots[i] for i in kept) == sorted({r for r, (_, x) in zip(roots, sets, strict=True) if x})
    for i in kept:  # the row has the least id of its component
        ids = [d for (d, _), r in zip(rows, roots, strict=True) if r == roots[i] and d is not None]
        assert rows[i][0] == (min(ids) if ids else None)


def test_representatives_lose_no_unique_text(spark):
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    df = spark.createDataFrame([(3, a), (7, a), (7, b)], DDL)
    assert sorted(tuple(r) for r in J.representatives(df, 5, 80).collect()) == [(3, a), (7, b)]


ITEMS = [(1, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (2, "Short One"), (3, ""), (4, None), (10, "w5 w6 w7 w8 w9 w10 w11 w12 w13 w14"), (None, "w30 w31 w32 w33 w34 w35 w36 w37 w38 w39")]


def brute_hits(docs, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for d, t in docs:
        w, hit, named = cut(t), set(), set()
        for item, text in items:
            v = cut(text)
            n = min(window, len(v))
            keys = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in keys:
                    hit |= set(range(i, i + n))
                    named |= {str(item)} if item is not None else set()
        out.append((d, len(w), len(hit), len(named), sha(",".join(sorted(named))), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [D.BROADCAST_BYTES, 0])
def test_decontamination(spark, corpus, bound):
    docs = [*corpus, (3000, "x W1, w2 w3 w4 w5 w6 w7 w8 w9 w10 w11-w12 y"), (3001, "a short. one b short, one"), (3002, " ".join(f"w{i}" for i in range(30, 40))), (3003, "w1 w2 w3 w4 w5 w6 w7 w8 w9 z w10")]
    got = D.contamination(spark.createDataFrame(docs, DDL), spark.createDataFrame(ITEMS, "item_id long, text string"), broadcast_bytes=bound).drop("spans", "items").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_hits(docs, ITEMS)


def test_both_ways_give_the_same_rows(spark, small):
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    one, two = (sorted(map(str, D.contamination(docs, items, broadcast_bytes=b).collect())) for b in (D.BROADCAST_BYTES, 0))
    assert one == two and "contaminated=True" in " ".join(one)


@pytest.mark.parametrize("bound", [D.BROADCAST_BYTES, 0])
def test_decontaminated_keeps_columns(spark, bound):
    docs = spark.createDataFrame([(1, "short one", "k", 1, "a", 7), (2, "clean", "n", 2, "b", 7), (3, None, "z", 3, "c", 7)], "doc_id long, text string, items string, hit_spans int, hit_items string, place int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = D.decontaminated(docs, items, broadcast_bytes=bound)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "clean", "n", 2, "b", 7), (3, None, "z", 3, "c", 7)]
    assert D.decontaminated(docs, items.limit(0), broadcast_bytes=bound).count() == 3
    assert D.contamination(docs.limit(0), items, broadcast_bytes=bound).count() == 0
