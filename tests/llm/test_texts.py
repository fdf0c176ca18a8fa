"""Extraction, toxicity, BPE, sharding, chat, fixity and quality."""

import hashlib
import json
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import boosting, bpe, chat, html_blocks, quality, sharding, toxicity
from palimpsest.llm.examples import _drawn, labelled_pages
from palimpsest.llm.frames import labelled_sample
from palimpsest.llm.queries import INJECTION, tokenizer_path
from tests.llm.conftest import words

DDL = "doc_id long, text string"


# html


def judged(pages, tree):
    """Labels of the blocks of pages whose blocks start with them, and the tree's."""
    told, said = [], []
    for page in pages:
        blocks, article = html_blocks.blocks_of(page)
        bare = [(t[1:].strip(), b) for t, b in blocks]
        told += [t[0] == "+" for t, _ in blocks]
        said += tree.predict(html_blocks.features(bare, article)).tolist()
    return np.array(told), np.array(said)


def test_tree_learns_its_table_and_more():
    tree = html_blocks.trained()
    told, said = judged(labelled_pages(), tree)
    assert (told == said).mean() > 0.995
    told, said = judged(_drawn(150, seed=77), tree)  # pages that it was not grown from
    assert (told == said).mean() > 0.98 and (told & said).sum() / told.sum() > 0.98
    used = {html_blocks.FEATURES[f] for f, k, i in zip(tree.feature, tree.left, range(len(tree.left)), strict=True) if k != i}
    assert {"link_density", "density_around", "words_before"} <= used


def test_tree_against_a_walk():
    tree, r = html_blocks.trained(), np.random.default_rng(3)
    x = np.column_stack([r.integers(0, 60, 500), r.random(500), r.integers(0, 60, 500), r.random(500), r.integers(0, 60, 500), r.random(500), r.random(500), *[r.integers(0, 2, 500) for _ in range(7)]]).astype(float)

    def walk(row, at=0):
        if tree.left[at] == at:
            return tree.label[at]
        return walk(row, tree.left[at] if row[tree.feature[at]] <= tree.threshold[at] else tree.right[at])

    assert tree.predict(x).tolist() == [walk(row) for row in x]


class Flat(HTMLParser):
    """Blocks of well-formed pages by the library's parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.silent = [], "", 0
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if " ".join(self.now.split()):
            self.out.append(" ".join(self.now.split()))
        self.now = ""

    def tag(self, name, step):
        if name in html_blocks.SILENT:
            self.silent += step
        if name == "br":
            self.now += " "
        elif name not in html_blocks.INLINE:
            self.end()

    def handle_starttag(self, name, attrs):
        self.tag(name, 1)

    def handle_endtag(self, name):
        self.tag(name, -1)

    def handle_data(self, data):
        self.now += "" if self.silent else data


def test_blocks_against_the_library(small):
    pages = [r["html"] for r in pq.read_table(f"{small}/pages.parquet").to_pylist() if r["html"]] + labelled_pages()
    for page in pages:
        assert [t for t, _ in html_blocks.blocks_of(page)[0]] == Flat(page).out


def test_all_of_the_article_and_nothing_else(medium):
    tree = html_blocks.trained()
    for row in pq.read_table(f"{medium}/pages.parquet").to_pylist():
        inner = re.search("<article>(.*)</article>", row["html"] or "", re.S)
        assert html_blocks.main_text(row["html"], tree) == ("\n\n".join(Flat(inner[1]).out) if inner else "")


def test_features_of_neighbours():
    page = "<p>one two</p><p><a href=x>three</a> four</p><p><a href=y>five six</a></p><p>seven</p>"
    x = html_blocks.features(*html_blocks.blocks_of(page))
    f = {n: x[:, i].tolist() for i, n in enumerate(html_blocks.FEATURES)}
    assert f["words"] == [2, 2, 2, 1] and f["link_density"] == [0, 0.5, 1, 0] and f["density_before"] == [0, 0, 0.5, 1] and f["density_after"] == [0.5, 1, 0, 0]
    assert f["density_around"] == [3 / 6, 3 / 7, 3 / 7, 3 / 5]


def test_pages_are_read_in_linear_time():
    for part in ("<title>x ", "<p a=\"", "<p a='", "<!-- ", "<div ", "</", "<a href=", "<select>", "<p class=x "):
        took = []
        for n in (4000, 32000):
            began = time.perf_counter()
            html_blocks.blocks_of(part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 30 * took[0] + 0.2, part


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<article><p class=it's>Hello there, world.</p><p>it's me here.</p></article>", "Hello there, world.\n\nit's me here."),
        ('<article><p title="abc>Text one.</p><p>And two.</p></article>', "Text one.\n\nAnd two."),
        ("<div class='search-results-explained'><article><p>Rivers are explained here.</p></article></div>", "Rivers are explained here."),
        ("<article><p data-x='a>b' class=\"c>d\">One.</p><!----><p>Two <!-> three.</p></ x><p>Four.</p></article>", "One.\n\nTwo three.\n\nFour."),
        ("<article><p>One.</p><title>Two.<p hidden>Three.</p><p>Five.</p></article>", "One.\n\nTwo.\n\nFive."),
        ("<article><h1>A &amp; B</h1><p>One  two\n three &eacute;&#33;<br>four</p><script>var x='<p>no</p>'</script><p>F<b>iv</b>e.</p></article><footer>f</footer>", "A & B\n\nOne two three é! four\n\nFive."),
        ("<nav><a href=x>Home</a></nav><article><p>Yes.<p>No <!-- hidden --> way.</article><div class='cookie-banner'>We use cookies to track all that you do on this site and others.</div>", "Yes.\n\nNo way."),
        ("<article><p>The flood came in the night and took the bridge with it.</p><div class='ad'>Buy now, pay later, all lamps.</div><section id='comments'><p>Nonsense, I was there and saw it all.</p></section></article>", "The flood came in the night and took the bridge with it."),
    ],
)
def test_main_text(page, want):
    assert html_blocks.main_text(page, html_blocks.trained()) == want


def test_extraction_of_all_pages(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = html_blocks.extracted(pages.unionByName(spark.createDataFrame([(-1, None, None)], pages.schema))).collect()
    assert len(rows) == pages.count() + 1 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert sum(r["text"] != "" for r in rows) >= pages.count()
    few = spark.createDataFrame([(1, "u", "<p>a b</p>", "t", 1)] * 2 + [(None, None, "", None, None)], "page_id long, url string, html string, text string, n_chars int")
    assert html_blocks.extracted(few.limit(0)).collect() == []
    got = html_blocks.extracted(few).collect()
    assert got.count((1, "u", "a b", 3)) == 2 and (None, None, "", 0) in got


# toxicity


def test_gradients():
    net = toxicity.Network.new(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = toxicity.inputs(pa.array(["one two three four", "five one"], pa.large_string()))
    start, length, _ = toxicity.window_starts(np.diff(x.first), x.first)
    tokens = toxicity.tokens_of(np.append(x.at, -1), start, length)
    y = np.array([1.0, 0.0])

    def loss():
        _, gates = net.project(x)
        z = net.run(tokens, gates).astype(float)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    seen, gates = net.project(x)
    g = net.gradients(tokens, x, seen, gates, y, np.ones(2))
    r = np.random.default_rng(0)
    for name in ("wf", "ub", "a", "o", "cf", "bias", "word", "gram"):
        v = net.p[name]
        at = tuple(r.integers(0, n) for n in v.shape) if name not in ("word", "gram") else (int(x.word[0] if name == "word" else x.gram[0]), 2)
        step, before = 0.02, v[at]
        v[at] = before + step
        up = loss()
        v[at] = before - step
        down = loss()
        v[at] = before
        assert abs((up - down) / (2 * step) - g[name][at]) < 3e-3 + 0.1 * abs(g[name][at]), name


def test_windows_cover_all_words():
    counts = np.array([0, 1, 16, 17, 40, 100])
    first = np.concatenate([[0], np.cumsum(counts)])
    start, length, doc = toxicity.window_starts(counts, first)
    for i, n in enumerate(counts):
        covered = {w for s, k, d in zip(start, length, doc, strict=True) if d == i for w in range(s - first[i], s - first[i] + k)}
        assert covered == set(range(n))


def test_held_out_toxicity(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.85
    empty = toxicity.toxicity(spark.createDataFrame([(None, None), (1, ""), (2, "a")], DDL), labels.limit(0)).collect()
    assert len(empty) == 3 and len({r["score"] for r in empty}) == 1


# bpe


def test_same_ids_as_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    r = random.Random(9)
    texts = ["", " ", "a<|endoftext|> b", "don't  I'LL\n\n x", "漢字 é😀​", "\x1c\x1f\x85 \xa0", "a" * 500, "=" * 70] + ["".join(r.choices("abe tion'sre12.!é漢\n\t  <|>", k=r.randrange(70))) for _ in range(400)]
    rows = bpe.encoded(spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], DDL), tokenizer_path()).collect()
    got = {x["doc_id"]: x for x in rows}
    for i, text in enumerate(texts):
        ids = t.encode(text, add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == t.decode(ids, skip_special_tokens=False), repr(text)
    assert got[-1]["ids"] == [] and got[-1]["decoded"] == ""
    digest = {x["doc_id"]: x for x in bpe.round_trip(spark.createDataFrame(list(enumerate(texts)), DDL), tokenizer_path()).collect()}
    assert all(digest[i]["ids_sha256"] == hashlib.sha256(np.array(got[i]["ids"], "<u4").tobytes()).hexdigest() and digest[i]["decoded_sha256"] == hashlib.sha256(x.encode()).hexdigest() for i, x in enumerate(texts))


@pytest.mark.parametrize("change", [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"decoder": None}, {"added_tokens": [{"id": 0, "content": "x", "lstrip": True}]}, {"model": {"type": "WordPiece"}}])
def test_other_files_are_refused(change):
    with open(tokenizer_path(), encoding="utf-8") as f:
        told = json.load(f)
    bpe._check(told, "as it is")
    with pytest.raises(ValueError, match=next(iter(change))):
        bpe._check(told | change, "changed")


# sharding


def test_shards(spark, corpus):
    rows = sharding.sharded(spark.createDataFrame(corpus, DDL)).collect()
    assert len(rows) == len(corpus)
    want = sorted(((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in corpus), key=str)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == want
    for k in {r["shard"] for r in rows}:
        own = sorted(r["slot"] for r in rows if r["shard"] == k)
        assert own == list(range(len(own))) and 0 <= k < 24
    assert sharding.sharded(spark.createDataFrame([], DDL)).count() == 0


def loads(rows, shards=24):
    return [sum(r["size"] for r in rows if r["shard"] == k) for k in range(shards)]


def test_law_of_bytes_on_tables(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text", F.lit(1).alias("size"), F.lit("x").alias("shard"))
    rows = sharding.sharded(docs).collect()
    load = loads(rows)
    assert max(load) - min(load) <= 0.02 * sum(load) / 24 and len(rows) == docs.count()
    # one id for half of the rows, one row for a third of them
    hot = docs.select(F.when(F.col("doc_id") % 2 == 0, None).otherwise(F.col("doc_id")).alias("doc_id"), "text").unionByName(spark.range(500).select(F.lit(3).alias("doc_id"), F.lit("one and the same text " * 20).alias("text")))
    rows = sharding.sharded(hot).collect()
    load = loads(rows)
    assert max(load) - min(load) <= 0.02 * sum(load) / 24 and len(rows) == hot.count()
    for k in range(24):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))


def test_a_stored_map_is_edited(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = sharding.slotted(sharding.distinct_records(docs), 512)
    sums = sharding.slot_sums(rows)
    versions = sharding.new_map(spark, 512, 8)
    two = sharding.rebalance(versions, sums, 8)
    grown = sharding.rebalance(two, sums, 9)
    held = {v: [r["shard"] for r in grown.where(F.col("version") == v).orderBy("slot").collect()] for v in (1, 2, 3)}
    assert held[1] == list(sharding.dealt(512, 8)) and grown.count() == 3 * 512
    assert [r["shard"] for r in two.where("version = 2").orderBy("slot").collect()] == held[2]
    moved = [(a, b) for a, b in zip(held[2], held[3], strict=True) if a != b]
    assert moved and {b for _, b in moved} <= set(range(9)) and len(moved) < 512 / 4
    last = sharding.sharded(docs, 9, 512, versions=grown).collect()
    assert {r["map_version"] for r in last} == {4}
    load = loads(last, 9)
    assert max(load) - min(load) <= 0.1 * sum(load) / 9


def test_rebalancing_moves_few_slots():
    r = np.random.default_rng(1)
    size = r.lognormal(8, 1.5, 16384).astype(np.int64)
    before = sharding.dealt(16384, 24)
    after = sharding.rebalanced(before, size, 24)
    load = np.bincount(after, size, 24)
    assert load.max() - load.min() <= 0.002 * load.mean() and (before != after).mean() < 0.1


# chat


def test_folding(spark):
    log = [("c", 1, 0, "message", "user", "hi"), ("c", 2, 1, "message", "assistant", ""), ("c", 3, 1, "delta", None, "he"), ("c", 4, 1, "delta", None, "y"), ("c", 5, 2, "message", "user", "more"), ("c", 6, 1, "regenerate", None, None), ("c", 7, 1, "delta", None, "new"), ("d", 1, 0, "message", "user", "a"), ("d", 2, 1, "message", "assistant", "b"), ("d", 3, 0, "edit", None, "A")]
    rows = chat.reconstructed(spark.createDataFrame(log, "conv_id string, seq int, turn int, kind string, role string, text string")).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows] == [("c", 0, "user", "hi"), ("c", 1, "assistant", "new"), ("d", 0, "user", "A")]


def brute_fold(log):
    """Turns that are left, event by event."""
    turns = {}
    for _, turn, kind, role, text in sorted(log, key=lambda e: e[0]):
        if kind in ("edit", "regenerate"):
            for later in [t for t in turns if t > turn]:
                del turns[later]
        old = turns.get(turn, (None, ""))
        said = {"delta": old[1] + (text or ""), "regenerate": ""}.get(kind, text or "")
        turns[turn] = (role if kind == "message" else old[0], said)
    return [(t, *turns[t]) for t in sorted(turns)]


def test_random_logs(spark):
    r = random.Random(6)
    logs = {}
    for c in range(60):
        open_turns, log = [0], [(0, 0, "message", "user", "hi")]
        for seq in range(1, r.randrange(2, 40)):
            kind = r.choice(["delta", "delta", "message", "edit", "regenerate"])
            turn = open_turns[-1] + 1 if kind == "message" and r.random() < 0.8 else r.choice(open_turns)
            if kind in ("edit", "regenerate"):
                open_turns = [t for t in open_turns if t <= turn]
            if turn not in open_turns:
                open_turns.append(turn)
            log.append((seq, turn, kind, r.choice(["user", "assistant"]), r.choice(["", "a", "b c", None])))
        logs[c] = log
    rows = [(c, *e) for c, log in logs.items() for e in log]
    r.shuffle(rows)
    got = {}
    for x in chat.reconstructed(spark.createDataFrame(rows, "conv_id int, seq int, turn int, kind string, role string, text string")).orderBy("conv_id", "turn").collect():
        got.setdefault(x["conv_id"], []).append((x["turn"], x["role"], x["text"]))
    assert got == {c: brute_fold(log) for c, log in logs.items()}


def test_the_log_streams_edits_and_regenerates(spark, small):
    conv = spark.read.parquet(f"{small}/conversations.parquet")
    log = chat.as_log(conv, piece=20)
    kinds = {r["kind"]: r["count"] for r in log.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "edit", "regenerate"} and kinds["delta"] > 3 * conv.count() and min(kinds.values()) > conv.count() / 10
    key = ["conv_id", "turn", "role", "text"]
    want = chat.numbered(conv).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    left = chat.reconstructed(log).select(*key)
    assert left.exceptAll(want).count() == 0 and want.exceptAll(left).count() == 0


def test_spans_in_code_points_and_bytes(spark):
    conv = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "é&<|" * i) for i in range(9)], "conv_id long, turn long, role string, text string")
    row = chat.formatted(chat.as_log(conv)).first()
    for k, s in enumerate(row["loss"]):
        said = row["formatted"][s["start"] : s["start"] + s["length"]]
        assert said == row["formatted"].encode()[s["byte_start"] : s["byte_start"] + s["byte_length"]].decode() == "é&amp;&lt;|" * (2 * k + 1)


def test_long_conversations_take_time_by_their_length(spark):
    took = []
    for n in (2000, 16000):
        df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("some words " * 5).alias("text"))
        chat.digests(df).collect()
        began = time.perf_counter()
        assert chat.digests(df).first()["n_turns"] == n
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 2


def test_escapes_come_back(spark):
    texts = ["", "<|end|>", "&lt;|", "&amp;lt;|", "a<", "|b", "<|turn|>user<|says|>x", INJECTION[0][3], "a&b<|", "<", "\n"]
    conv = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "user", None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, None, None, "y")]
    rows = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(conv, "conv_id int, turn int, role string, text string")).collect()}
    turns = "".join(f"{'assistant' if i % 2 else 'user'}\n{t}\n" for i, t in enumerate(texts))
    learned = "".join(t for i, t in enumerate(texts) if i % 2)
    assert rows[1]["n_turns"] == len(texts) and rows[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert rows[1]["loss_chars"] == len(learned) and rows[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert rows[2]["n_turns"] == 3 and rows[2]["loss_chars"] == 2 and rows[3]["n_turns"] == 1


# quality


def test_base_counts(spark, corpus):
    texts = [*corpus, (5000, "# a\n# a\n\n \nb | c <d> %\n# a"), (5001, "x x x x"), (5002, "\r\na\n \n\ta\na")]
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.quality(spark.createDataFrame(texts, DDL), labels).collect()
    want = []
    for d, t in texts:
        w, lines, covered = words(t), [x for x in (t or "").split("\n") if words(x)], set()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        for i, g in enumerate(grams):
            if grams.count(g) > 1:
                covered |= {i, i + 1, i + 2}
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered), failed))
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted(want, key=str)
    assert all(r["kept"] == (not r["base_failed"]) for r in got)


def brute_features(text):
    """The features of the trees, one by one."""
    text = text or ""
    w, chars = words(text), "".join(words(text))
    lines = [x for x in text.split("\n") if words(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {g: grams.count(g) for g in set(grams)} if len(grams) < 3000 else {}
    covered = {i + k for i, g in enumerate(grams) if seen.get(g, 1) > 1 for k in range(3)}
    n, letters, rows = max(1, len(w)), max(1, len(chars)), max(1, len(lines))
    count = lambda p: len(re.findall(p, text))
    size = [len(x.encode()) for x in w]
    return [np.log1p(len(w)), len(chars) / n, count(r"[#*$%&|<>]") / letters, (len(lines) - len(set(lines))) / rows, len(covered) / n, count("[A-Z]") / letters, count("[0-9]") / letters, count("[.,;:?]") / n, len(w) / rows, len(set(w)) / n, sum(x <= 2 for x in size) / n, sum(x >= 12 for x in size) / n, count(r"\|") / n, count("!") / n]


def test_verdicts_against_a_walk_of_the_trees(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "| # Short."), (-4, "A | b ! 12 é, " * 30)], DDL)
    forest = quality.fitted(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").where("length(text) < 4000").unionByName(extra).collect()}

    def walk(x, at):
        while forest.left[at] != at:
            at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        return forest.value[at]

    rows = quality.quality(docs.select("doc_id", "text").unionByName(extra), labels, quality.SAMPLE).where(F.col("doc_id").isin(list(texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        x = brute_features(texts[r["doc_id"]])
        score = 1 / (1 + np.exp(-np.clip(forest.base + sum(walk(x, root) for root in forest.roots), -40, 40)))
        assert abs(score - r["score"]) < 1e-9 and r["kept"] == (not r["base_failed"] and score >= 0.5)


def test_rates_only_lower_scores(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    forest = quality.fitted(docs, labels)
    x = np.array([brute_features(r["text"]) for r in docs.where("length(text) < 4000").limit(200).collect()])
    for name in ("symbol_rate", "dup_line_rate", "repeat_rate", "bar_rate"):
        more = x.copy()
        more[:, quality.FEATURES.index(name)] += 0.2
        assert (forest.margin(more) <= forest.margin(x) + 1e-9).all()


def test_samples_are_bounded_and_the_same(spark):
    docs = spark.createDataFrame([(i % 50, "x" * (i % 7)) for i in range(400)] + [(60, "y" * 500), (61, None)], DDL)
    labels = spark.createDataFrame([(i, i % 2) for i in range(62)] + [(3, 0), (None, 1), (4, None), (5, 7), (9, 1)], "doc_id long, toxic int")
    take = lambda d, n, b: sorted(map(tuple, labelled_sample(d, labels, "toxic", n, b).collect()))
    rows = take(docs, 20, 10**6)
    assert len(rows) == len({r[0] for r in rows}) <= 20 and 3 not in {r[0] for r in take(docs, 99, 10**6)} and 9 in {r[0] for r in take(docs, 99, 10**6)}
    assert rows == take(docs.repartition(7), 20, 10**6)
    assert sum(len(t or "") for _, t, _ in take(docs, 99, 60)) <= 60
    assert toxicity.fitted(docs.limit(0), labels).p["o"].any() == False  # noqa: E712


def test_rules_with_nulls_other_types_and_names(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, good, 1, "a"), (1, good, 1, "a"), (None, good, 2, None), (2, None, 3, "b"), (3, "", 4, "c")], "doc_id int, text string, score int, kept string")
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.limit(3).collect()))
    assert quality.good_documents(docs.limit(0), labels).count() == 0 and quality.quality(docs.limit(0), labels).count() == 0
    other = docs.withColumn("text", F.col("text").cast("binary"))
    assert quality.good_documents(other, labels).dtypes == other.dtypes and quality.good_documents(other, labels).count() == 3


def test_toxicity_of_long_repeated_and_missing_texts(spark, medium):
    labels = spark.read.parquet(f"{medium}/labels.parquet")
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    net = toxicity.fitted(docs, labels)
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = ["", None, "a", long, long + " the end", "a"]
    score = net.scores(pa.array(texts, pa.large_string()))
    assert len(score) == 6 and score[2] == score[5] and score[0] == score[1] and score[4] >= score[3] - 1e-6
    # by brute force: the worst of all windows, each scored alone
    for t in texts[:4]:
        w = (t or "").split()[:400]
        alone = net.scores(pa.array([" ".join(w[i : i + toxicity.WINDOW]) for i in range(0, max(1, len(w) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE)], pa.large_string()))
        assert abs(alone.max() - net.scores(pa.array([" ".join(w)], pa.large_string()))[0]) < 1e-5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def test_forest_is_monotone_and_learns():
    r = np.random.default_rng(0)
    x = r.random((2000, 3))
    y = (x[:, 0] + 0.3 * r.normal(size=2000) < 0.5).astype(float)
    f = boosting.fit(x, y, np.array([-1, 1, 0]))
    assert ((f.probability(x) >= 0.5) == y).mean() > 0.75
    for k, sign in ((0, -1), (1, 1)):
        low, high = x.copy(), x.copy()
        high[:, k] += 0.3
        assert (sign * (f.margin(high) - f.margin(low)) >= -1e-9).all()
    assert boosting.fit(x[:0], y[:0], np.zeros(3)).probability(x[:2]).tolist() == [0.5, 0.5]


def test_held_out_quality(spark, medium):
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    train, test = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    rows = quality.quality(docs, train).join(test, "doc_id").where("NOT base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) / len(rows) > 0.85
    kept = {r["doc_id"] for r in quality.good_documents(docs, train).collect()}
    assert kept == {r["doc_id"] for r in quality.quality(docs, train).where("kept").collect()}
