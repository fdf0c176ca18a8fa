"""The corpus pipeline against a plain model of its stages."""

import hashlib

import numpy as np
import pytest

from palimpsest.llm import quality
from tests.llm.conftest import sha, words
from tests.llm.test_dedup import brute_hits, brute_roots, brute_sets

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, small, tmp_path_factory):
    """The small tables with rows that share an id, copies, near copies and a benchmark passage."""
    where = str(tmp_path_factory.mktemp("tables"))
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    long = [r for r in rows if r["text"] and 80 < len(r["text"].split()) < 400]
    item = spark.read.parquet(f"{small}/benchmark.parquet").orderBy("item_id").first()["text"]
    a, b, c = (r["text"] for r in long[:3])
    near = " ".join([*a.split()[:-1], "otherword"])
    planted = [(long[0]["doc_id"], b + " unlike the first"), (90001, a), (90002, near), (90002, c + " and one more end"), (None, a), (None, None), (90003, ""), (90004, c + " " + item + " " + item), (90005, "x y z " + " ".join(a.split()[10:40]) + " " + " ".join(reversed(b.split())))]
    more = spark.createDataFrame([(d, t, "en", "planted", len(t or "")) for d, t in planted], docs.schema)
    docs.unionByName(more).repartition(3).write.parquet(f"{where}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{where}/{name}.parquet")
    return where


def cleaned(rows, window=13):
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, 1 << 62), 1 << 62 if d is None else d)
    out = []
    for d, t in rows:
        w, gone = words(t), set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (1 << 62 if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    return out


def test_whole_pipeline(spark, folder):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept_ids = {(r["doc_id"], r["n_words"], r["word_chars"]) for r in quality.quality(docs, labels).where("kept").collect()}
    rows = [(d, t) for d, t in rows if (d, len(words(t)), sum(map(len, words(t)))) in kept_ids]
    assert len(rows) > 50
    # one row of each component, that of the least id
    sets = list(brute_sets(rows, 5))
    groups = {}
    for (d, t), root in zip(rows, brute_roots(sets, 80), strict=True):
        groups.setdefault(root, []).append((d is None, d or 0, t, d))
    least = [[x for x in g if x[:2] == min(y[:2] for y in g)] for g in groups.values()]
    assert all(len({x[2] for x in g}) == 1 for g in least)  # no ties in this corpus, so one model answer
    rows = [(g[0][3], g[0][2]) for g in least]
    rows = cleaned(rows)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = {(r[0], r[1], r[2]) for r in brute_hits(rows, items) if r[5]}
    clean = []
    for row in rows:
        told = brute_hits([row], items)[0]
        if not told[5]:
            clean.append(row)
    assert hit and len(clean) < len(rows)
    library = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    want = []
    for d, t in clean:
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids, skip_special_tokens=False))))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS hit_spans", "2 AS dedup_n_words", "3 AS kept_text", "4 AS place")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
