"""Fixity: places and trees against plain Python, and what an audit finds in a replica that is a table of its own."""

import hashlib

from pyspark.sql import functions as F

from palimpsest.llm import fixity

DDL = "page_id long, url string, html string"
PAGES = [(i % 90 if i < 95 else None, f"u{i}" if i % 7 else None, f"<p>{i} é</p>" if i % 9 else None) for i in range(100)] + [(1, "u", "same")] * 40


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_records(pages, files):
    """(file, record id): page, length and digest of each record, from its bytes."""
    out, seen = {}, {}
    for page, url, html in pages:
        url, html = url or "", html or ""
        seen[page, url, html] = copy = seen.get((page, url, html), 0) + 1
        name = hashlib.md5("|".join(["" if page is None else str(page), url, sha(html), str(copy)]).encode()).hexdigest()
        uid = "-".join([name[:8], name[8:12], name[12:16], name[16:20], name[20:]])
        head = f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:{uid}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI: {url}\r\nWARC-Block-Digest: sha256:{sha(html)}\r\nContent-Type: text/html\r\nContent-Length: {len(html.encode())}\r\n\r\n"
        out[int(name[24:], 16) % files, name] = (page, len((head + html).encode()) + 4, sha(head + sha(html)))
    return out


def brute_root(nodes):
    """nodes: path and (key, digest, bytes) of each record."""
    while True:
        by = {}
        for path, child in nodes:
            by.setdefault(path, []).append(child)
        made = [(p, sha("\n".join(f"{k} {d} {b}" for k, d, b in sorted(c))), sum(b for _, _, b in c)) for p, c in by.items()]
        if set(by) == {""}:
            return made[0][1]
        nodes = [(p[:-1], (p, d, b)) for p, d, b in made]


def test_records_places_and_roots(spark):
    want = brute_records(PAGES, 5)
    held = fixity.records(spark.createDataFrame(PAGES, DDL), files=5)
    rows = fixity.laid_out(held).collect()
    assert {(r["file"], r["record_id"]): (r["page_id"], r["length"], r["digest"]) for r in rows} == want and len(rows) == len(want) == 140
    for r in rows:
        assert r["offset"] == sum(v[1] for (f, name), v in want.items() if f == r["file"] and name < r["record_id"])
    levels = fixity.tree(held.withColumn("side", F.lit(0)), 2)
    assert fixity.roots(levels) == {0: brute_root([(f"{f:05x}{name[:2]}", (name, v[2], v[1])) for (f, name), v in want.items()])}


def test_audit_finds_damage_loss_and_additions(spark):
    pages = spark.createDataFrame(PAGES, DDL)
    damaged = F.when(F.col("url") == "u8", "x").otherwise(F.col("html"))
    own, other = fixity.records(pages, files=5), fixity.records(pages, damaged, files=5)
    names = {r["page_id"]: (r["file"], r["record_id"]) for r in own.where("page_id IN (8, 20, 30)").collect()}
    at = lambda page: (F.col("file") == names[page][0]) & (F.col("record_id") == names[page][1])
    # 20 is lost, 30 is in another file, one is new, one is there twice
    extra = spark.createDataFrame([(500, "f" * 32, 2, 9, "x")], own.schema)
    replica = other.where(~at(20)).withColumn("file", F.when(at(30), (F.col("file") + 1) % 5).otherwise(F.col("file")))
    replica = replica.unionByName(extra).unionByName(other.where(F.col("page_id") == 40))
    rows = fixity.audit(own, replica).collect()
    found = sorted((r["status"], r["page_id"]) for r in rows if r["status"] != "intact")
    assert found == [("damaged", 8), ("extra", 30), ("extra", 40), ("extra", 500), ("missing", 20), ("missing", 30)]
    assert sum(r["status"] == "intact" for r in rows) == 140 - 3
    hit = next(r for r in rows if r["status"] == "damaged")
    assert hit["length"] - hit["replica_length"] == len("<p>8 é</p>".encode()) - 1


def test_only_differing_branches_are_compared(spark):
    own = fixity.records(spark.createDataFrame(PAGES, DDL), files=5)
    other = fixity.records(spark.createDataFrame(PAGES, DDL), F.when(F.col("url") == "u8", "x").otherwise(F.col("html")), files=5)
    levels = fixity.tree(own.withColumn("side", F.lit(0)).unionByName(other.withColumn("side", F.lit(1))), 1)
    hit = own.where("page_id = 8").first()
    assert [r["path"] for r in fixity.differing(levels).collect()] == [f"{hit['file']:05x}{hit['record_id'][0]}"]
    assert len(set(fixity.roots(levels).values())) == 2


def test_audit_of_equal_and_empty_archives(spark):
    pages = spark.createDataFrame([(*p, "t") for p in PAGES], DDL + ", digest string")
    rows = fixity.audit(fixity.records(pages), fixity.records(pages)).collect()
    assert len(rows) == 140 and {r["status"] for r in rows} == {"intact"}
    none = fixity.records(pages.limit(0))
    assert fixity.audit(none, none).count() == 0
    assert {r["status"] for r in fixity.audit(none, fixity.records(pages)).collect()} == {"extra"}
    assert {r["status"] for r in fixity.audit(fixity.records(pages), none).collect()} == {"missing"}
