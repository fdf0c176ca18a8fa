"""Merkle fixity audit of WARC archives.

An archive is a set of files, each a sequence of WARC records in the order of their
record ids, so ranges of ids are ranges of offsets.  A record's digest covers its
header and the hash of its block as found now; the header says what the block was when
it was written.  Records are the leaves of one tree: a node is a prefix of (file,
record id) and hashes, in order, its children's digests and the bytes of the range
that each covers.  Offsets follow from these extents, so equal roots mean equal
archives, and a record that is lost changes only the nodes above it, not all that
come after.

An audit compares two archives, which are tables of their own: the roots first, and
if these differ the children of differing nodes, level by level, down to records that
are damaged, missing or extra.  Every level is written once, for both archives.

Everything is built-in functions: blocks are hashed where they are read and never
shuffled, only digests are.  The number of files grows with the bytes and the depth
with the records, so no file's window and no node's children grow.  Repeated rows are
counted before they are shuffled and become records with ids of their own.  Null urls
and payloads are empty, null ids are kept, other columns are ignored.  An empty
archive has no nodes; two empty archives agree.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.llm.staging import discard, staged

FILES = 16
FILE_BYTES = 1 << 28
#: Hexadecimal digits of a file's number; a node has 16 children, and a record's slot about so many.
FILE_DIGITS = 5
FANOUT = 16
#: The crawl's date, which pages don't carry.
DATE = "2020-01-01T00:00:00Z"


def header(record_id: Column, url: Column, block_digest: Column, length: Column, date: str = DATE) -> Column:
    """The header of a resource record, up to the empty line."""
    lines = [
        F.lit("WARC/1.1"),
        F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:uuid:"), *[x for a, b in ((1, 8), (9, 4), (13, 4), (17, 4)) for x in (F.substring(record_id, a, b), F.lit("-"))], F.substring(record_id, 21, 12), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Block-Digest: sha256:"), block_digest),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"))


def records(pages: DataFrame, found: Column | None = None, files: int | None = None) -> DataFrame:
    """Records of ``pages`` as a stored table: page_id, record_id, file, length and digest.

    ``found`` is the payload that an archive holds now, if not the one that was
    written.  ``files`` should be that of the archive to compare with.
    """
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    now = html if found is None else F.coalesce(found, F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.sha2(html, 256).alias("written"), F.octet_length(html).alias("size"), F.sha2(now, 256).alias("found"), F.octet_length(now).alias("found_size"))
    rows = staged(rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")), "blocks")
    if files is None:
        files = max(FILES, -(-int(rows.agg(F.sum(F.col("found_size") * F.col("copies"))).first()[0] or 0) // FILE_BYTES))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    identity = F.md5(F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "written", F.col("copy").cast("string")))
    rows = rows.withColumn("record_id", identity)
    top = header(F.col("record_id"), F.col("url"), F.col("written"), F.col("size"))
    file = (F.conv(F.substring("record_id", 25, 8), 16, 10).cast("long") % files).cast("int")
    return rows.select("page_id", "record_id", file.alias("file"), (F.octet_length(top) + F.col("found_size") + 4).cast("long").alias("length"), F.sha2(F.concat(top, F.col("found")), 256).alias("digest"))


def laid_out(records: DataFrame) -> DataFrame:
    """Records with their ``offset`` in their file."""
    before = Window.partitionBy("file").orderBy("record_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def depth_of(rows: int, files: int) -> int:
    """Digits of the record id that a slot of about ``FANOUT`` records has."""
    return max(1, ceil(log(max(1, rows / max(1, files) / FANOUT), FANOUT)))


def _node(children: Column) -> Column:
    return F.sha2(F.array_join(F.transform(children, lambda c: F.concat(c["key"], F.lit(" "), c["digest"], F.lit(" "), c["bytes"].cast("string"))), "\n"), 256)


def tree(records: DataFrame, depth: int) -> list[DataFrame]:
    """Levels of the trees of all archives (``side``), as stored tables: records' slots first, the roots last.

    A node has side, path, digest and bytes; paths of a level are equally long.
    """
    path = F.concat(F.lpad(F.lower(F.hex("file")), FILE_DIGITS, "0"), F.substring("record_id", 1, depth))
    below = records.select("side", path.alias("path"), F.col("record_id").alias("key"), "digest", F.col("length").alias("bytes"))
    out = []
    for size in range(FILE_DIGITS + depth, -1, -1):
        children = F.array_sort(F.collect_list(F.struct("key", "digest", "bytes")))
        nodes = below.groupBy("side", "path").agg(children.alias("children"), F.sum("bytes").alias("bytes"))
        out.append(staged(nodes.select("side", "path", _node(F.col("children")).alias("digest"), "bytes"), "tree-level"))
        below = out[-1].select("side", F.substring("path", 1, max(0, size - 1)).alias("path"), F.col("path").alias("key"), "digest", "bytes")
    return out


def roots(levels: list[DataFrame]) -> dict[int, str]:
    """The root of each archive that has any record."""
    return {r["side"]: r["digest"] for r in levels[-1].collect()}


def differing(levels: list[DataFrame]) -> DataFrame:
    """Paths of the slots in which two archives differ; below a node on which they agree nothing is compared."""
    found = None
    for level in reversed(levels):
        if found is not None:
            level = level.withColumn("up", F.expr("substring(path, 1, length(path) - 1)")).join(found.withColumnRenamed("path", "up"), "up", "left_semi")
        found = level.groupBy("path").agg(F.min("digest").alias("low"), F.max("digest").alias("high"), F.min("bytes").alias("few"), F.max("bytes").alias("many"), F.count("*").alias("sides")).where("sides < 2 OR low <> high OR few <> many").select("path")
    return found


def audit(archive: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of two archives: page_id, record_id, file, offset, length, replica_offset, replica_length, digest and status.

    Both have the columns of ``records``.  The status is ``intact``, ``damaged``,
    ``missing`` from the replica or ``extra`` in it; a record that is in another file
    there is missing from one and extra in the other.  If a record id occurs several
    times in a file, its records are paired in the order of their digests.
    """
    order = Window.partitionBy("file", "record_id").orderBy("digest")
    names = ["side", "page_id", "record_id", "file", "offset", "length", "digest", "nth"]
    sides = [laid_out(x).withColumn("side", F.lit(i)).withColumn("nth", F.row_number().over(order)).select(*names) for i, x in enumerate((archive, replica))]
    rows = staged(sides[0].unionByName(sides[1]), "records")
    seen = rows.agg(F.count("*"), F.count_distinct("file")).first()
    depth = depth_of(seen[0] // 2, seen[1])
    levels = tree(rows, depth)
    told = roots(levels)
    key = ["file", "record_id", "nth"]
    one = rows.where("side = 0").select(*key, "page_id", "offset", "length", "digest")
    two = rows.where("side = 1").select(*key, F.col("page_id").alias("other_id"), F.col("offset").alias("replica_offset"), F.col("length").alias("replica_length"), F.col("digest").alias("other"))
    if told.get(0) == told.get(1):  # nothing to go down for
        status = F.lit("intact")
    else:
        slots = staged(differing(levels), "differing").withColumn("differs", F.lit(True))
        path = F.concat(F.lpad(F.lower(F.hex("file")), FILE_DIGITS, "0"), F.substring("record_id", 1, depth))
        one = one.withColumn("path", path).join(slots, "path", "left").drop("path")
        status = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("differs") & (F.col("digest") != F.col("other")), "damaged").otherwise("intact")
    discard(*levels)
    both = one.join(two, key, "full_outer")
    return both.select(F.coalesce("page_id", "other_id").alias("page_id"), "record_id", "file", "offset", "length", "replica_offset", "replica_length", "digest", status.alias("status"))
