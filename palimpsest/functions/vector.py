"""Vectors as Column expressions, and blocked all-pairs similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.shipping import ship


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(as_double(a), lambda x: x * x), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column, norms: Column | None = None) -> Column:
    """0 if the lengths differ, a vector is null or one of them has no length; ``norms``: the product of both norms, if it is there."""
    n = norm(a) * norm(b) if norms is None else norms
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def normalised(a: Column) -> Column:
    """Unit length; null for a vector without length."""
    n = norm(a)
    return F.when(n > 0, F.transform(as_double(a), lambda x: x / n))


def resized(a: Column, size: int) -> Column:
    """Cut or filled with zeros to a length."""
    return F.slice(F.concat(as_double(a), F.array_repeat(F.lit(0.0), size)), 1, size)


def _block(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of two blocks at unit length, and the places of those of either block that have one."""
    own, x, y = part["own"].to_numpy(), part["x"][0].as_py(), part["y"][0].as_py()
    lists = part["embedding"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    width = int(sizes.max())
    fits = sizes == width
    m = np.zeros((len(lists), width))
    m[fits] = lists.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    m[~np.isfinite(m).all(1)] = 0
    n = np.linalg.norm(m, axis=1)
    m /= np.maximum(n, 1e-300)[:, None]
    use = fits & (n > 0)
    return m, np.flatnonzero(use & (own == x)), np.flatnonzero(use & (own == y))


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = 2048, strict: bool = True) -> DataFrame:
    """i, j, sim for i < j with a cosine above (or, not strict, at) the threshold; exact.

    Vectors (id, embedding) are dealt into blocks of about ``block_rows`` rows and
    each pair of blocks is one matrix product in one task, so memory is bounded by
    two blocks and only pairs above the threshold leave it.  It is quadratic by its
    nature: vectors at such thresholds leave no room for pruning.  Vectors without
    length, null vectors and null ids have no pairs.
    """
    rows = vectors.where("id IS NOT NULL AND embedding IS NOT NULL")
    blocks = max(1, -(-rows.count() // block_rows))
    own = rows.select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("id", "embedding", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    ship(vectors.sparkSession)

    def product(part: pa.Table) -> pa.Table:
        ids, x, y = part["id"].to_numpy(), part["x"][0].as_py(), part["y"][0].as_py()
        m, left, right = _block(part)
        sim = np.round(m[left] @ m[right].T, 9)
        a, b = np.nonzero(sim > threshold if strict else sim >= threshold)
        i, j, s = ids[left[a]], ids[right[b]], sim[a, b]
        keep = i < j if x == y else i != j
        i, j, s = i[keep], j[keep], s[keep]
        return pa.table({"i": np.minimum(i, j), "j": np.maximum(i, j), "sim": s})

    return placed.groupBy("x", "y").applyInArrow(product, f"i {dict(vectors.dtypes)['id']}, j {dict(vectors.dtypes)['id']}, sim double")


def similar_sums(vectors: DataFrame, threshold: float, rows: int, block_rows: int = 8192, strip: int = 512) -> DataFrame:
    """id, total: for each of so many vectors (id, embedding, value) the sum of similarity times value over the others above the threshold.

    As ``similar_pairs``, but no pair leaves its task: a block gives one number a row.
    """
    blocks = max(1, -(-rows // block_rows))
    own = vectors.select("id", F.col("embedding").cast("array<float>").alias("embedding"), F.col("value").cast("double").alias("value"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    placed = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("*", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")).drop("other")
    ship(vectors.sparkSession)

    def product(part: pa.Table) -> pa.Table:
        value, x, y = part["value"].to_numpy(), part["x"][0].as_py(), part["y"][0].as_py()
        m, left, right = _block(part)
        total, beside = np.zeros(len(part)), np.ascontiguousarray(m[right].T)
        for at in range(0, len(left), strip):
            some = left[at : at + strip]
            sim = np.round(m[some] @ beside, 9)
            sim[sim <= threshold] = 0
            if x == y:
                sim[some[:, None] == right] = 0
            else:
                total[right] += value[some] @ sim
            total[some] += sim @ value[right]
        use = np.union1d(left, right)
        return pa.table({"id": part["id"].take(pa.array(use)), "total": total[use]})

    return placed.groupBy("x", "y").applyInArrow(product, f"id {dict(vectors.dtypes)['id']}, total double").groupBy("id").agg(F.sum("total").alias("total"))
