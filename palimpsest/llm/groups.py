"""Exchange of packed numbers between groups of documents and buckets of hashes.

Documents are dealt into groups of a bounded size by a hash of id and text, so a
repeated id does not make a hot group.  A group works on its documents in numpy and
sends each bucket one packed row; buckets, which are ranges of hashes, answer every
group with one packed row.  Whatever many documents of a group share is sent once by
that group, so a passage that a third of all documents hold costs a bucket one entry
per group, not one per document.

A bucket serves the hashes of ``GROUPS_PER_BUCKET`` groups.  There are never more
packed rows than hashes, so their number is bounded by the input; the share of
buckets only sets how well they fill before that bound is met.  Both sides are dealt
into a number of partitions that grows with the input, so no task does.
"""

from __future__ import annotations

import functools
import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.frames import fan_out
from palimpsest.llm.workers import tidy

#: Bytes of input as stored that a group should hold: about twice that in text, and some
#: thirty times that in a worker's arrays.  Larger executors can do with fewer groups.
GROUP_BYTES = 2 << 20
#: Groups whose hashes a bucket can hold at once.
GROUPS_PER_BUCKET = 2
#: Groups that one task works on, one after another.
GROUPS_PER_TASK = 4
GROUP = "__group__"

_LOW = np.uint64(0xFFFFFFFF)


def group_count(docs: DataFrame, each: int = GROUP_BYTES) -> int:
    return fan_out(docs, each)


def bucket_count(groups: int) -> int:
    return -(-groups // GROUPS_PER_BUCKET)


def dealt(df: DataFrame, key: str, count: int, each: int = 1) -> DataFrame:
    """Partitions by a key from 0 to ``count`` - 1, about ``each`` of them in one; cogroups of frames dealt alike shuffle no more.

    Single keys have a partition of their own, so no task gets several by chance.
    """
    if each == 1:
        return df.repartitionById(max(1, count), F.col(key))
    return df.repartition(max(1, -(-count // each)), F.col(key))


def group_of(*keys: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the upper 24 bits."""
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def short(hashes: np.ndarray) -> np.ndarray:
    """The lower 32 bits, which tell hashes of a bucket apart but for a few that only cost work."""
    return (hashes & _LOW).astype(np.uint32)


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpacked(values: pa.ChunkedArray | pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) if x else np.empty(0, kind) for x in values.to_pylist()]


def joined(parts: list[np.ndarray], kind: str) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def parts_of(sizes: list[int]) -> np.ndarray:
    """The number of the part that each item of the joined parts is from."""
    return np.repeat(np.arange(len(sizes)), sizes)


def table(columns: dict[str, list | np.ndarray | pa.Array], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) and c.type == f.type else (c.cast(f.type) if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)) for f in schema], schema=schema)


def tidied(function):
    """The same function of tables, which gives the worker's freed memory back before each group."""

    @functools.wraps(function)
    def run(*tables: pa.Table) -> pa.Table:
        tidy()
        return function(*tables)

    # Spark tells functions of groups from those of keys and groups by their parameters
    run.__signature__ = inspect.signature(function)
    return run


def rows_schema(ddl: str) -> tuple[object, pa.Schema]:
    """A schema for Spark and the same for Arrow."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = StructType.fromDDL(ddl)
    return spark, to_arrow_schema(spark)
