"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.workers import tidy

#: Sizes that Spark gives when it knows nothing about a frame are far above this.
_UNKNOWN_BYTES = 1 << 52


def estimated_bytes(df: DataFrame) -> int:
    """Bytes of a frame by Spark's own statistics, no job; a guess of 64 MB if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < _UNKNOWN_BYTES else 64 << 20


def fan_out(df: DataFrame, each: int, least: int = 64) -> int:
    """How many groups of about ``each`` bytes a frame makes; grows with the input."""
    return max(least, -(-estimated_bytes(df) // each))


def text_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, whatever else there is."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def free_name(name: str, *frames: DataFrame) -> str:
    """The name, or the name with underscores, such that no frame has a column of that name in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def labelled_ids(labels: DataFrame, label: str, sample: int, where: Column | None = None) -> DataFrame:
    """doc_id and ``label`` of at most ``sample`` ids: those with the least hashes among all that have one label, 0 or 1.

    The choice is the same at every partitioning.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
    if where is not None:
        known = known.where(where)
    known = known.groupBy("doc_id").agg(F.min(label).alias(label), F.max(label).alias("most")).where(F.col(label) == F.col("most"))
    return known.select("doc_id", label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, sample: int, sample_bytes: int, where: Column | None = None) -> DataFrame:
    """doc_id, text and ``label`` of at most ``sample`` labelled documents with at most ``sample_bytes`` of text in all.

    Of rows that share an id one counts; texts come whole, in the order of the ids'
    hashes, as far as the bytes reach.
    """
    few = labelled_ids(labels, label, sample, where)
    rows = text_rows(docs).where(F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) <= sample_bytes)).join(F.broadcast(few), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("place"), "text"))["text"].alias("text"), F.first(label).alias(label))
    upto = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    return rows.withColumn("upto", upto).where(F.col("upto") <= sample_bytes).drop("upto")


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[dict]], schema: str, keeps: bool = False) -> DataFrame:
    """Apply a function from a record batch to dictionaries of columns, in Arrow batches.

    Unless it ``keeps`` something for its next task, the worker is tidied first.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if not keeps:
            tidy()
        to = to_arrow_schema(fields)
        for batch in batches:
            if batch.num_rows:
                for columns in function(batch):
                    yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in to], schema=to)

    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    return df.mapInArrow(run, fields)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    if isinstance(values, np.ndarray) and values.dtype == np.uint64:
        values = values.view(np.int64)
    return pa.array(values, kind)
