"""Quality rules: gradient-boosted trees over document statistics.

The statistics of a document are counted on its bytes in one pass (words, code
points, symbols, repeated lines, repeated three-word windows, ...).  Two hard
rules reject first; what they let through is judged by boosted trees that were
fitted to labelled documents and flattened into node arrays.  All other features
equal, a higher rate of symbols, of bars, of repeated lines or of repeated words can
only lower a score; a change of a text moves other features too.

Fitting takes at most ``sample`` labelled documents (chosen by a hash of the id), a
bound that does not grow with the input.  Statistics and verdicts cover every
document whole, without a shuffle.  Null and empty texts have zero statistics
and fail the base rules.  Repeated rows give repeated results.  Without usable
labels the forest has no trees and passes all that the base rules pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.boosting import Forest, fit
from palimpsest.llm.frames import arrow_map, free_name, labelled_ids, text_rows
from palimpsest.llm.workers import tidy

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled documents that the trees are fitted to at most; only their features reach the driver.
SAMPLE = 8192
KEEP_AT = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_rate", "upper_rate", "digit_rate", "mark_rate", "line_words", "distinct_rate", "short_rate", "long_rate", "bar_rate", "bang_rate")
MONOTONE = np.array([0, 0, -1, -1, -1, 0, 0, 0, 0, 0, 0, 0, -1, 0])

_LINES = W.byte_class(separators=b"\n")


def _table(members: bytes) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(members)] = 1
    return out


_SYMBOLS = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_DIGITS = _table(b"0123456789")
_MARKS = _table(b".,;:?")
_BAR = _table(b"|")
_BANG = _table(b"!")


def distinct(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of each owner."""
    if not len(values):
        return np.zeros(n, np.int64)
    order = np.lexsort((values, owner))
    o, v = owner[order], values[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (v[1:] != v[:-1])
    return np.bincount(o[new], minlength=n)


def repeated_words(found: W.Words, hashes: np.ndarray, size: int = 3) -> np.ndarray:
    """Words of each document in windows of ``size`` words that occur twice or more in it."""
    n = len(found.first) - 1
    grams = W.windows(hashes, size)
    inside = W.inside(found.first, size, len(grams))
    at = np.flatnonzero(inside)
    if not len(at):
        return np.zeros(n, np.int64)
    owner = found.owner
    own = W.mix(grams[at] ^ W.mix(owner[at].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    marks = np.zeros(len(hashes) + 1, np.int64)
    starts = at[twice]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + size, -1)
    return np.bincount(owner[np.cumsum(marks[:-1]) > 0], minlength=n)


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base counts and the feature matrix of a slice of texts."""
    found = W.split(texts)
    n = len(found.first) - 1
    lines = W.split(texts, _LINES)
    data, text = found.data, found.text
    hashes = found.hashes()

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[text])

    words = found.counts
    chars = per_text(((data & 0xC0) != 0x80) & ~W.SPACES[data])
    symbols = per_text(_SYMBOLS[data])
    worded = np.searchsorted(found.start, lines.end) > np.searchsorted(found.start, lines.start)
    owner = lines.owner[worded]
    n_lines = np.bincount(owner, minlength=n) if len(owner) else np.zeros(n, np.int64)
    dups = n_lines - distinct(owner, lines.hashes()[worded], n)
    repeats = repeated_words(found, hashes)
    size = found.end - found.start
    own = found.owner
    at_least = np.maximum(words, 1)
    counts = dict(zip(COUNTS, (words, chars, symbols, dups, repeats), strict=True))
    letters = np.maximum(chars, 1)
    x = np.stack(
        [
            np.log1p(words),
            chars / at_least,
            symbols / letters,
            dups / np.maximum(n_lines, 1),
            repeats / at_least,
            per_text(_UPPER[data]) / letters,
            per_text(_DIGITS[data]) / letters,
            per_text(_MARKS[data]) / at_least,
            words / np.maximum(n_lines, 1),
            distinct(own, hashes, n) / at_least,
            (np.bincount(own, size <= 2, n) if len(own) else np.zeros(n)) / at_least,
            (np.bincount(own, size >= 12, n) if len(own) else np.zeros(n)) / at_least,
            per_text(_BAR[data]) / at_least,
            per_text(_BANG[data]) / at_least,
        ],
        1,
    )
    return counts, x


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """A forest for ``labels.quality``, from at most ``sample`` labelled documents.

    Features are counted where texts are read; texts are neither shuffled nor collected.
    Of rows that share an id one counts.
    """
    few = labelled_ids(labels, "quality", sample)
    rows = text_rows(docs).where("doc_id IS NOT NULL").join(F.broadcast(few), "doc_id").withColumn("place", F.xxhash64("text"))

    def features(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, texts in W.slices(batch.column("text")):
            _, x = statistics(texts)
            yield {"x": pa.array(list(x), pa.list_(pa.float64()))} | {c: batch.column(c).slice(a, b - a) for c in ("doc_id", "place", "quality")}

    counted = arrow_map(rows.select("doc_id", "text", "place", "quality"), features, "doc_id long, place long, quality int, x array<double>")
    table = counted.groupBy("doc_id").agg(F.min(F.struct("place", "x"))["x"].alias("x"), F.first("quality").alias("quality")).toArrow()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    x = np.array(table["x"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit(x, table["quality"].to_numpy().astype(float)[order], MONOTONE)


def verdict(counts: dict[str, np.ndarray], x: np.ndarray, forest: Forest, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, score and kept."""
    failed = (counts["n_words"] < min_words) | (100 * counts["n_repeat_words"] > max_repeat_percent * counts["n_words"])
    score = forest.probability(x)
    return failed, score, ~failed & (score >= KEEP_AT)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: its counts, whether the base rules reject it, score and verdict."""
    forest = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def judge(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, texts in W.slices(batch.column("text")):
            counts, x = statistics(texts)
            failed, score, kept = verdict(counts, x, forest.value)
            yield counts | {"doc_id": batch.column("doc_id").slice(a, b - a), "base_failed": failed, "kept": kept, "score": score}

    return arrow_map(text_rows(docs), judge, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")


def good_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that the rules keep, with the columns of ``docs``; no join, no shuffle.

    Other columns come along, whatever their names and types; a text of another type is
    read as a string.
    """
    kinds = dict(docs.dtypes)
    if kinds["text"] != "string":
        said = free_name("text_said", docs)
        kept = good_documents(docs.withColumnsRenamed({"text": said}).withColumn("text", F.col(said).cast("string")), labels, sample)
        return kept.drop("text").withColumnRenamed(said, "text").select(*docs.columns)
    forest = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for a, b, texts in W.slices(batch.column("text")):
                counts, x = statistics(texts)
                yield batch.slice(a, b - a).filter(pa.array(verdict(counts, x, forest.value)[2]))

    return docs.mapInArrow(keep, docs.schema)
