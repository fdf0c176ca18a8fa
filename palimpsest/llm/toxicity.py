"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network twice: as a hashed word vector and as the mean of its
hashed character trigrams.  The words of a document are cut into overlapping
windows; over each runs a gated recurrent unit in both directions, attention
pools its states, and a logistic unit scores the window.  A document scores as
its worst window, so all of it is read and length does not thin out an insult.

The network is trained in numpy on the driver, on at most ``sample`` labelled
documents of at most ``sample_bytes`` in all, whose crc32(doc_id as text) mod 5 is
not 0, in a multiple-instance way: of each document the window that scores highest is learned from.  Only text
goes in.  Scoring covers every document whole, without a shuffle; distinct words
of a slice are projected once.  Null and empty texts have one empty window and
score what the network gives to no words.  Repeated rows repeat.  Without usable
labels the network is untrained and every score is the base rate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import words as W
from palimpsest.llm.frames import arrow_map, labelled_sample, text_rows

#: Bounds of what the network is trained on, on the driver: documents, and bytes of their texts.
SAMPLE = 4096
SAMPLE_BYTES = 32 << 20
WINDOW, STRIDE = 16, 8
WORD_ROWS, GRAM_ROWS, INPUT, HIDDEN = 1 << 14, 1 << 14, 12, 8
BATCH = 4096


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


@dataclass
class Inputs:
    """Distinct words of a slice: row of the word table, rows of the trigram table; and the text as numbers of these."""

    word: np.ndarray
    gram: np.ndarray
    gram_first: np.ndarray
    at: np.ndarray
    first: np.ndarray


def inputs(texts: pa.Array) -> Inputs:
    found = W.split(texts, W.ALNUM, lower=True)
    distinct, sample, at = np.unique(found.hashes(), return_index=True, return_inverse=True)
    start, end = found.start[sample], found.end[sample]
    size = end - start
    # trigrams of bytes, with a mark before and after the word: as many as it has bytes
    first = np.concatenate([[0], np.cumsum(size)])
    where = np.repeat(start - first[:-1], size) + np.arange(first[-1])
    padded = np.concatenate([found.data, [0]]).astype(np.int64)
    middle = padded[where]
    before, after = np.where(where == np.repeat(start, size), 1, padded[where - 1]), np.where(where + 1 == np.repeat(end, size), 1, padded[where + 1])
    gram = W.mix(((before << 16) | (middle << 8) | after).astype(np.uint64)) % np.uint64(GRAM_ROWS)
    return Inputs((distinct % np.uint64(WORD_ROWS)).astype(np.int64), gram.astype(np.int64), first, at, found.first)


def window_starts(counts: np.ndarray, first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and document of all windows; a document has one at least."""
    n = np.maximum(1, -(-(counts - window) // stride) + 1)
    doc = np.repeat(np.arange(len(counts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = k * stride
    return first[:-1][doc] + start, np.minimum(window, counts[doc] - start), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


@dataclass
class Network:
    """Parameters by name.  Suffix f and b: the two directions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 7, base: float = 0.05) -> Network:
        r = np.random.default_rng(seed)

        def normal(*shape: int, by: float) -> np.ndarray:
            return r.normal(0, by, shape).astype(np.float32)

        p = {"word": normal(WORD_ROWS, INPUT, by=0.1), "gram": normal(GRAM_ROWS, INPUT, by=0.1)}
        for d in "fb":
            p |= {f"w{d}": normal(2 * INPUT, 3 * HIDDEN, by=0.25), f"u{d}": normal(HIDDEN, 3 * HIDDEN, by=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        p |= {"a": normal(2 * HIDDEN, by=0.3), "o": normal(2 * HIDDEN, by=0.3), "bias": np.array([np.log(base / (1 - base))], np.float32)}
        return Network(p)

    def project(self, x: Inputs, heard: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Inputs of the distinct words, and their share in the gates of both directions; row -1 is no word."""
        sums = np.add.reduceat(self.p["gram"][x.gram], np.minimum(x.gram_first[:-1], max(0, len(x.gram) - 1))) if len(x.gram) else np.zeros((len(x.word), INPUT), np.float32)
        own = self.p["word"][x.word]
        if heard is not None:
            own = own * heard[:, None]
        seen = np.concatenate([own, sums / np.maximum(1, np.diff(x.gram_first))[:, None].astype(np.float32)], 1)
        seen = np.concatenate([seen, np.zeros((1, 2 * INPUT), np.float32)]).astype(np.float32)
        return seen, {d: seen @ self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"}

    def run(self, tokens: np.ndarray, gates: dict[str, np.ndarray], keep: bool = False):
        """Logits of windows.  tokens: (windows, steps) numbers of words, -1 for none."""
        p, (n, steps) = self.p, tokens.shape
        there = tokens >= 0
        states, tape = np.empty((steps, n, 2 * HIDDEN), np.float32), {}
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h = np.zeros((n, HIDDEN), np.float32)
            u, g, half = p[f"u{d}"], gates[d], slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            for t in order:
                x = g[tokens[:, t]]
                hu = h @ u
                zr = _sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
                new = h + z * (c - h)
                new = np.where(there[:, t, None], new, h)
                if keep:
                    tape[d, t] = (h, z, r, c, hu[:, 2 * HIDDEN :])
                h = new
                states[t, :, half] = h
        e = states @ p["a"]
        e[~there.T] = -1e9
        e -= e.max(0)
        np.exp(e, out=e)
        e *= there.T
        e /= np.maximum(e.sum(0), np.float32(1e-9))
        pooled = np.einsum("tn,tnh->nh", e, states)
        logit = pooled @ p["o"] + p["bias"][0]
        return (logit, states, e, pooled, tape) if keep else logit

    def gradients(self, tokens: np.ndarray, x: Inputs, seen: np.ndarray, gates: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss over windows."""
        p, (n, steps) = self.p, tokens.shape
        logit, states, e, pooled, tape = self.run(tokens, gates, keep=True)
        there = (tokens >= 0)[:, :, None]
        dl = ((_sigmoid(logit) - y) * weight / max(1.0, float(weight.sum()))).astype(np.float32)
        g = {"o": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["o"]
        ds = e[:, :, None] * dpool[None]
        de = np.einsum("tnh,nh->tn", states, dpool)
        de = e * (de - (e * de).sum(0))
        g["a"] = np.einsum("tn,tnh->h", de, states)
        ds += de[:, :, None] * p["a"]
        dseen = np.zeros_like(seen)
        for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            u = p[f"u{d}"]
            gu, dgate, dh = np.zeros_like(u), np.zeros_like(gates[d]), np.zeros((n, HIDDEN), np.float32)
            for t in order:
                h, z, r, c, hc = tape[d, t]
                dh = dh + ds[t][:, half]
                on = there[:, t]
                live = dh * on
                dz, dc = live * (c - h) * z * (1 - z), live * z * (1 - c * c)
                dr = dc * hc * r * (1 - r)
                dx = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                np.add.at(dgate, tokens[:, t], dx)
                gu += h.T @ du
                dh = dh * (1 - on) + live * (1 - z) + du @ u.T
            g[f"u{d}"], g[f"c{d}"], g[f"w{d}"] = gu, dgate[:-1].sum(0), seen.T @ dgate
            dseen += dgate @ p[f"w{d}"].T
        g["word"] = np.zeros_like(p["word"])
        np.add.at(g["word"], x.word, dseen[:-1, :INPUT])
        size = np.diff(x.gram_first)
        g["gram"] = np.zeros_like(p["gram"])
        np.add.at(g["gram"], x.gram, np.repeat(dseen[:-1, INPUT:] / np.maximum(1, size)[:, None], size, axis=0))
        return g

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The score of each text: that of its worst window."""
        x = inputs(texts)
        _, gates = self.project(x)
        counts = np.diff(x.first)
        start, length, doc = window_starts(counts, x.first)
        out = np.full(len(counts), -np.inf, np.float32)
        at = np.append(x.at, -1)
        for k in range(0, len(start), BATCH):
            tokens = tokens_of(at, start[k : k + BATCH], length[k : k + BATCH])
            np.maximum.at(out, doc[k : k + BATCH], self.run(tokens, gates))
        return 1.0 / (1.0 + np.exp(-out.astype(np.float64)))


def tokens_of(at: np.ndarray, start: np.ndarray, length: np.ndarray, window: int = WINDOW) -> np.ndarray:
    step = np.arange(window)
    where = np.minimum(start[:, None] + step, len(at) - 1)
    return np.where(step < length[:, None], at[where], -1)


def train(texts: list[str], y: np.ndarray, epochs: int = 5, rate: float = 0.01, group: int = 64, seed: int = 7, decay: float = 0.5, drop: float = 0.5) -> Network:
    """Multiple-instance training with Adam and decaying weights; classes weigh as they occur.

    A word's own vector is left out of a step with chance ``drop``, so that rare
    words of mislabelled documents are not learned by heart.
    """
    base = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.05
    net = Network.new(seed, base)
    if len(y) == 0 or y.min() == y.max():
        net.p["o"][:] = 0
        return net
    r = np.random.default_rng(seed)
    one = {k: np.zeros_like(v) for k, v in net.p.items()}
    two = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for k in range(0, len(order), group):
            rows = order[k : k + group]
            x = inputs(pa.array([texts[i] for i in rows], pa.large_string()))
            seen, gates = net.project(x, r.random(len(x.word)) >= drop)
            start, length, doc = window_starts(np.diff(x.first), x.first)
            at = np.append(x.at, -1)
            logit = np.concatenate([net.run(tokens_of(at, start[j : j + BATCH], length[j : j + BATCH]), gates) for j in range(0, len(start), BATCH)])
            # learn from the worst window of each document
            ranked = np.lexsort((-logit, doc))
            begins = np.searchsorted(doc[ranked], np.arange(len(rows)))
            top = ranked[begins]
            tokens = tokens_of(at, start[top], length[top])
            g = net.gradients(tokens, x, seen, gates, y[rows].astype(np.float32), np.ones(len(rows), np.float32))
            step += 1
            for name, v in net.p.items():
                d = g[name]
                one[name] += 0.1 * (d - one[name])
                two[name] += 0.001 * (d * d - two[name])
                if name in ("word", "gram"):
                    v *= np.float32(1 - rate * decay)
                v -= (rate * (1 - 0.9 * epoch / epochs) * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network:
    rows = labelled_sample(docs, labels, "toxic", sample, sample_bytes, ~held_out(F.col("doc_id"))).toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    texts = rows["text"].to_pylist()
    return train([texts[i] or "" for i in order], rows["toxic"].to_numpy()[order].astype(float))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    net = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample, sample_bytes))

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for a, b, texts in W.slices(batch.column("text")):
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "score": net.value.scores(texts)}

    return arrow_map(text_rows(docs), run, "doc_id long, score double").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
