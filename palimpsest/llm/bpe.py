"""Exact byte-pair encoding by per-prefix dynamic programming.

For every prefix of a piece of text, byte-pair encoding has exactly one last
token.  It is found without merging anything: a suffix automaton over the
vocabulary, streamed along the piece, gives the tokens that end at each byte,
longest first; the first of them that the encoding of the text before it can be
followed by is the last token.  Whether two tokens may stand side by side is
decided by taking their merges apart (``Vocabulary.compatible``).  Back-pointers
from the end give the ids.

Pieces are those of the tokenizer's own pre-tokenizer, so the automaton walks
over words, and equal pieces are encoded once per worker (a bounded cache).
Texts never meet other texts: there is no shuffle, and a lost task is simply run
again.  Null and empty texts have no tokens.  Special tokens written out in a
text are recognised, as the tokenizer does.  A text's memory is its own length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from palimpsest.llm import words as W
from palimpsest.llm.frames import arrow_map, text_rows
from palimpsest.llm.suffix_automaton import SuffixAutomaton
from palimpsest.llm.workers import resident

CACHE = 1 << 18
SPACE_CLASS = r"\t-\r\x20\x85\xa0  -     　"
#: The pieces of the byte-level pre-tokenizer, its white space spelled out.
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE_CLASS}\p{{L}}\p{{N}}]+|[{SPACE_CLASS}]+(?![^{SPACE_CLASS}])|[{SPACE_CLASS}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _check(told: dict, path: str) -> None:
    """Refuse a tokenizer file that asks for more than byte-level pairs: its ids would come out wrong in silence."""
    model, before = told.get("model") or {}, told.get("pre_tokenizer") or {}
    wrong = {
        "model.type": model.get("type") not in (None, "BPE"),
        "normalizer": told.get("normalizer") is not None,
        "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True),
        "decoder": (told.get("decoder") or {}).get("type") != "ByteLevel",
        "added_tokens": any(t.get(f) for t in told.get("added_tokens") or [] for f in ("single_word", "lstrip", "rstrip")),
        **{f"model.{f}": bool(model.get(f)) for f in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")},
    }
    if any(wrong.values()):
        raise ValueError(f"{path} asks for what this encoder does not do: {', '.join(k for k, v in wrong.items() if v)}")


class Vocabulary:
    """Tokens, merges and the automaton of one byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        _check(told, path)
        letters = byte_letters()
        ids = told["model"]["vocab"]
        self.bytes = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        self.ids = {s: i for i, s in self.bytes.items()}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair: rank, token
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            one, two, both = ids[a], ids[b], ids[a + b]
            self.merge[one, two] = rank, both
            if both not in self.parts:
                self.parts[both], self.rank[both] = (one, two), rank
        self.added = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.size = max([*self.bytes, *self.added.values()]) + 1
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.automaton = SuffixAutomaton(list(self.ids))
        # tokens that end in a state, by length, longest first; only tokens that encode to themselves count
        found: dict[int, list[tuple[int, int]]] = {}
        for s, i in self.ids.items():
            found.setdefault(self.automaton.state(s), []).append((len(s), i))
        self.at = {k: sorted(v, reverse=True) for k, v in found.items()}
        # of each state, the tokens that end there, its own and those of the states behind it
        order = sorted(range(len(self.automaton.link)), key=self.automaton.length.__getitem__)
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(order)
        for k in order[1:]:
            behind = self.ending[self.automaton.link[k]]
            self.ending[k] = (*self.at[k], *behind) if k in self.at else behind
        self.pairs: dict[int, bool] = {}
        # pieces seen lately, and those seen before them: what is used again moves back to the front
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        sizes = np.zeros(self.size + 1, np.int64)
        spelled = [self.bytes.get(i, b"") for i in range(self.size)]
        for content, i in self.added.items():
            spelled[i] = content.encode()
        sizes[1:] = np.cumsum([len(s) for s in spelled])
        self.offsets, self.letters = sizes, np.frombuffer(b"".join(spelled), np.uint8)

    def compatible(self, one: int, two: int) -> bool:
        """Whether byte-pair encoding of the two tokens' text is the two tokens.

        The later of the two merges is undone again and again.  A merge over the
        boundary that comes before the merges that made its neighbours would have
        happened first, and then the two tokens would never have stood there.
        """
        key = one << 32 | two
        limit, ok = 1 << 62, True
        while True:
            if (hit := self.merge.get((one, two))) and hit[0] < limit:
                ok = False
                break
            a, b = self.rank.get(one, -1), self.rank.get(two, -1)
            if a > b:
                limit = a
                one = self.parts[one][1]
                if (hit := self.merge.get((one, two))) and hit[0] < limit:
                    ok = False
                    break
            elif b >= 0:
                limit = b + 1
                two = self.parts[two][0]
                if (hit := self.merge.get((one, two))) and hit[0] < limit:
                    ok = False
                    break
                limit = b
            else:
                break
        if len(self.pairs) >= CACHE:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of a piece, from the unique last token of every prefix."""
        step, link, length, ending = self.automaton.next, self.automaton.link, self.automaton.length, self.ending
        pairs, compatible = self.pairs, self.compatible
        last: list[int] = []
        state = matched = 0
        for i, c in enumerate(piece):
            q = step[state].get(c)
            while q is None:
                if not state:
                    raise ValueError("the vocabulary lacks a byte of this text")
                state = link[state]
                matched = length[state]
                q = step[state].get(c)
            state, matched = q, matched + 1
            for n, token in ending[state]:
                if n > matched:
                    continue
                if n > i:
                    last.append(token)
                    break
                key = last[i - n] << 32 | token
                ok = pairs.get(key)
                if ok is None:
                    ok = compatible(last[i - n], token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
        out, i = [], len(piece) - 1
        while i >= 0:
            out.append(last[i])
            i -= len(self.bytes[last[i]])
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        cache, found = self.cache, []
        for k, part in enumerate(self.special.split(text) if self.special and any(x in text for x in self.added) else [text]):
            if k % 2:
                found.append(self.added[part].to_bytes(4, "little"))
                continue
            pieces = _PIECES.findall(part)
            ids = list(map(cache.get, pieces))
            if None in ids:
                for i, piece in enumerate(pieces):
                    if ids[i] is None:
                        ids[i] = self._seen(piece)
                cache = self.cache
            found += ids
        return b"".join(found)

    def _seen(self, piece: str) -> bytes:
        """The ids of a piece that is not in the cache, which then has it if it is short."""
        if (ids := self.cache.get(piece) or self.older.get(piece)) is None:
            out = self.encode_piece(piece.encode())
            ids = pack(f"<{len(out)}I", *out)
        if len(piece) <= 64:
            if len(self.cache) >= CACHE:
                self.older, self.cache = self.cache, {}
            self.cache[piece] = ids
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids, special tokens written out; invalid UTF-8 becomes U+FFFD."""
        first, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        ends = np.cumsum(size)
        where = np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        raw = self.letters[where].tobytes()
        try:
            raw.decode()
        except UnicodeDecodeError:
            return raw.decode(errors="replace").encode()
        return raw


_PIECES = regex.compile(PIECES)


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, built once per worker and stage."""
    return resident(path, lambda: Vocabulary(path))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text of every document."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        v = vocabulary(path)
        for a, b, texts in W.slices(batch.column("text"), 1 << 20):
            ids = [np.frombuffer(v.encode(t), "<u4") if t else np.empty(0, "<u4") for t in texts.to_pylist()]
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "ids": pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())), "decoded": pa.array([v.decode(x.astype(np.int64)).decode() for x in ids])}

    return arrow_map(text_rows(docs), run, "doc_id long, ids array<bigint>, decoded string", keeps=True)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text, digested where they are made."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        v = vocabulary(path)
        for a, b, texts in W.slices(batch.column("text"), 1 << 20):
            n, of_ids, of_text = [], [], []
            for t in texts.to_pylist():
                raw = v.encode(t) if t else b""
                n.append(len(raw) // 4)
                of_ids.append(hashlib.sha256(raw).hexdigest())
                of_text.append(hashlib.sha256(v.decode(np.frombuffer(raw, "<u4").astype(np.int64))).hexdigest())
            yield {"doc_id": batch.column("doc_id").slice(a, b - a), "n_tokens": np.array(n, np.int64), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}

    return arrow_map(text_rows(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", keeps=True)
