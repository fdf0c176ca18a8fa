import random
import re

import numpy as np
import pyarrow as pa

from palimpsest.llm import words as W

random.seed(4)
TEXTS = ["", "a", " a  b\t\nc ", "é ü　x", "A-b c1 <x>"] + ["".join(random.choices("ab é\n\t漢Z09-\x0b", k=random.randrange(80))) for _ in range(300)]


def test_words_and_hashes():
    for pattern, table, lower in ((r"[^\x20\x09-\x0D]+", W.SPACES, False), (r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", W.ALNUM, True)):
        seen = {}
        for _, _, part in W.slices(pa.array([*TEXTS, None]), 50):
            found = W.split(part, table, lower)
            hashes = found.hashes()
            for i, text in enumerate(part.to_pylist()):
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "") if lower else text or ""
                own = [bytes(found.data[a:b]).decode() for a, b in zip(found.start[found.first[i] : found.first[i + 1]], found.end[found.first[i] : found.first[i + 1]], strict=True)]
                assert own == re.findall(pattern, text)
                for w, h in zip(own, hashes[found.first[i] : found.first[i + 1]].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_windows_stay_inside():
    first = np.array([0, 3, 3, 10, 12])
    ok = W.inside(first, 3, 10)
    assert np.flatnonzero(ok).tolist() == [0, 3, 4, 5, 6, 7]


def test_slices_cover_all():
    column = pa.array(["x" * n for n in (0, 5, 200, 1, 1, 1)])
    got = [(a, b) for a, b, _ in W.slices(column, 6)]
    assert got[0][0] == 0 and got[-1][1] == 6 and all(x[1] == y[0] for x, y in zip(got, got[1:], strict=False))
    assert list(W.slices(pa.array([], pa.string()))) == []
