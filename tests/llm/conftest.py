import hashlib
import random
import re

import pytest

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text): copies, near copies, shared passages, one common line, nulls, empty and long texts."""
    r = random.Random(11)
    vocabulary = ["w%d" % i for i in range(60)] + ["É%d" % i for i in range(20)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    line, passage = say(18), say(40)
    base = say(120)
    rows = []
    for i in range(150):
        kind = i % 6
        if kind == 0:
            text = list(base)
            for _ in range(r.randrange(4)):
                text[r.randrange(len(text))] = r.choice(vocabulary)
        elif kind == 1:
            text = say(r.randrange(1, 60)) + passage[r.randrange(10) : r.randrange(25, 40)] + say(20)
        elif kind == 2:
            text = say(r.randrange(30)) + line + say(r.randrange(30))
        elif kind == 3:
            text = say(r.randrange(1, 16))
        elif kind == 4:
            text = rows[i - 4][1].split() if rows[i - 4][1] else []
        else:
            text = ["Is", "so."] * r.randrange(40)
        rows.append((1000 - i * 3 if i % 2 else i, ("  " if i % 7 == 0 else "\n" if i % 5 == 0 else " ").join(text)))
    rows += [(2000, None), (2001, ""), (2002, " \n "), (2003, " ".join(say(6000))), (None, " ".join(passage)), (2004, " ".join(passage)), (2004, " ".join(passage))]
    return rows
