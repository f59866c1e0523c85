import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make_docs():
    """Small documents with copies, near copies, shared passages and lines, junk and odd texts."""
    rng = random.Random(11)
    words = ["the", "of", "and", "Über", "ñandú", "x1", "lo-rem", "ip", "dolor", "sit", "Amet", "cons"] + [f"w{i}" for i in range(150)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    shared = [line(14) for _ in range(4)]
    passage = line(70)
    texts = [None, "", "a", "one two", " \t\n ", "x" * 300, "é" * 120, "ab\x00cd" * 40, "one two three four"]
    base = []
    for _ in range(45):
        lines = [line(rng.randint(3, 20)) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            lines.insert(rng.randint(0, len(lines)), rng.choice(shared))
        if rng.random() < 0.3:
            lines[rng.randint(0, len(lines) - 1)] += " " + passage
        base.append("\n".join(lines))
    texts += base
    for t in base[:12]:
        texts.append(t)
        w = t.split(" ")
        w[rng.randint(0, len(w) - 1)] = "EDITED"
        texts.append(" ".join(w))
        texts.append(t + " tail of words that is new")
    texts.append("long " + " ".join(line(12) for _ in range(2500)))
    texts.append("Mail a.b@c.example.org, ip 10.0.0.256 and 10.0.0.25; card 4111 1111 1111 1111, tel +1 (212) 555-0100. IBAN GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 a@b.c_d@e.f")
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def plain():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, plain):
    rows = [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in plain]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def messy(spark, plain):
    """Nulls everywhere, repeated rows, ties of ids, and a clashing extra column."""
    rows = [(d, t, None, None, None, "extra") for d, t in plain[:20]] + [(None, "no id but some words here", None, None, None, None), (None, None, None, None, None, None), (None, "no id but some words here", "xx", "y", 1, "e")]
    rows += rows[:5] + [(rows[6][0], "same id, another text", "en", "s", 3, None)]
    return spark.createDataFrame(rows, DOCS + ", label string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
