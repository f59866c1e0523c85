import random

import numpy as np
import pytest
from brute import one_edit, op11

from strandgraph.llm import spelling as S


def texts():
    """Frequent words with rare edits, chains of forms, long and accented words, and families around one prefix."""
    rng = random.Random(5)
    letters = "abcdeé"
    edit = lambda w: (lambda i, c: rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]]))(rng.randrange(len(w)), rng.choice(letters))
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 12))) for _ in range(25)] + ["government", "aaaaaaa", "aaaaaaaa", "ababababab", "z" * 3000]
    bag = []
    for k, w in enumerate(words):
        bag += [w] * (200 if k % 3 == 0 else 12)
        bag += [e for _ in range(6) for e in [edit(w)] * rng.choice((1, 2, 2, 13))]
    bag += [e for w in [edit(x) for x in bag[::40]] for e in (w, w)]
    bag += ["Prefixes" + a + b for a in letters for b in letters for _ in range(2)]
    bag += ["chainedwords"] * 700 + ["chainedwordx"] * 45 + ["chainedworxx"] * 4
    bag += [w.upper() for w in bag[::7]] + ["É" + "abcdefgh", "éabcdefgh"] * 3
    rng.shuffle(bag)
    rows = [(k, ("%s, " * len(part)) % tuple(part)) for k, part in enumerate(bag[i : i + 60] for i in range(0, len(bag), 60))]
    return [*rows, (None, "government governmen7t goverment goverment"), (7000, None), (7001, ""), (7002, "1 2 ×÷ abc"), rows[0], (7003, "zzzz" * 40_000), (7004, "zzzz" * 40_000)]


def rows_of(df):
    return sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()), key=str)


@pytest.mark.parametrize("group", [1 << 14, 6])
def test_like_plain_version(spark, group):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = op11(rows)
    got = rows_of(S.spelling_variants(docs, group=group))
    assert got == sorted(want, key=str)
    # The fixture holds what the rule is about.
    assert any(w[1] and w[1] != w[2] for w in want) and any(not w[1] and w[4] for w in want) and max(w[4] for w in want) >= 10


@pytest.mark.parametrize("chunk", [40, 1 << 20])
def test_many_chunks_and_batches(spark, chunk, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = texts()[:60]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(S.op11_spelling(docs)) == sorted(op11(rows), key=str)


def test_points_in_a_rectangle():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 100):
        values = rng.permutation(n)
        low, least = rng.integers(0, n, 50), rng.integers(0, n, 50)
        high, most = low + rng.integers(0, n, 50), least + rng.integers(0, n + 2, 50)
        high = np.minimum(high, n)
        q, v = S.WaveletTree(values).report(low, high, least, most)
        want = sorted((k, int(x)) for k in range(50) for x in values[low[k] : high[k]] if least[k] <= x < most[k])
        assert sorted(zip(q.tolist(), v.tolist(), strict=True)) == want


def test_every_pair_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice((4, 5)))) for _ in range(60)})
    a, b, _ = S.near_pairs(words, 4, 0, 5)
    found = sorted((words[x], words[y]) for x, y in zip(a, b, strict=True))
    want = [(x, y) for x in words for y in words if one_edit(x, y) and not len(x) == len(y) == 5]
    assert found == sorted(want)


def test_empty_and_messy(spark, nothing, messy):
    assert S.op11_spelling(nothing).count() == 0
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    assert rows_of(S.op11_spelling(messy)) == sorted(op11(rows), key=str)
