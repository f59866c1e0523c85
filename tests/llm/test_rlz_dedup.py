import random

import numpy as np
import pytest
from brute import op12
from pyspark.sql import functions as F

from strandgraph.llm import rlz_dedup as R


def compared(docs, **options):
    """The operator against the plain version, rows and all."""
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit("")), F.octet_length(F.coalesce("text", F.lit("")))).alias("o"), "text").collect()
    want = op12([tuple(r) for r in keyed], options.get("window", 20))
    got = [tuple(r) for r in R.rlz_dedup(docs, keep_text=False, **options).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return want


def repetitive(seed=3):
    """Few words, so that windows overlap, repeat within a text and meet at many borders."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(12)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(18, 60))] for _ in range(6)]
    rows = []
    for k in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p))))
            words += rng.choice([p, p[a:b], [rng.choice(pool) for _ in range(rng.randint(0, 9))], p[:19], p[:20], p[-20:]])
        rows.append((k * 2, (" ", "\n", "\t ")[k % 3].join(words)))
    rows += [(500, "same " * 70), (501, "same " * 20), (502, "same " * 19), (503, "a b " * 40), (504, None), (505, ""), (506, " \n "), (507, rows[3][1]), (None, rows[4][1]), (507, rows[3][1])]
    rows += [(508, "é\x1c x " * 30), (600, " ".join(f"v{i % 700}" for i in range(6000)))]
    return rows


@pytest.mark.parametrize(("seed", "options"), [(3, {}), (4, {"hot": 3, "block_bytes": 300}), (5, {"gram": 2, "block_bytes": 2000}), (6, {"window": 16, "gram": 16}), (7, {"window": 29, "gram": 5, "hot": 0})])
def test_like_plain_version(spark, seed, options):
    want = compared(spark.createDataFrame(repetitive(seed), "doc_id long, text string").repartition(3), **options)
    assert sum(0 < r[2] < r[1] for r in want) > 10


def test_fixture_and_messy(spark, docs, messy, nothing):
    compared(docs)
    compared(messy)
    assert R.op12_rlz_dedup(nothing).count() == 0


def test_kept_text_and_spans(spark):
    shared = " ".join(f"s{i}" for i in range(25))
    docs = spark.createDataFrame([(1, "a " + shared + "\nb"), (2, shared + " c  d"), (3, shared.replace("s24", "x"))], "doc_id long, text string")
    got = {r.doc_id: r for r in R.rlz_dedup(docs).collect()}
    assert [got[k].kept for k in (1, 2, 3)] == ["a " + shared + " b", "c d", "x"]
    assert [got[k].spans for k in (1, 2, 3)] == [[], [[0, 25]], [[0, 24]]]
    with pytest.raises(ValueError, match="window"):
        R.rlz_dedup(docs, window=40)


def test_longest_earlier_match():
    rng = np.random.default_rng(2)
    for alphabet in (2, 3, 40):
        sizes = np.array([50, 1, 90, 33])
        words = rng.integers(0, alphabet, sizes.sum()).astype(np.uint64)
        words[60:100] = words[5:45]
        words[140:170] = words[62:92]
        reference = R.Reference(words, sizes)
        text, at = [], 0
        for k, n in enumerate(sizes):
            text += [*words[at : at + n].tolist(), -1 - k]
            at += n

        def longest(i, text=text):
            best = 0
            for j in range(i):
                n = 0
                while i + n < len(text) and text[j + n] == text[i + n]:
                    n += 1
                best = max(best, n)
            return min(best, R.DEPTH)

        asked = np.arange(len(text))
        assert reference.match(asked).tolist() == [longest(i) for i in asked]


def test_family_of_near_copies(spark):
    """One passage in all documents, each with an edit of its own: what goes to blocks stays near the size of one text a task."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for k in range(400):
        words = list(base)
        words[rng.randrange(300)] = f"edit{k}"
        rows.append((k, f"head{k} " + " ".join(words)))
    want = compared(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=64, block_bytes=1 << 16)
    assert sum(r[2] for r in want) > 0.8 * sum(r[1] for r in want)
