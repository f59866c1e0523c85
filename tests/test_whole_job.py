"""Cases that an operator once left out."""

import math
import os
import random

import pytest

from strandgraph.operators import search


def nearest(vectors, queries, k):
    def cosine(a, b):
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return 0.0 if len(a) != len(b) or norm == 0 else sum(x * y for x, y in zip(a, b, strict=True)) / norm

    return sorted((q, r, key, round(s, 9)) for q, w in queries for r, (s, key) in enumerate(sorted(((-round(cosine(v, w), 12), key) for key, v in vectors))[:k], 1) for s in [-s])


def test_vector_search_in_blocks(spark, monkeypatch):
    """Blocks of three, two partitions of queries, ties, zero vectors and other lengths."""
    monkeypatch.setattr(search, "QUERIES_A_TASK", 8)
    rng = random.Random(2)
    vectors = [(i, [float(rng.randint(-2, 2)) for _ in range(3 if i % 7 else 2)]) for i in range(700)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    asked = df.filter("vec_id % 50 = 0").selectExpr("vec_id as q", "embedding")
    got = search.vector_search_many(df, asked, "vec_id", "q", k=4).collect()
    assert sorted((r["q"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == nearest(vectors, [x for x in vectors if x[0] % 50 == 0], 4)


def test_vector_search_null_vectors(spark):
    vectors = [(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = search.vector_search_many(df, df.filter("vec_id = 1").selectExpr("vec_id as q", "embedding"), "vec_id", "q").collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 1, 1.0), (2, 4, 0.0), (3, 2, None), (4, 3, None)]


def test_vector_search_takes_many_queries(spark):
    queries = spark.range(10_050).selectExpr("id as q", "array(1.0D, cast(id as double)) as embedding")
    vectors = queries.filter("q < 5").withColumnRenamed("q", "vec_id")
    assert search.vector_search_many(vectors, queries, "vec_id", "q", k=2).count() == 20_100


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_vector_top_k_takes_every_hundredth(spark):
    import __spark_entry__ as e

    vectors = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((r["q"], r["rank"], r["vec_id"], r["score"]) for r in e.queries()["vector_top_k_hundredths"](spark, SF).collect())
    want = nearest(vectors, [x for x in vectors if x[0] % 100 == 0], 5)
    assert [r[:3] for r in got] == [r[:3] for r in want] and all(math.isclose(a[3], b[3], abs_tol=1e-5) for a, b in zip(got, want, strict=True))
