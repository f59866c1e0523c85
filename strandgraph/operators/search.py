"""Search over nodes: by substring and by embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block in vector_search_many, and queries of one of its partitions.
BLOCK, QUERIES_A_TASK = 256, 4096

#: Fields of each type that describe a node in words, besides id and name.
DESCRIBED = {
    "ServiceNode": ("language", "framework", "platform", "owner"),
    "DatabaseNode": ("engine", "engineVersion", "host"),
    "ConfigNode": ("path", "fileType"),
    "InfraNode": ("provider", "kind", "region"),
    "FileNode": ("service", "path", "language"),
    "RouteNode": ("service", "method", "pathTemplate", "framework"),
    "GraphQLOperationNode": ("service", "operationType", "operationName"),
    "GrpcMethodNode": ("rpcService", "rpcMethod"),
    "WebSocketChannelNode": ("service", "channel"),
    "SymbolNode": ("service", "relPath", "qualname", "kind"),
    "ServerActionNode": ("service", "module", "exportName"),
    "FrontierNode": ("host",),
}


def embed_text(nodes: DataFrame) -> DataFrame:
    """(id, embedText, digest): what an embedder sees, and a digest that tells whether it changed."""
    have = {*nodes.columns}
    parts: list[Column] = [F.col("id"), F.col("name")]
    for kind, fields in DESCRIBED.items():
        parts += [F.when((F.col("type") == kind) & F.col(f).isNotNull(), F.concat(F.lit(f + "="), F.col(f).cast("string"))) for f in fields if f in have]
    text = F.concat_ws(" ", *parts)
    return nodes.select("id", text.alias("embedText"), F.substring(F.sha1(text), 1, 16).alias("digest"))


def changed(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """Texts that a cache (id, digest) does not have, to be embedded anew."""
    return texts.join(cache.select("id", "digest"), ["id", "digest"], "left_anti")


def refreshed(cache: DataFrame, texts: DataFrame, embedded: DataFrame) -> DataFrame:
    """The cache without vanished or changed entries, and with the newly embedded ones."""
    return cache.join(texts.select("id", "digest"), ["id", "digest"], "left_semi").unionByName(embedded)


def substring_search(nodes: DataFrame, query: str, limit: int | None = 10) -> DataFrame:
    """Nodes whose id or name contains the query, by id."""
    q = F.lit(query.lower())
    hit = nodes.filter(F.contains(F.lower("id"), q) | F.coalesce(F.contains(F.lower("name"), q), F.lit(False))).select("id", "type", "name", F.lit(1.0).alias("score")).orderBy("id")
    return hit if limit is None else hit.limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double; 0 for different lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def vector_search(vectors: DataFrame, query: list[float], key: str = "id", embedding: str = "embedding", k: int = 10, frontier: DataFrame | None = None) -> DataFrame:
    """The k nearest by cosine: each task keeps its own k, only these meet."""
    if frontier is not None:
        vectors = vectors.join(frontier.select(key), key, "left_anti")
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, cosine(F.col(embedding), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, vector) rows as lists of BLOCK of them at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            ends = pa.array([0, part.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, c) for c in part.columns], names=batch.schema.names)


def _matrices(vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the rows with such a vector, the vectors, and whether one has a null in it."""
    sizes = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten()
    values, holes = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    first = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    out = {}
    for n in np.unique(sizes[sizes >= 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        at = first[rows][:, None] + np.arange(n)
        out[n] = rows, values[at].astype(np.float64), holes[at].any(axis=1)
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, added up in the order of ``cosine``, so that sums are the same to the last bit."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for d in range(a.shape[-1]):
        total += a[..., d] * b[..., d]
    return total


def _nearest(k: int, names: list[str]):
    """The k nearest vectors of a block to each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                wanted, queries, keys, vectors = (c[i].values for c in batch.columns)
                order = pc.sort_indices(keys)
                keys, vectors = keys.take(order), vectors.take(order)
                score = np.zeros((len(wanted), len(keys)))
                unknown = queries.is_null().to_numpy(zero_copy_only=False)[:, None] | vectors.is_null().to_numpy(zero_copy_only=False)
                there = _matrices(vectors)
                for n, (rows, q, q_holes) in _matrices(queries).items():
                    if n in there:
                        columns, v, v_holes = there[n]
                        with np.errstate(all="ignore"):
                            norm = np.sqrt(_dot(q, q))[:, None] * np.sqrt(_dot(v, v))
                            cos = _dot(q[:, None], v[None]) / norm
                        score[np.ix_(rows, columns)] = np.where(norm == 0, 0.0, cos)
                        unknown[np.ix_(rows, columns)] |= q_holes[:, None] | v_holes
                # Keys ascend and the sort is stable, so ties go to the smaller key; NaN is the largest, null the last.
                rank = np.where(unknown, np.inf, np.where(np.isnan(score), -np.inf, -score))
                best = np.argsort(rank, axis=1, kind="stable")[:, :k]
                told = pa.array(np.take_along_axis(score, best, 1).ravel(), mask=np.take_along_axis(unknown, best, 1).ravel())
                yield pa.RecordBatch.from_arrays([wanted.take(pa.array(np.repeat(np.arange(len(wanted)), best.shape[1]))), keys.take(pa.array(best.ravel())), told], names=names)

    return run


def vector_search_many(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, embedding: str = "embedding", k: int = 10) -> DataFrame:
    """The k nearest of each of any number of queries, exact.

    Blocks of queries meet blocks of vectors; a pair of blocks keeps k rows for
    each query, each partition k of these, and only they are shuffled.
    """
    parts = max(1, -(-queries.count() // QUERIES_A_TASK))
    pack = lambda df, name: df.select(F.col(name), F.col(embedding).cast("array<double>").alias("v"))
    listed = lambda df, name, a, b: T.StructType([T.StructField(a, T.ArrayType(df.schema[name].dataType)), T.StructField(b, T.ArrayType(T.ArrayType(T.DoubleType())))])
    left = pack(vectors, key).mapInArrow(_packed, listed(vectors, key, "keys", "vectors"))
    right = pack(queries, query_key).repartition(parts).mapInArrow(_packed, listed(queries, query_key, "wanted", "queries"))
    pairs = left.crossJoin(right).select("wanted", "queries", "keys", "vectors")
    out = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    near = pairs.mapInArrow(_nearest(k, [query_key, key, "score"]), out)
    place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc_nulls_last("score"), F.asc_nulls_last(key)))
    return near.withColumn("rank", place).filter(F.col("rank") <= k).select(query_key, "rank", key, "score")


def hashed_embedding(text: Column, dims: int = 64) -> Column:
    """A fallback embedder without a model: counts of hashed words, in built-in functions.

    Any function of a text column that gives array<double> can stand in its
    place (a pandas UDF over a served model, for instance).
    """
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
