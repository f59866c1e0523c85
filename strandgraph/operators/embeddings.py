"""Embeddings of nodes, kept beside a digest of the text they were made of.

A refresh embeds only nodes whose text is new or changed; vanished nodes leave.
Search runs over the stored vectors, frontiers left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import struct
from ..streaming.live import Kind, LiveTable, replace
from . import search
from .graph import Graph, materialise

VECTORS = struct("id string, digest string, embedding array<double>, version long")


class EmbeddingCache:
    """Vectors of a graph's nodes; ``embed`` makes them of texts (a model behind a pandas UDF, or the hashed fallback)."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = search.hashed_embedding, parts: int = 16) -> None:
        self.embed = embed
        self.table = LiveTable(spark, path, parts, {"vectors": Kind(VECTORS, "id", replace("id", "digest"))}, feed=False)

    def vectors(self) -> DataFrame:
        """(id, digest, embedding, version): version is the refresh that embedded the node."""
        return self.table.read("vectors")

    def refresh(self, graph: Graph) -> int:
        """Bring the vectors to the graph's nodes; how many were embedded."""
        texts = search.embed_text(graph.nodes.filter("type <> 'FrontierNode'"))
        known = self.vectors()
        fresh = materialise(search.changed(texts, known))
        gone = known.join(texts.select("id"), "id", "left_anti").select("id")
        at = self.table.current()
        version = 0 if at is None else at + 1
        rows = fresh.select("id", "digest", self.embed(F.col("embedText")).alias("embedding"), F.lit(version).cast("long").alias("version"))
        left = gone.select("id", *(F.lit(None).cast(f.dataType).alias(f.name) for f in VECTORS.fields[1:]))
        self.table.commit(version, {"vectors": rows.unionByName(left)})
        return fresh.count()

    def search(self, questions: DataFrame, k: int = 10) -> DataFrame:
        """(q, rank, id, score) of the k nodes nearest to each question (q, question)."""
        asked = questions.select("q", self.embed(F.col("question")).alias("embedding"))
        return search.vector_search_many(self.vectors(), asked, "id", "q", k=k)
