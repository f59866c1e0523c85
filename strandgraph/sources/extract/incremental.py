"""Extraction that parses only what changed.

A live table holds a digest of each file and the records that it gave.  An
update compares digests, runs the producers over new and changed files alone,
and replaces the records of these and of vanished files in one commit; the
graph is folded from all records.  A file counts as changed too when it comes
to lie in another service, since its records name their service.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ...functions import weights
from ...operators.graph import Graph, materialise
from ...schema import struct
from ...streaming.live import Kind, LiveTable, replace
from .run import RECORDS, assign, build, discover, errors, extract_records

FILES = struct("file string, digest string")
KINDS = {
    "files": Kind(FILES, "file", replace("file", "digest")),
    "records": Kind(struct(", ".join(" ".join(f.split()) for f in RECORDS.split(","))), "file", replace("file", "kind")),
}


@dataclass(frozen=True)
class Update:
    """What an update did: files parsed, and files whose records went."""

    parsed: int
    removed: int


class SourceTree:
    """The records of a source tree, kept up to date file by file."""

    def __init__(self, spark: SparkSession, path: str, parts: int = 16) -> None:
        self.table = LiveTable(spark, path, parts, KINDS, feed=False)

    def update(self, files: DataFrame) -> Update:
        """Bring the table to the tree of files (path, content); manifests alone are read every time, to find the services."""
        placed = assign(files, discover(files))
        named = placed.withColumns({"file": F.concat_ws("/", "service", "path"), "digest": F.sha2(F.coalesce("content", F.lit("")), 256)})
        now = materialise(named.select("file", "digest"))
        known = self.table.read("files")
        changed = materialise(now.join(known, ["file", "digest"], "left_anti"))
        gone = materialise(known.join(now, "file", "left_anti").select("file"))
        parsed, removed = changed.count(), gone.count()
        if parsed or removed:
            found = extract_records(named.join(changed.select("file"), "file", "left_semi"))
            # Rows with nothing but a file take its earlier records away.
            emptied = changed.select("file").union(gone)
            of = KINDS["records"].schema
            blank = emptied.select(*(F.col("file") if f.name == "file" else F.lit(None).cast(f.dataType).alias(f.name) for f in of.fields))
            digests = changed.unionByName(gone.withColumn("digest", F.lit(None).cast("string")))
            at = self.table.current()
            self.table.commit(0 if at is None else at + 1, {"files": digests, "records": blank.unionByName(found.select(*of.names))})
        return Update(parsed, removed)

    def graph(self, floor: float = weights.PRECISION_FLOOR) -> tuple[Graph, DataFrame, DataFrame]:
        """(graph, rejected edges, errors), as ``extract`` gives them for the whole tree."""
        records = self.table.read("records")
        graph, rejected = build(records, floor)
        return graph, rejected, errors(records)
