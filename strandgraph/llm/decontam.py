"""Benchmark decontamination by winnowing.

A window is ``window`` consecutive words of a benchmark item (an item with
fewer words, but not none, is one window of its own length).  Of every
``window - gram + 1`` consecutive gram hashes the smallest (the last of equals)
is a fingerprint, so each window holds one, and a document passage equal to a
window has the same fingerprint at the same place.  Document fingerprints are
joined with the benchmark's; a hit is extended to all windows around it, and
each word of a window that the benchmark has is marked.  Windows shorter than
``window`` are looked up by length, so they too are found everywhere.

The benchmark is cut into blocks of at most ``block_bytes`` by a hash of the
item; a block's tables travel with the task and documents pass the blocks one
after another, without a shuffle.  So what is broadcast is bounded however
large the benchmark is; between every ``blocks_per_pass`` blocks the documents
are checkpointed.

Null and empty texts have no words and no hits; null or empty items have no
windows; items without an id are searched too, but not named; repeated
documents give repeated rows; repeated items count once each id; an empty
benchmark leaves every document clean.  A text of any length is searched whole,
in memory that grows with that text alone.  Other columns pass through; a clash
with an output name is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bytesops as B
from .sparkops import bounded_batches

#: Bytes of words: digits, letters, and all of non-ASCII characters.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True


def hashed_words(data, offsets, powers):
    starts, ends, rows = B.word_spans(data, offsets, WORD)
    return B.span_hashes(data, starts, ends, B.LOWER_VALUES, powers), rows


class Windows:
    """Windows of one length -> the items that have them (CSR over sorted distinct hashes)."""

    def __init__(self, hashes: np.ndarray, items: np.ndarray) -> None:
        order = np.lexsort((items, hashes))
        hashes, items = hashes[order], items[order]
        keep = np.ones(len(hashes), bool)
        keep[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
        hashes, self.items = hashes[keep], items[keep]
        self.set = B.HashSet(hashes)
        self.first = np.searchsorted(hashes, self.set.table, side="left")
        self.last = np.searchsorted(hashes, self.set.table, side="right")

    def items_of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.set.table, np.unique(hashes))
        return np.unique(np.concatenate([self.items[a:b] for a, b in zip(self.first[at], self.last[at], strict=True)])) if len(at) else np.zeros(0, np.int64)


class Index:
    """Fingerprints and windows of one block of the benchmark."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, gram: int) -> None:
        self.ids, self.window, self.gram = ids, window, gram
        column = pa.array(texts, pa.large_string())
        words, rows = hashed_words(*B.text_bytes(column), B.Powers())
        counts = np.bincount(rows, minlength=len(ids))
        long = counts[rows] >= window
        w, r = words[long], rows[long]
        full = B.gram_valid(r, window)
        self.full = Windows(B.gram_hashes(w, window)[full], r[: len(full)][full])
        prints, at = fingerprints(w, r, window, gram)
        self.prints = B.HashSet(prints[at])
        self.short = {}
        for n in sorted({*counts[(counts > 0) & (counts < window)].tolist()}):
            mine = counts[rows] == n
            w, r = words[mine], rows[mine]
            valid = B.gram_valid(r, n)
            self.short[n] = Windows(B.gram_hashes(w, n)[valid], r[: len(valid)][valid])

    def find(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, hashes) of the windows that the benchmark has."""
        found = []
        n = self.window
        prints, at = fingerprints(words, rows, n, self.gram)
        seeds = at[self.prints.positions(prints[at])]
        if len(seeds):
            around = np.unique((seeds[:, None] - np.arange(n - self.gram + 1)).ravel())
            around = around[(around >= 0) & (around <= len(words) - n)]
            around = around[rows[around] == rows[around + n - 1]]
            total = np.zeros(len(around), np.uint64)
            for j in range(n):
                total *= np.uint64(B._BASE)
                total += words[around + j]
            hashes = B.mix64(total + np.uint64(n))
            hit = self.full.set.positions(hashes)
            found.append((n, around[hit], hashes[hit]))
        for n, table in self.short.items():
            valid = np.flatnonzero(B.gram_valid(rows, n))
            hashes = B.gram_hashes(words, n)[valid]
            hit = table.set.positions(hashes)
            found.append((n, valid[hit], hashes[hit]))
        return found

    def table(self, n: int) -> Windows:
        return self.full if n == self.window else self.short[n]


def fingerprints(words, rows, window, gram):
    """(gram hashes, places of the winnowed ones); a gram over a row's border is never one."""
    prints, valid = B.gram_hashes(words, gram), B.gram_valid(rows, gram)
    span = window - gram + 1
    at = B.sliding_min_last(prints, span)
    inside = B.gram_valid(rows, window)[: len(at)]
    at = np.unique(at[: len(inside)][inside])
    return prints, at[valid[at]] if len(at) else at


def decontaminate(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, gram: int = 5, block_bytes: int = 32 << 20, blocks_per_pass: int = 4) -> DataFrame:
    """docs with n_words, n_hit, hit_spans array<struct<start,end>> (words, end exclusive) and items array<string>, sorted.

    ``hit_spans`` are the maximal runs of marked words, by which a caller can
    cut a passage as well as drop a document.
    """
    bounded_batches(docs.sparkSession)
    outputs = ["n_words", "hit_spans", "items"]
    if clash := {*outputs, "n_hit"} & {*docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    span = T.ArrayType(T.LongType())
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", span), T.StructField("items", T.ArrayType(T.StringType()))])
    items = bench.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    total = items.agg(F.sum(F.coalesce(F.octet_length("t"), F.lit(0)) + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    at = docs.columns.index(text)
    width = len(docs.columns)
    columns = [*docs.columns, *outputs]
    out = docs
    for k in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k)
        rows = part.toArrow()
        index = Index(rows["i"].to_pylist(), rows["t"].to_pylist(), window, gram)

        def run(batches: Iterator[pa.RecordBatch], index: Index = index, first: bool = k == 0) -> Iterator[pa.RecordBatch]:
            powers = B.Powers()
            for batch, data, offsets in B.pieces(batches, at):
                words, rows = hashed_words(data, offsets, powers)
                n = batch.num_rows
                counts = np.bincount(rows, minlength=n)
                firsts = np.concatenate([[0], np.cumsum(counts)])
                found = index.find(words, rows)
                marks = np.zeros(len(words) + 1, np.int64)
                for size, places, _ in found:
                    np.add.at(marks, places, 1)
                    np.add.at(marks, places + size, -1)
                hit = np.cumsum(marks[:-1]) > 0
                names: dict[int, set] = {}
                for size, places, hashes in found:
                    order = np.argsort(rows[places], kind="stable")
                    owner, sorted_hashes = rows[places][order], hashes[order]
                    edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(owner) else np.zeros(0, np.int64)
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        names.setdefault(int(owner[a]), set()).update(index.ids[i] for i in index.table(size).items_of(sorted_hashes[a:b]) if index.ids[i] is not None)
                old_spans = None if first else batch.column(width + 1).to_pylist()
                old_items = None if first else batch.column(width + 2).to_pylist()
                spans, listed = [], []
                touched = np.zeros(n, bool)
                touched[rows[hit]] = True
                for row in range(n):
                    own = None
                    if touched[row]:
                        own = hit[firsts[row] : firsts[row + 1]]
                    if not first and old_spans[row]:
                        own = np.zeros(counts[row], bool) if own is None else own.copy()
                        for a, b in zip(old_spans[row][::2], old_spans[row][1::2], strict=True):
                            own[a:b] = True
                    if own is None:
                        spans.append([])
                    else:
                        edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                        spans.append(np.flatnonzero(edge).tolist())
                    got = names.get(row, set())
                    if not first:
                        got = got.union(old_items[row])
                    listed.append(sorted(got))
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(listed, pa.list_(pa.string()))], names=columns)

        out = out.mapInArrow(run, schema)
        if k % blocks_per_pass == blocks_per_pass - 1 and k < blocks - 1:
            out = out.checkpoint()
    # The flat list alternates starts and ends.
    pairs = F.expr(
        """if(size(hit_spans) = 0, cast(array() as array<struct<start:bigint,end:bigint>>),
              transform(sequence(0, cast(size(hit_spans) div 2 as int) - 1),
                        i -> named_struct('start', hit_spans[2 * i], 'end', hit_spans[2 * i + 1])))"""
    )
    return out.withColumn("hit_spans", pairs).withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]))


def op3_decontamination(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = decontaminate(docs.select("doc_id", "text"), bench)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
