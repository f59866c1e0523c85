"""Alignment of two tokenizers by elementary intervals.

The ends of a text's A tokens and of its B tokens cut its bytes into
elementary intervals: ``union1d`` of both end arrays gives the cuts,
``searchsorted`` finds the A token and the B token that own each interval, and
each interval is one overlap of the two.  Where both end, a group closes; the
tokens of a group cover the same bytes.  Links are pairs of tokens of one
group: all that overlap (``overlaps``), the group's whole product
(``products``), or those that end together (``ends``).

A is a byte-level BPE whose words take at most one leading space; B is a BPE
with white-space markers.  In front of a single space between two printable
Latin characters neither has a token that crosses, so a text is cut there, and
each task aligns a distinct chunk once and joins what it found by position.
The table of chunks is bounded by ``table_entries``; when full it starts anew
with the chunks that came more than once, which changes no result.

Counts of id pairs over the whole corpus come from counts of chunks.  Sums over
a document's links look up the most frequent pairs (at most ``frequent``, a
proven bound) in a table that travels with the tasks; the other links, each of
a rare pair, are joined with their counts, so no key is hot.

Null and empty texts, and texts that B does not give back byte for byte (those
that hold U+2581), have no tokens.  Very long texts are cut into chunks like
others; one without spaces is a single chunk.  Rows that share a doc_id or a
text are counted one by one.  An empty table gives an empty result.  Other
columns pass through; a clash with an output name is refused.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sentencepiece_table import check_model, load
from .sparkops import bounded_batches, shared_dir

#: Printable Latin characters: between two of them a single space begins a chunk.
LATIN = "!-~¡-ɏ"
UNSAFE = re.compile(f"[^{LATIN}] | [^{LATIN}]")
CUT = re.compile(f"(?<=[{LATIN}]) (?=[{LATIN}])")
OUTPUTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
#: B ids take the low bits of a pair's code.
SHIFT = 20
#: The table also starts anew after chunks of so many characters.
CHARS = 16 << 20


def byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes are themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def token_bytes_a(spec: dict) -> list[bytes]:
    """Bytes of each id of a byte-level BPE; of special tokens, their string's."""
    of, vocab = byte_level(), spec["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens") or [])]))
    for piece, i in vocab.items():
        out[i] = bytes(of[c] for c in piece) if all(c in of for c in piece) else piece.encode()
    for token in spec.get("added_tokens") or []:
        out[token["id"]] = token["content"].encode()
    return out


def token_bytes_b(sp) -> list[bytes]:
    """Bytes of each piece: a marker is a space, <0xHH> one byte."""
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())]


def check_byte_level(spec: dict) -> None:
    """Refuse an A tokenizer that could join bytes over a space, or change them."""
    bad = []
    if spec["model"].get("type") != "BPE" or spec["model"].get("dropout"):
        bad.append("it is not a BPE model")
    pre = spec.get("pre_tokenizer") or {}
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        bad.append("it does not split words at their leading space")
    if spec.get("normalizer") or spec["model"].get("continuing_subword_prefix") or spec["model"].get("end_of_word_suffix"):
        bad.append("it changes texts")
    if bad:
        raise ValueError("chunks do not fit this tokenizer: " + "; ".join(bad))


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, group, closes) of each elementary interval; both end arrays ascend and have the same last value."""
    cuts = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
    closes = (ends_a[a] == cuts) & (ends_b[b] == cuts)
    return a, b, np.concatenate([[0], np.cumsum(closes)[:-1]]), closes


def linked(a: np.ndarray, b: np.ndarray, closes: np.ndarray, kind: str = "ends") -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked A and B tokens, from the intervals that ``align`` found."""
    if kind == "ends":
        return a[closes], b[closes]
    if kind == "overlaps":
        return a, b
    # The product of each group: every A token beside every B token.
    last = np.flatnonzero(closes)
    first = np.concatenate([[0], last[:-1] + 1])
    a0, b0 = a[first], b[first]
    na, nb = a[last] - a0 + 1, b[last] - b0 + 1
    which = np.repeat(np.arange(len(last)), na * nb)
    within = np.arange(len(which)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
    return a0[which] + within // nb[which], b0[which] + within % nb[which]


def links(ends_a: np.ndarray, ends_b: np.ndarray, kind: str = "ends") -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked A and B tokens of one text."""
    a, b, _, closes = align(ends_a, ends_b)
    return linked(a, b, closes, kind)


class Chunks:
    """Distinct chunk -> its tokens, groups and links."""

    def __init__(self, a_json: str, b_model: bytes, entries: int, kind: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a_json), load(b_model)
        self.a.encode_special_tokens = True
        self.bytes_a, self.bytes_b = token_bytes_a(json.loads(a_json)), token_bytes_b(self.b)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.entries, self.kind = entries, kind
        # How an id is told: an A id within its group or last in it, then a B id.
        self.told = [f"{i}{end}" for size, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(size)]
        self.start([])

    def start(self, kept: list[int]) -> None:
        """A new table, with some of the chunks of the one before."""
        keys = [*self.at] if kept else []
        groups, codes = ([x[k] for k in kept] for x in (self.groups, self.codes)) if kept else ([], [])
        #: A tokens, B tokens, groups, links, whether the bytes differ
        numbers = np.zeros((max(1024, 2 * len(kept)), 5), np.int64)
        if kept:
            numbers[: len(kept)] = self.numbers[kept]
        self.at: dict[str, int] = {keys[k]: i for i, k in enumerate(kept)}
        self.groups: list[str] = groups
        self.codes: list[bytes] = codes
        self.numbers, self.seen = numbers, np.zeros(len(numbers), np.int64)
        self.chars = sum(map(len, self.at))

    def clear(self) -> None:
        """Start anew with the chunks that came twice or more, if they are no more than half a table."""
        kept = np.flatnonzero(self.seen > 1).tolist()
        self.start(kept if len(kept) <= self.entries // 2 and self.chars <= CHARS else [])

    def keys_of(self, text: str) -> list[str]:
        """The chunks of space+text, each without its leading space."""
        if UNSAFE.search(text) or text[0] == " " or text[-1] == " ":
            return CUT.split(text)
        return text.split(" ")

    def add(self, new: list[str]) -> None:
        """Align chunks that the table lacks, many in one pass."""
        if not new:
            return
        marked = [" " + c for c in new]
        ids_a = [e.ids for e in self.a.encode_batch_fast(marked, add_special_tokens=False)]
        ids_b = self.b.encode(new, num_threads=1)
        flat_a, flat_b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(new)) for ids in (ids_a, ids_b))
        of_a, of_b = np.repeat(np.arange(len(new)), n_a), np.repeat(np.arange(len(new)), n_b)
        own = [c.encode() for c in marked]
        sizes = np.fromiter(map(len, own), np.int64, len(new))
        whole = b"".join(own)
        bad = np.zeros(len(new), bool)
        for table, size, flat, of, ids in ((self.bytes_a, self.size_a, flat_a, of_a, ids_a), (self.bytes_b, self.size_b, flat_b, of_b, ids_b)):
            # Equal as a whole and in every chunk's length: equal in every chunk.
            if not (np.array_equal(np.bincount(of, size[flat], len(new)), sizes) and b"".join(map(table.__getitem__, flat.tolist())) == whole):
                bad |= np.array([b"".join(map(table.__getitem__, i)) != o for i, o in zip(ids, own, strict=True)])
        # Bad chunks stay in the table, but their tokens are not aligned.
        if bad.any():
            flat_a, of_a, flat_b, of_b = flat_a[~bad[of_a]], of_a[~bad[of_a]], flat_b[~bad[of_b]], of_b[~bad[of_b]]
            n_a[bad], n_b[bad] = 0, 0
        numbers = np.zeros((len(new), 5), np.int64)
        numbers[:, 0], numbers[:, 1], numbers[:, 4] = n_a, n_b, bad
        groups, codes = [""] * len(new), [b""] * len(new)
        if len(flat_a):
            a, b, _, closes = align(np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b]))
            numbers[:, 2] = np.bincount(of_a[a[closes]], minlength=len(new))
            la, lb = linked(a, b, closes, self.kind)
            numbers[:, 3] = np.bincount(of_a[la], minlength=len(new))
            pairs = ((flat_a[la] << SHIFT) | flat_b[lb]).tobytes()
            edges = [0, *np.cumsum(8 * numbers[:, 3]).tolist()]
            codes = [pairs[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)]
            shut_a, shut_b = np.zeros(len(flat_a), bool), np.zeros(len(flat_b), bool)
            shut_a[a[closes]], shut_b[b[closes]] = True, True
            # An A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its own too.
            before_a, before_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
            all_a, all_b = np.append(0, np.flatnonzero(shut_a) + 1), np.append(0, np.flatnonzero(shut_b) + 1)
            told = np.empty(len(flat_a) + len(flat_b), np.int64)
            told[np.arange(len(flat_a)) + all_b[before_a]] = flat_a + len(self.bytes_a) * shut_a
            told[np.arange(len(flat_b)) + all_a[before_b + 1]] = 2 * len(self.bytes_a) + flat_b + len(self.bytes_b) * shut_b
            words = [*map(self.told.__getitem__, told.tolist())]
            edges = [0, *np.cumsum(n_a + n_b).tolist()]
            groups = ["".join(words[x:y])[:-1] for x, y in zip(edges[:-1], edges[1:], strict=True)]
        self.chars += sum(map(len, new))
        first = len(self.groups)
        self.at.update(zip(new, range(first, first + len(new)), strict=True))
        self.groups += groups
        self.codes += codes
        while len(self.numbers) < len(self.groups):
            self.numbers = np.concatenate([self.numbers, np.zeros_like(self.numbers)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.numbers[first : len(self.groups)] = numbers

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, links) of all documents since the table started."""
        used = np.flatnonzero(self.seen)
        if not len(used):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pairs = np.frombuffer(b"".join([self.codes[k] for k in used.tolist()]), np.int64)
        codes, place = np.unique(pairs, return_inverse=True)
        return codes, np.bincount(place, np.repeat(self.seen[used], self.numbers[used, 3]), len(codes)).astype(np.int64)


def _chunked(a_json: str, b_model: bytes, entries: int, kind: str, text: str, columns: list[str]):
    """The columns of a row with its numbers, its groups' digest and its links; or, without them, a pair and its count."""
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.int64(), pa.int64()]
    names = [*columns, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_links", "_pair", "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, types = Chunks(a_json, b_model, entries, kind), []

        def counted() -> Iterator[pa.RecordBatch]:
            codes, n = table.counts()
            for k in range(0, len(codes), 1 << 16):
                part = codes[k : k + (1 << 16)]
                nothing = [pa.nulls(len(part), t) for t in types] + [pa.nulls(len(part), t) for t in kinds[:6]]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array(part), pa.array(n[k : k + (1 << 16)])], names=names)

        for whole in batches:
            types = [whole.schema.field(c).type for c in columns]
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                keys = [table.keys_of(t) if t else [] for t in batch.column(text).to_pylist()]
                new = set().union(*keys)
                new.difference_update(table.at)
                if len(table.at) + len(new) > entries or table.chars > CHARS:
                    yield from counted()
                    table.clear()
                    new = set().union(*keys)
                    new.difference_update(table.at)
                new = [*new]
                for j in range(0, len(new), 20_000):
                    table.add(new[j : j + 20_000])
                told, held, sums = [], [], np.zeros((len(keys), 4), np.int64)
                for i, own in enumerate(keys):
                    places = [*map(table.at.__getitem__, own)]
                    numbers = table.numbers[places].sum(0) if places else np.zeros(5, np.int64)
                    if not places or numbers[4]:
                        told.append("")
                        held.append(b"")
                        continue
                    sums[i] = numbers[:4]
                    np.add.at(table.seen, places, 1)
                    told.append(hashlib.sha256(";".join(map(table.groups.__getitem__, places)).encode()).hexdigest())
                    held.append(b"".join(map(table.codes.__getitem__, places)))
                nothing = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(sums[:, j]) for j in range(4)), pa.array(told), pa.array(held, pa.binary()), nothing, nothing], names=names)
        yield from counted()

    return run


def _looked_up(frequent, links_at: int):
    """The row's columns with n_best and count_sum over its frequent pairs, and its other pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = (np.frombuffer(x, t) for x, t in zip(frequent.value, (np.int64, np.int64, np.bool_), strict=True))
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                held = batch.column(links_at).to_pylist()
                sizes = np.array([len(h) // 8 for h in held], np.int64)
                pairs = np.frombuffer(b"".join(held), np.int64)
                distinct, place = np.unique(pairs, return_inverse=True)
                where = np.minimum(np.searchsorted(codes, distinct), max(len(codes) - 1, 0))
                there = codes[where] == distinct if len(codes) else np.zeros(len(distinct), bool)
                n = np.where(there, counts[where], 0)[place] if len(codes) else np.zeros(len(pairs), np.int64)
                top = (there & best[where])[place] if len(codes) else np.zeros(len(pairs), bool)
                edges = np.concatenate([[0], np.cumsum(sizes)])
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (top.astype(np.int64), n)]
                rare = ~there[place]
                others = [pairs[x:y][rare[x:y]] for x, y in zip(edges[:-1], edges[1:], strict=True)]
                kept = [c for i, c in enumerate(batch.columns) if i != links_at]
                names = [c for i, c in enumerate(batch.schema.names) if i != links_at]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(s[edges[1:]] - s[edges[:-1]]) for s in sums), pa.array(others, pa.list_(pa.int64()))], names=[*names, "n_best", "count_sum", "_rare"])

    return run


def align_tokens(docs: DataFrame, a_json: str, b_model: bytes, text: str = "text", kind: str = "ends", keep_text: bool = True, table_entries: int = 300_000, frequent: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(docs with OUTPUTS, pairs): pairs has a_id, b_id, n (links in the whole corpus) and best.

    a_json: a byte-level BPE in the form of the tokenizers library; b_model: a
    SentencePiece BPE model.  ``kind`` of links: ends, overlaps or products.
    Without ``keep_text`` the text column is left out.
    """
    spark = docs.sparkSession
    if clash := {*OUTPUTS, "_links", "_pair", "_n", "_rare", "_row"} & {*docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    check_byte_level(json.loads(a_json))
    if not check_model(b_model)["prefix"]:
        raise ValueError("B does not add a leading space")
    bounded_batches(spark)
    base = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    kinds = [T.LongType()] * 4 + [T.StringType(), T.BinaryType(), T.LongType(), T.LongType()]
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if keep_text or f.name != text])
    made = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "_links", "_pair", "_n")
    schema = T.StructType([*kept.fields, *(T.StructField(n, k) for n, k in zip(made, kinds, strict=True))])
    run = _chunked(a_json, b_model, table_entries, kind, text, kept.names)
    rows.mapInArrow(run, schema).write.option("compression", "zstd").parquet(f"{base}/rows")
    stored = spark.read.parquet(f"{base}/rows")

    pair = F.col("_pair")
    counted = stored.filter(pair.isNotNull()).groupBy("_pair").agg(F.sum("_n").alias("n")).withColumn("b_id", pair.bitwiseAND((1 << SHIFT) - 1))
    counted.write.parquet(f"{base}/counted")
    counted = spark.read.parquet(f"{base}/counted")
    most = counted.groupBy("b_id").agg(F.max("n").alias("most"))
    counted.join(most, "b_id").select("_pair", F.shiftright(pair, SHIFT).alias("a_id"), "b_id", "n", (F.col("n") == F.col("most")).alias("best")).write.parquet(f"{base}/pairs")
    pairs = spark.read.parquet(f"{base}/pairs")

    # The least count of which no more than ``frequent`` pairs have as many: one histogram row for each eighth of an octave.
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int").alias("level")
    total, least = 0, 1 << 20
    for row in sorted(pairs.groupBy(level).count().collect(), reverse=True):
        total += row["count"]
        if total > frequent:
            break
        least = row["level"]
    table = pairs.filter(level >= least).select("_pair", "n", "best").orderBy("_pair").toArrow()
    parts = [table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("_pair", "n", "best")]
    shipped = spark.sparkContext.broadcast(tuple(p.tobytes() for p in parts))

    rows = stored.filter(pair.isNull()).drop("_pair", "_n")
    out = T.StructType([*(f for f in rows.schema.fields if f.name != "_links"), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("_rare", T.ArrayType(T.LongType()))])
    done = rows.mapInArrow(_looked_up(shipped, rows.columns.index("_links")), out)
    if total > frequent:
        done.write.option("compression", "zstd").parquet(f"{base}/done")
        done = spark.read.parquet(f"{base}/done")
        rare = done.select("_row", F.explode("_rare").alias("_pair")).join(pairs.filter(level < least).select("_pair", "n", "best"), "_pair")
        rest = rare.groupBy("_row").agg(F.sum("n").alias("_sum"), F.sum(F.col("best").cast("long")).alias("_best"))
        done = done.join(rest, "_row", "left").withColumns({"count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("_best", F.lit(0))})
    return done.select(*(c for c in docs.columns if keep_text or c != text), *OUTPUTS), pairs.drop("_pair")


def op13_token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Per document: doc_id and OUTPUTS."""
    with open(a_path) as f:
        a_json = f.read()
    with open(b_path, "rb") as f:
        b_model = f.read()
    rows, _ = align_tokens(docs.select("doc_id", "text"), a_json, b_model, keep_text=False)
    return rows
