"""Substring dedup of words by relative Lempel-Ziv parsing.

A word is removed if a window of ``window`` words that covers it also starts
earlier: in a smaller document, or in the same one before it.

1. Every window has an anchor: of its ``gram``-word substrings the one with the
   least hash (the last of equals).  Equal windows have equal anchors at equal
   places.  Anchors' hashes are dealt by value, and only anchors that occur
   twice in the corpus stay.
2. The words that the windows of a remaining anchor cover are a stretch; it goes
   to the reference block of its anchor.  Of equal stretches in a task, only
   the first goes; it is earlier than the others, whose words are removed.
3. A block indexes its stretches, in the order of the corpus, by a suffix array
   with ranks of 1, 2, 4, ... 32 words, and factors every stretch greedily
   against what starts earlier: from each place the longest earlier match (32
   words at most), found beside it in the suffix array, then on behind it.
4. A factor of ``window`` words or more is a duplicate span.  A window that
   holds a whole factor and the next word occurs nowhere earlier, so what is
   left are windows across the border of two factors which together are longer
   than a window; they are looked up one by one.
5. Spans go, packed, to the part their document is in, and from there to the
   texts.

An anchor with very many stretches (``hot`` and more than 1/32 of its block)
would fill one block; each of its windows is a stretch of its own, dealt by its
own hash, so that equal ones collapse and the others spread.

Words are runs without ASCII white space, as UTF-8 bytes, compared by 64-bit
hashes; nulls and empty texts have none.  Equal texts are one document, held by
the smallest doc_id; copies with a larger one lose all if they have ``window``
words.  Repeated rows get equal results; rows that share a doc_id but not the
text are two documents, in the order of their hashes.  A null doc_id comes after
all others.  A very long text is one row of a task; its stretches are dealt like
others.  An empty table gives an empty result.  Columns other than id and text
are not carried, so no name clashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .sparkops import bounded_batches, checkpoint
from .suffix_dedup import LAST, Answers, _gather, _names

_U = np.uint64
IS_WORD = np.ones(256, bool)
IS_WORD[[*range(9, 14), 32]] = False
#: Factors are not longer than this, and windows not longer than half as much again.
DEPTH = 32


def stretches(data: np.ndarray, offsets: np.ndarray, window: int, gram: int, powers: B.Powers):
    """(words, first word of each row, row, start, windows, anchor hash) of the texts' anchors; starts count in ``words``."""
    starts, ends, rows = B.word_spans(data, offsets, IS_WORD)
    words = B.span_hashes(data, starts, ends, B.BYTE_VALUES, powers)
    heads = np.searchsorted(rows, np.arange(len(offsets)))
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return words, heads, none, none, none, np.zeros(0, _U)
    grams = B.gram_hashes(words, gram)
    at = B.sliding_min_last(grams, window - gram + 1)
    valid = np.flatnonzero(B.gram_valid(rows, window))
    at = at[valid]
    # Windows of one anchor follow each other.
    new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 0) | (np.diff(valid) != 1)])) if len(at) else np.zeros(0, np.int64)
    return words, heads, rows[valid[new]], valid[new], np.diff(np.append(new, len(at))), grams[at[new]]


def _emit_names(window: int, gram: int, buckets: int):
    """Step 1, first half: (bucket, docs, slots, names), packed; docs and slots as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, count = B.Powers(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, name, doc = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.lexsort((doc, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = order[edges[k] : edges[k + 1]]
                used, slots = np.unique(doc[own], return_inverse=True)
                parts = np.diff(used, prepend=0), np.diff(slots, prepend=0).astype(np.uint8), name[own]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["bucket", "docs", "slots", "names"])

        for batch, data, offsets in B.pieces(batches, 1):
            _, _, rows, _, _, hashes = stretches(data, offsets, window, gram, powers)
            bucket, name = _names(hashes, buckets)
            held.append((bucket.astype(np.int32), name, batch.column(0).to_numpy()[rows]))
            count += len(rows)
            if count > 1_500_000:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return run


def _shared(least_hot: int):
    """Step 1, second half: (doc, name) of anchors that occur twice; bit 0 of name tells very frequent ones.

    Rows come sorted by bucket, so one bucket is held at a time.
    """

    def shared(bucket: int, parts: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        docs = np.concatenate([np.cumsum(np.frombuffer(d, np.int64))[np.cumsum(np.frombuffer(s, np.uint8), dtype=np.int64)] for d, s, _ in parts])
        names = np.concatenate([np.frombuffer(n, np.uint32) for _, _, n in parts])
        order = np.lexsort((docs, names))
        docs, names = docs[order], names[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        times = np.diff(np.append(first, len(names)))
        times = np.repeat(times, times)
        # A document that has an anchor more than once is told once.
        stay = (times > 1) & np.concatenate([[True], (names[1:] != names[:-1]) | (docs[1:] != docs[:-1])])
        hot = times > max(least_hot, len(names) // 32)
        docs, code = docs[stay], ((np.int64(bucket) << 33) | (names.astype(np.int64) << 1) | hot)[stay]
        for at in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(docs[at : at + (1 << 16)]), pa.array(code[at : at + (1 << 16)])], names=["doc", "name"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, docs, slots, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and parts:
                    yield from shared(now, parts)
                    parts = []
                now = bucket
                parts.append((docs, slots, names))
        if parts:
            yield from shared(now, parts)

    return run


def wanted(names: pa.Array, code: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has, hot): which anchors (code, row) are in the rows' lists of names, and which of them are hot there."""
    none = np.zeros(len(code), bool)
    listed = names.flatten().to_numpy()
    if not len(listed):
        return none, none
    where = np.repeat(np.arange(len(names)), np.asarray(names.value_lengths().fill_null(0)))
    table = B.mix64((listed >> 1).astype(_U) ^ B.mix64(where.astype(_U)))
    by = np.argsort(table)
    table, hot = table[by], (listed & 1).astype(bool)[by]
    asked = B.mix64((code >> 1).astype(_U) ^ B.mix64(rows.astype(_U)))
    at = np.searchsorted(table, asked)
    at[at == len(table)] = 0
    has = table[at] == asked
    return has, has & hot[at]


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after the other."""
    return np.arange(lengths.sum()) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _emit_stretches(window: int, gram: int, buckets: int):
    """Step 2: (block, run) of packed stretches, and (part, found) of what the task settles itself."""
    names_out = ["bucket", "run", "part", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, answers, held, total = B.Powers(), Answers(buckets), [], 0

        def row(bucket, blob, part, found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([part], pa.int32()), pa.array([found], pa.binary())], names=names_out)

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, doc, key, start, size, mark = (np.concatenate([h[i] for h in held]) for i in range(6))
            words = np.concatenate([h[6] for h in held])
            place = np.cumsum(size) - size
            # Equal stretches have equal marks; the first in the order of the corpus stays.
            order = np.lexsort((start, key, doc, mark))
            new = np.concatenate([[True], mark[order][1:] != mark[order][:-1]])
            first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            own = (doc[order] == doc[first]) & (key[order] == key[first]) & (start[order] == start[first])
            copy = order[~own]
            if len(copy) and answers.add(doc[copy], key[copy], start[copy], start[copy] + size[copy]):
                yield from told()
            go = order[new]
            go = go[np.argsort(bucket[go], kind="stable")]
            edges = np.searchsorted(bucket[go], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                mine = go[edges[k] : edges[k + 1]]
                head = np.stack([doc[mine], key[mine], start[mine], size[mine]])
                yield row(k, np.int64(len(mine)).tobytes() + head.tobytes() + words[ranges(place[mine], size[mine])].tobytes(), None, None)

        def told() -> Iterator[pa.RecordBatch]:
            for part, found in answers.flush():
                yield row(None, None, part, found)

        def hold(words, rows, starts, sizes, bucket, doc, key, heads) -> None:
            nonlocal total
            taken = words[ranges(starts, sizes)]
            # A stretch's mark is a hash of its words, whatever its place.
            powers.reserve(len(taken) + 1)
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(taken * powers.up[: len(taken)])])
            ends = np.cumsum(sizes)
            mark = B.mix64((sums[ends] - sums[ends - sizes]) * powers.down[ends - sizes] + sizes.astype(_U))
            if bucket is None:
                bucket = ((mark >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            held.append((bucket, doc[rows], key[rows], starts - heads[rows], sizes, mark, taken))
            total += len(taken)

        for batch, data, offsets in B.pieces(batches, 2):
            words, heads, rows, starts, windows, hashes = stretches(data, offsets, window, gram, powers)
            bucket, name = _names(hashes, buckets)
            has, hot = wanted(batch.column(3), (bucket << 33) | (name.astype(np.int64) << 1), rows)
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            plain = has & ~hot
            hold(words, rows[plain], starts[plain], windows[plain] + window - 1, bucket[plain], doc, key, heads)
            if hot.any():
                each = ranges(starts[hot], windows[hot])
                hold(words, np.repeat(rows[hot], windows[hot]), each, np.full(len(each), window), None, doc, key, heads)
            if total > 1_500_000:
                yield from flush()
                held.clear()
                total = 0
        if total:
            yield from flush()
        yield from told()

    return run


class Reference:
    """Words of a block's stretches behind each other, with a suffix array that tells the longest earlier match of a place."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray) -> None:
        _, ids = np.unique(words, return_inverse=True)
        least = int(ids.max()) + 1 if len(ids) else 0
        self.ends = np.cumsum(sizes) + np.arange(len(sizes))
        self.starts = self.ends - sizes
        text = np.empty(len(words) + len(sizes), np.int64)
        text[ranges(self.starts, sizes)] = ids
        # Each stretch ends in a word of its own, so no match goes on behind it.
        text[self.ends] = least + np.arange(len(sizes))
        self.n = len(text)
        self.ranks = [text.astype(np.int32)]
        self.early: np.ndarray | None = None
        size, rank = 1, text
        while size < DEPTH:
            after = np.zeros(self.n, np.int64)
            after[: self.n - size] = rank[size:] if size < self.n else 0
            _, first, rank = np.unique(rank * np.int64(self.n + 1) + after, return_index=True, return_inverse=True)
            size *= 2
            self.ranks.append(rank.astype(np.int32))
            if size == DEPTH // 2:
                #: Places whose next 16 words also start earlier.
                self.early = first[rank] < np.arange(self.n)
                if not self.early.any():
                    return
        self.order = np.argsort(rank, kind="stable")
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        self.size = 1 << max(1, (self.n - 1).bit_length())
        self.tree = np.full(2 * self.size, self.n, np.int64)
        self.tree[self.size : self.size + self.n] = self.order
        at = self.size
        while at > 1:
            self.tree[at // 2 : at] = np.minimum(self.tree[at : 2 * at : 2], self.tree[at + 1 : 2 * at : 2])
            at //= 2

    def _beside(self, asked: np.ndarray, right: bool) -> np.ndarray:
        """For each place the nearest one in the suffix array on one side that starts earlier in the text; -1 if there is none."""
        node, found = self.place[asked] + self.size, np.zeros(len(asked), np.int64)
        live = np.arange(len(asked))
        step = 1 if right else -1
        while len(live):
            here = node[live]
            turn = ((here & 1) == (0 if right else 1)) & (here > 1)
            hit = turn & (self.tree[np.where(turn, here + step, 1)] < asked[live])
            found[live[hit]] = here[hit] + step
            node[live] = here >> 1
            live = live[~hit & (here > 1)]
        live = np.flatnonzero((found > 0) & (found < self.size))
        while len(live):
            near = 2 * found[live] + (0 if right else 1)
            found[live] = np.where(self.tree[near] < asked[live], near, near ^ 1)
            live = live[found[live] < self.size]
        return np.where(found > 0, self.tree[np.maximum(found, 1)], -1)

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common words from the places a and b on, at most DEPTH; none where b is -1."""
        out = np.zeros(len(a), np.int64)
        able = b >= 0
        for k in range(len(self.ranks) - 1, -1, -1):
            x, y = np.minimum(a + out, self.n - 1), np.minimum(b + out, self.n - 1)
            out += ((self.ranks[k][x] == self.ranks[k][y]) & able & (out < DEPTH)).astype(np.int64) << k
        return out

    def match(self, asked: np.ndarray) -> np.ndarray:
        """Length of the longest match that starts earlier."""
        return np.maximum(self._common(asked, self._beside(asked, False)), self._common(asked, self._beside(asked, True)))

    def spans(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of places that windows with an earlier start cover; factors first, then windows at their borders."""
        none = np.zeros(0, np.int64)
        if not self.early.any():
            return none, none
        places = np.flatnonzero(self.early)
        # A window that starts earlier elsewhere has such a place at its head, so parsing begins at a stretch's first one.
        next_ = np.searchsorted(places, self.starts)
        head = places[np.minimum(next_, len(places) - 1)]
        live = np.flatnonzero((next_ < len(places)) & (head < self.ends))
        at, ends = head[live], self.ends[live]
        before, length_before = np.full(len(live), -1), np.zeros(len(live), np.int64)
        starts, stops = [none], [none]
        while len(at):
            length = np.maximum(self.match(at), 1)
            far = length >= window
            starts.append(at[far])
            stops.append(at[far] + length[far])
            # Windows across the border: behind the last factor's first word, and no further than this factor.
            low, high = np.maximum(before + 1, at - window + 1), np.minimum(at - 1, at + length - window)
            some = (before >= 0) & (length_before + length > window) & (high >= low)
            if some.any():
                ask = ranges(low[some], high[some] - low[some] + 1)
                ask = ask[self.early[ask] & self.early[ask + window - DEPTH // 2]] if window >= DEPTH // 2 else ask
                ask = ask[self.match(ask) >= window]
                starts.append(ask)
                stops.append(ask + window)
            before, length_before, at = at, length, at + length
            go = at < ends
            before, length_before, at, ends = before[go], length_before[go], at[go], ends[go]
        return np.concatenate(starts), np.concatenate(stops)


def factored(blobs: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Step 3 and 4: (doc, key, start, end) of one block."""
    heads, words = [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        heads.append(np.frombuffer(blob, np.int64, 4 * n, 8).reshape(4, n))
        words.append(np.frombuffer(blob, _U, -1, 8 + 32 * n))
    doc, key, start, size = np.concatenate(heads, axis=1)
    words = np.concatenate(words)
    place = np.cumsum(size) - size
    order = np.lexsort((start, key, doc))
    doc, key, start, size, place = (x[order] for x in (doc, key, start, size, place))
    # Stretches of one document that overlap become one, so that every place of the corpus is there once.
    group = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(key) != 0)]))
    far = np.int64(1) << 40
    reach = np.maximum.accumulate(group * far + start + size) - group * far
    last = np.concatenate([[0], reach[:-1]])
    new = np.concatenate([[True], (np.diff(group) != 0) | (start[1:] > reach[:-1])])
    skip = np.where(new, 0, np.minimum(last - start, size))
    owner = np.cumsum(new) - 1
    taken = words[ranges(place + skip, size - skip)]
    sizes = np.bincount(owner, size - skip).astype(np.int64)
    doc, key, start = doc[new], key[new], start[new]
    reference = Reference(taken, sizes)
    low, high = reference.spans(window)
    of = np.searchsorted(reference.starts, low, side="right") - 1
    shift = start[of] - reference.starts[of]
    return doc[of], key[of], low + shift, high + shift


def _factor(window: int, parts: int):
    """(part, found) of all blocks, with what step 2 has settled.  Rows come sorted by block, so one block is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers, blobs, now = Answers(parts), [], None

        def told() -> Iterator[pa.RecordBatch]:
            for part, found in answers.flush():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([found], pa.binary())], names=Answers.NAMES)

        for batch in batches:
            done = batch.column(1).is_null()
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(done) for k in (2, 3)], names=Answers.NAMES)
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if blob is None:
                    continue
                if bucket != now and blobs:
                    if answers.add(*factored(blobs, window)):
                        yield from told()
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            answers.add(*factored(blobs, window))
        yield from told()

    return run


def _cut(window: int, keep_text: bool):
    """Step 5: the texts without their spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                made: list[list] = [[] for _ in range(5)]
                for text, spans, copy in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                    words = text.encode().split()
                    found = np.frombuffer(spans or b"", np.int64).reshape(-1, 2)
                    if copy and len(words) >= window:
                        found = np.array([[0, len(words)]])
                    kept, at = [], 0
                    for a, b in found.tolist():
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    body = b" ".join(kept)
                    for x, value in zip(made, (len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode() if keep_text else None, found.tolist() if keep_text else None), strict=True):
                        x.append(value)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return run


def rlz_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, gram: int = 8, keep_text: bool = True, hot: int = 512, block_bytes: int = 16 << 20) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, unless told otherwise, the kept text and the removed spans of words.

    ``block_bytes`` of text make a reference block, so a block's size does not
    grow with the input; an anchor with more than ``hot`` places may be hot.
    """
    if not 0 < gram <= DEPTH // 2 <= window <= DEPTH:
        raise ValueError(f"a window has {DEPTH // 2} to {DEPTH} words, a gram 1 to {DEPTH // 2}")
    spark = docs.sparkSession
    bounded_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(body, F.octet_length(body)).alias("key"), body.alias("text"))

    # The smallest document of each text stands for it.  Salts keep a text of very many copies apart.
    salt = F.pmod(F.xxhash64("doc"), F.lit(1024)).cast("int").alias("salt")
    salted = checkpoint(rows.groupBy("key", salt).agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("n"), F.first(F.octet_length("text")).alias("bytes")))
    firsts = checkpoint(salted.groupBy("key").agg(F.min("doc").alias("doc"), F.sum("n").alias("n"), F.first("bytes").alias("bytes")))
    total = firsts.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(partitions, -(-total // block_bytes))
    stands = firsts.select("doc", "key")
    standing = rows.join(stands.hint("shuffle_hash"), ["doc", "key"])
    names = standing.select("doc", "text").mapInArrow(_emit_names(window, gram, blocks), "bucket int, docs binary, slots binary, names binary")
    names = names.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket").mapInArrow(_shared(hot), "doc long, name long")
    listed = names.groupBy("doc").agg(F.collect_list("name").alias("names")).join(stands, "doc")
    standing = rows.join(listed.hint("shuffle_hash"), ["doc", "key"]).select("doc", "key", "text", "names")
    sent = standing.mapInArrow(_emit_stretches(window, gram, blocks), "bucket int, run binary, part int, found binary")
    dealt = F.coalesce(F.col("bucket"), F.col("part")) % partitions
    found = sent.repartitionById(partitions, dealt).sortWithinPartitions("bucket").mapInArrow(_factor(window, blocks), "part int, found binary")
    spans = found.repartitionById(partitions, F.col("part") % partitions).sortWithinPartitions("part").mapInArrow(_gather, "doc long, key long, spans binary")
    copied = salted.select("key", "salt").join(firsts.filter("n > 1").select("key", F.col("doc").alias("first")), "key")
    copies = rows.select("doc", "key", salt).join(copied.hint("shuffle_hash"), ["key", "salt"]).filter("doc > first").select("doc", "key", F.lit(None).cast("binary").alias("spans")).distinct()
    told = spans.union(copies).withColumn("whole", F.col("spans").isNull())
    joined = rows.join(told.hint("shuffle_hash"), ["doc", "key"], "left").select("doc", "key", "text", "spans", "whole")
    out = joined.mapInArrow(_cut(window, keep_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<array<long>>")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
    return out if keep_text else out.drop("kept", "spans")


def op12_rlz_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    return rlz_dedup(docs.select("doc_id", "text"), keep_text=False)
