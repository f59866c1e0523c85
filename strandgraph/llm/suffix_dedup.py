"""Suffix dedup of bytes by a prefix-aware distributed merge sort.

A byte is removed if a string of ``width`` bytes that covers it also starts in
a document with a smaller doc_id.  Only suffixes that can matter are sorted:

1. Anchors: in every string of ``width`` bytes the ``gram``-byte substrings
   with the least hash.  Equal strings have equal anchors at equal places, so
   it is enough to compare anchors, one in about 14 positions.
2. Duplicate detection, as in communication-efficient string sorting: hashes of
   anchors are dealt by value, and only anchors whose gram occurs in two texts
   stay.
3. Each task sorts its anchors' suffixes (cut at ``width`` bytes), front-codes
   them (each one as its common prefix with the one before, and the rest) and
   sends such sorted runs to buckets.  A suffix carries the bytes to its left.
   Strings of which the run itself has a smaller document are removed on the
   spot, and only suffixes with other strings go out.
4. A bucket's runs are combined by a loser tree that keeps, for each contender,
   its common prefix with the last winner, and looks at characters only where
   two contenders agree on that length.  The prefixes it puts out group the
   merged suffixes at every length from ``gram`` to ``width``; with the bytes
   to the left, they give the least document for each string around an anchor.
5. Removed spans go to the part that their document is in, packed, and from
   there, one row for each document, to the texts, which are shuffled once for
   steps 3 and 5.

A gram in very many texts (``hot`` and more than 1/32 of its bucket) would put
the edges of all its copies into one bucket; its strings are sent as suffixes
of their own, dealt by their own hash, where equal ones collapse in each task.

Texts are UTF-8 bytes; nulls and empty texts have none.  Equal texts are one
text that its smallest doc_id holds; copies with a larger doc_id lose all if
they have ``width`` bytes.  Rows that share a doc_id do not affect each other.
A null doc_id comes after all others.
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

LAST = (1 << 63) - 1
_U = np.uint64


def _sliding(values: np.ndarray, w: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over every w consecutive values."""
    size = 1
    while 2 * size <= w:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (w - size)], values[w - size :]) if w > size else values


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, powers: B.Powers) -> tuple[np.ndarray, ...]:
    """(places, gram hashes, rows, least, most) of anchors.

    The strings that an anchor is the anchor of start ``least`` to ``most``
    bytes before it.
    """
    n = len(data)
    if n < width:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, _U), none, none, none
    powers.reserve(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(B.BYTE_VALUES[data] * powers.up[:n], out=sums[1:])
    hashes = B.mix64((sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1]) | _U(1)
    w = width - gram + 1
    least = _sliding(hashes, w, np.minimum)
    # A string must lie in one row.
    lengths = np.diff(offsets)
    last = np.repeat(offsets[1:] - width, lengths)[: len(least)]
    least[np.arange(len(least)) > last] = 0
    padded = np.concatenate([np.zeros(w - 1, _U), least, np.zeros(w - 1, _U)])
    best = _sliding(padded, w, np.maximum)
    places = np.flatnonzero(best == hashes)
    found = hashes[places]
    # padded[i + w - 1] is the least hash of the string that starts at i.
    first, last = np.full(len(places), w, np.int64), np.zeros(len(places), np.int64)
    for j in range(w):
        own = padded[places + (w - 1) - j] == found
        np.minimum(first, np.where(own, j, w), out=first)
        last[own] = j
    return places, found, np.searchsorted(offsets, places, side="right") - 1, first, last


def _names(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 32 further bits) of hashes."""
    mixed = B.mix64(hashes)
    return ((mixed >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64), ((mixed * _U(buckets)) >> _U(32)).astype(np.uint32)


def _emit_hashes(width: int, gram: int, buckets: int):
    """Step 2, first half: (bucket, docs, slots, names), all packed; docs and slots as differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, count = B.Powers(), [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, name, doc = (np.concatenate([h[i] for h in held]) for i in range(3))
            order = np.lexsort((doc, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                own = order[edges[k] : edges[k + 1]]
                if len(own):
                    used, slots = np.unique(doc[own], return_inverse=True)
                    parts = np.diff(used, prepend=0), np.diff(slots, prepend=0).astype(np.uint8), name[own]
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["bucket", "docs", "slots", "names"])

        for batch, data, offsets in B.pieces(batches, 1):
            _, hashes, rows, _, _ = anchors(data, offsets, width, gram, powers)
            bucket, name = _names(hashes, buckets)
            held.append((bucket.astype(np.int32), name, batch.column(0).to_numpy()[rows]))
            count += len(rows)
            if count > 1_500_000:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return run


def _shared_names(least_hot: int):
    """Step 2, second half: (doc, name) of grams in two texts or more; bit 0 of name tells very frequent ones.

    Rows come sorted by bucket, so one bucket is held at a time.
    """

    def shared(bucket: int, parts: list[tuple[bytes, bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate([np.cumsum(np.frombuffer(d, np.int64))[np.cumsum(np.frombuffer(s, np.uint8), dtype=np.int64)] for d, s, _ in parts])
        names = np.concatenate([np.frombuffer(n, np.uint32) for _, _, n in parts])
        order = np.lexsort((keys, names))
        keys, names = keys[order], names[order]
        new = np.ones(len(names), bool)
        new[1:] = (names[1:] != names[:-1]) | (keys[1:] != keys[:-1])
        keys, names = keys[new], names[new]
        first = np.concatenate([[True], names[1:] != names[:-1]])
        texts = np.diff(np.concatenate([np.flatnonzero(first), [len(names)]]))
        times = np.repeat(texts, texts)
        stay = times > 1
        hot = times > max(least_hot, len(names) // 32)
        keys, code = keys[stay], ((np.int64(bucket) << 33) | (names.astype(np.int64) << 1) | hot)[stay]
        for at in range(0, len(code), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 16)]), pa.array(code[at : at + (1 << 16)])], names=["doc", "name"])

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


def common_prefixes(strings: np.ndarray) -> np.ndarray:
    """Each row's common prefix with the row before (0 for the first); rows are padded with zeros, which count."""
    prefix = np.zeros(len(strings), np.int64)
    differ = strings[1:] != strings[:-1]
    prefix[1:] = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
    return prefix


def front_code(strings: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(common prefix with the row before, the remaining bytes) of rows of a byte matrix, zero behind their lengths."""
    prefix, column = common_prefixes(strings), np.arange(strings.shape[1])
    return prefix.astype(np.uint8), strings[(column >= prefix[:, None]) & (column < lengths[:, None])].tobytes()


def packed_run(right, rlen, lefts, llen, place, doc, key) -> bytes:
    """A sorted run as bytes: both sides front-coded."""
    prefix, rest = front_code(right, rlen)
    lp, body = front_code(lefts, llen)
    parts = [prefix, rlen.astype(np.uint8), lp, llen.astype(np.uint8), place.astype(np.int64), doc, key]
    return np.array([len(place), len(rest)], np.int64).tobytes() + b"".join(p.tobytes() for p in parts) + rest + body


def _order(strings: np.ndarray) -> list[np.ndarray]:
    """Sort keys (last first, for lexsort) of rows of a byte matrix."""
    n, width = strings.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = strings
    return list(wide.view(">u8").astype(_U).T[::-1])


def covered_by_less(known: np.ndarray, rlen: np.ndarray, llen: np.ndarray, lefts: np.ndarray, doc: np.ndarray, width: int) -> np.ndarray:
    """(entry, s): whether a smaller document among the entries has the string that starts s bytes before the entry's gram.

    Entries are sorted by the bytes from the gram on; ``known`` is each one's
    common prefix with the one before.
    """
    n, left = lefts.shape
    covered = np.zeros((n, left + 1), bool)
    if not n:
        return covered
    # Only grams of two documents or more need a look.
    first = np.flatnonzero(np.concatenate([[True], known[1:] < width - left]))
    size = np.diff(np.concatenate([first, [n]]))
    many = np.repeat(np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first), size)
    mark = np.zeros(n, _U)
    for s in range(left + 1):
        if s:
            mark = (mark + B.BYTE_VALUES[lefts[:, s - 1]]) * _U(B._BASE)
        able = np.flatnonzero(many & (rlen >= width - s) & (llen >= s))
        if not len(able):
            continue
        group = np.cumsum(known < width - s)
        code = B.mix64(mark[able] ^ B.mix64(group[able].astype(_U)))
        by_code = np.argsort(code, kind="stable")
        c, d = code[by_code], doc[able][by_code]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        size = np.diff(np.concatenate([first, [len(c)]]))
        covered[able[by_code], s] = d > np.repeat(np.minimum.reduceat(d, first), size)
    return covered


def spans_of(covered: np.ndarray, place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, start, end) of the bytes that each entry's covered strings span."""
    edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    i, low = np.nonzero(edge == 1)
    high = np.nonzero(edge == -1)[1] - 1
    return i, place[i] - high, place[i] - low + width


class Answers:
    """Removed spans of many documents, gathered in a task and packed for each part of the documents."""

    NAMES = ("part", "found")

    def __init__(self, parts: int, most: int = 500_000) -> None:
        self.parts, self.most, self.held, self.count = parts, most, [], 0

    def add(self, doc, key, start, end) -> bool:
        """Whether enough is held for a flush."""
        self.held.append((doc, key, start, end))
        self.count += len(doc)
        return self.count > self.most

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.count:
            return
        doc, key, start, end = joined(*(np.concatenate([h[i] for h in self.held]) for i in range(4)))
        self.held, self.count = [], 0
        part = (B.mix64(doc.astype(_U) ^ B.mix64(key.astype(_U))) % _U(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0, [True]]))
        rows = np.stack([doc, key, start, end], 1)[order]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(part[order[a]]), np.ascontiguousarray(rows[a:b].T).tobytes()


def _emit_runs(width: int, gram: int, buckets: int):
    """Step 3: (bucket, run) of front-coded suffixes, and (part, found) of what a run settles itself."""
    left = width - gram
    names_out = ["bucket", "run", "part", "found"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, held, total = B.Powers(), [], 0
        reach, back = np.arange(width), np.arange(1, left + 1)
        answers = Answers(buckets)

        def flush() -> Iterator[pa.RecordBatch]:
            bucket, right, rlen, lefts, llen, doc, key, place = (np.concatenate([h[i] for h in held]) for i in range(8))
            order = np.lexsort([doc, llen, *_order(lefts), rlen, *_order(right), bucket])
            bucket, right, rlen, lefts, llen, doc, key, place = (x[order] for x in (bucket, right, rlen, lefts, llen, doc, key, place))
            known = common_prefixes(right)
            known[1:][bucket[1:] != bucket[:-1]] = 0
            covered = covered_by_less(known, rlen, llen, lefts, doc, width)
            i, start, end = spans_of(covered, place, width)
            if answers.add(doc[i], key[i], start, end):
                yield from told()
            # What goes out are the strings of which this task knows no smaller document.
            shift = np.arange(left + 1)
            open_ = ~covered & (shift >= width - rlen[:, None]) & (shift <= llen[:, None])
            go = np.flatnonzero(open_.any(1))
            llen = left - np.argmax(open_[:, ::-1], axis=1)
            lefts[np.arange(left) >= llen[:, None]] = 0
            edges = np.searchsorted(bucket[go], np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                own = go[edges[k] : edges[k + 1]]
                yield row(k, packed_run(right[own], rlen[own], lefts[own], llen[own], place[own], doc[own], key[own]), None, None)

        def told() -> Iterator[pa.RecordBatch]:
            for part, found in answers.flush():
                yield row(part, None, part, found)

        def row(bucket, blob, part, found) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([blob], pa.binary()), pa.array([part], pa.int32()), pa.array([found], pa.binary())], names=names_out)

        for batch, data, offsets in B.pieces(batches, 2):
            places, hashes, rows, least, most = anchors(data, offsets, width, gram, powers)
            bucket, name = _names(hashes, buckets)
            code = (bucket << 33) | (name.astype(np.int64) << 1)
            # The names that each text shares, with the row in front.
            lists = batch.column(3)
            counts = np.asarray(lists.value_lengths().fill_null(0))
            shared = lists.flatten().to_numpy()
            where = np.repeat(np.arange(batch.num_rows), counts)
            table = B.mix64((shared >> 1).astype(_U) ^ B.mix64(where.astype(_U)))
            by = np.argsort(table)
            table, hot = table[by], (shared & 1).astype(bool)[by]
            wanted = B.mix64((code >> 1).astype(_U) ^ B.mix64(rows.astype(_U)))
            at = np.searchsorted(table, wanted) if len(table) else np.zeros(len(wanted), np.int64)
            at[at == len(table)] = 0
            has = (table[at] == wanted) if len(table) else np.zeros(len(wanted), bool)
            places, rows, bucket, least, most = places[has], rows[has], bucket[has], least[has], most[has]
            is_hot = hot[at[has]] if len(table) else np.zeros(0, bool)
            doc, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            padded = np.concatenate([np.zeros(left, np.uint8), data, np.zeros(width, np.uint8)])
            if is_hot.any():
                before = np.arange(left + 1)
                mine = (before >= least[is_hot][:, None]) & (before <= most[is_hot][:, None])
                starts, pick = np.unique((places[is_hot][:, None] - before)[mine], return_index=True)
                owner = np.repeat(rows[is_hot], mine.sum(1))[pick]
                powers.reserve(len(data))
                strings = padded[starts[:, None] + left + reach]
                own_hash = B.span_hashes(data, starts, starts + width, B.BYTE_VALUES, powers)
                held.append((_names(own_hash, buckets)[0], strings, np.full(len(starts), width), np.zeros((len(starts), left), np.uint8), np.zeros(len(starts), np.int64), doc[owner], key[owner], starts - offsets[owner]))
                total += len(starts)
            p, r = places[~is_hot], rows[~is_hot]
            rlen, llen = width - least[~is_hot], most[~is_hot]
            right, lefts = padded[p[:, None] + left + reach], padded[p[:, None] + left - back]
            right[reach >= rlen[:, None]] = 0
            lefts[np.arange(left) >= llen[:, None]] = 0
            held.append((bucket[~is_hot], right, rlen, lefts, llen, doc[r], key[r], p - offsets[r]))
            total += len(p)
            if total > 400_000:
                yield from flush()
                held, total = [], 0
        if total:
            yield from flush()
        yield from told()

    return run


def joined(doc, key, start, end) -> tuple[np.ndarray, ...]:
    """Spans by document, those that overlap or touch joined: (doc, key, start, end), sorted."""
    if not len(doc):
        return doc, key, start, end
    order = np.lexsort((start, key, doc))
    doc, key, start, end = doc[order], key[order], start[order], end[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    # Furthest end so far within a document: documents are lifted apart first.
    lift = np.cumsum(new) * (int(end.max()) + 2)
    furthest = np.maximum.accumulate(end + lift)
    opens = new.copy()
    opens[1:] |= start[1:] + lift[1:] > furthest[:-1]
    first = np.flatnonzero(opens)
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], key[first], start[first], (furthest - lift)[last]


class LoserTree:
    """Merges sorted runs of (string as integer) by known common prefixes.

    Each run yields (integer, common prefix with the entry before it in the
    run).  An inner node holds the loser of its match and that loser's common
    prefix with the winner; the known prefix of a contender is with the last
    string put out.  A longer known prefix means a smaller string; only at
    equal lengths are the strings themselves looked at.
    """

    def __init__(self, runs: list[tuple[list[int], list[int]]], width: int) -> None:
        self.bits, self.width = 8 * width, width
        self.runs = runs
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.at = [0] * self.size
        self.end = [len(r[0]) for r in runs] + [0] * (self.size - len(runs))

    def merge(self) -> tuple[list[int], list[int], list[int]]:
        """(run, place in the run, common prefix with the one before) of every entry, in order."""
        runs, at, end, size, bits = self.runs, self.at, self.end, self.size, self.bits
        none = -1
        value: list[int] = [runs[i][0][0] if i < len(runs) and end[i] else none for i in range(size)]
        known = [0] * size
        loser = [0] * size

        def match(a: int, b: int) -> tuple[int, int]:
            """(winner, loser) of two contenders; sets the loser's known prefix."""
            va, vb = value[a], value[b]
            if va < 0:
                return b, a
            if vb < 0:
                return a, b
            ka, kb = known[a], known[b]
            if ka > kb:
                return a, b
            if kb > ka:
                return b, a
            common = (bits - (va ^ vb).bit_length()) >> 3
            if va < vb or (va == vb and a < b):
                known[b] = common
                return a, b
            known[a] = common
            return b, a

        def build(node: int) -> int:
            if node >= size:
                return node - size
            winner, loser[node] = match(build(2 * node), build(2 * node + 1))
            return winner

        top = build(1) if size > 1 else 0
        out_run, out_at, out_known = [], [], []
        while value[top] >= 0:
            i = at[top]
            out_run.append(top)
            out_at.append(i)
            out_known.append(known[top])
            i += 1
            at[top] = i
            if i < end[top]:
                value[top] = runs[top][0][i]
                known[top] = runs[top][1][i]
            else:
                value[top] = none
            node = (top + size) >> 1
            while node:
                other = loser[node]
                vo = value[other]
                if vo >= 0:
                    vt = value[top]
                    if vt < 0:
                        loser[node], top = top, other
                    else:
                        kt, ko = known[top], known[other]
                        if kt == ko:
                            common = (bits - (vt ^ vo).bit_length()) >> 3
                            if vt < vo or (vt == vo and top < other):
                                known[other] = common
                            else:
                                known[top] = common
                                loser[node], top = top, other
                        elif ko > kt:
                            loser[node], top = top, other
                node >>= 1
        return out_run, out_at, out_known


def _read_run(blob: bytes, width: int, left: int):
    n, rest = np.frombuffer(blob, np.int64, 2)
    at = 16
    out = []
    for kind in (np.uint8, np.uint8, np.uint8, np.uint8, np.int64, np.int64, np.int64):
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    prefix, rlen, lp, llen, place, doc, key = out
    strings = np.zeros((n, width), np.uint8)
    strings[(np.arange(width) >= prefix[:, None]) & (np.arange(width) < rlen[:, None])] = np.frombuffer(blob, np.uint8, rest, at)
    lefts = np.zeros((n, left), np.uint8)
    lefts[(np.arange(left) >= lp[:, None]) & (np.arange(left) < llen[:, None])] = np.frombuffer(blob, np.uint8, -1, at + rest)
    # A byte that was not sent is that of the last row that had its own there.
    source = np.maximum.accumulate(np.where(np.arange(left) >= lp[:, None], np.arange(n)[:, None], 0), axis=0)
    return prefix, rlen, llen, place, doc, key, strings, np.take_along_axis(lefts, source, 0)


def _merge_runs(width: int, gram: int, parts: int):
    """Step 4: (part, found), with what step 3 has settled.  Rows come sorted by bucket, so one bucket is held at a time."""
    left = width - gram

    def merged(blobs: list[bytes]):
        """(doc, key, start, end) of one bucket's runs."""
        parsed = [_read_run(b, width, left) for b in blobs]
        runs = []
        for prefix, _, _, _, _, _, strings, _ in parsed:
            # Front coding is undone on integers: keep the first bytes of the one before.
            values, now, full = [], 0, 8 * width
            packed = strings.tobytes()
            for i, p in enumerate(prefix.tolist()):
                own = int.from_bytes(packed[i * width : (i + 1) * width], "big")
                keep = full - 8 * p
                now = ((now >> keep) << keep) | own
                values.append(now)
            runs.append((values, prefix.tolist()))
        which, index, known = (np.array(x, np.int64) for x in LoserTree(runs, width).merge())
        starts = np.concatenate([[0], np.cumsum([len(p[0]) for p in parsed])])[:-1]
        order = starts[which] + index
        rlen, llen, place, doc, key, lefts = (np.concatenate([p[i] for p in parsed])[order] for i in (1, 2, 3, 4, 5, 7))
        covered = covered_by_less(known, rlen.astype(np.int64), llen.astype(np.int64), lefts, doc, width)
        i, start, end = spans_of(covered, place, width)
        return doc[i], key[i], start, end

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
                    if answers.add(*merged(blobs)):
                        yield from told()
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            answers.add(*merged(blobs))
        yield from told()

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 5, first half: (doc, key, spans), a row for each document; rows come sorted by part."""
    now, held = None, []

    def rows() -> Iterator[pa.RecordBatch]:
        doc, key, start, end = joined(*np.concatenate([np.frombuffer(h, np.int64).reshape(4, -1) for h in held], axis=1))
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(key) != 0), [True]]))
        pairs = np.stack([start, end], 1)
        for at in range(0, len(edges) - 1, 4096):
            a, b = edges[:-1][at : at + 4096], edges[1:][at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(key[a]), pa.array([pairs[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())], names=["doc", "key", "spans"])

    for batch in batches:
        for part, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != now and held:
                yield from rows()
                held = []
            now = part
            held.append(found)
    if held:
        yield from rows()


def _cut(width: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in B.pieces(batches, 2):
            docs, lists, whole = batch.column(0), batch.column(3).to_pylist(), batch.column(4).to_pylist()
            made: list[list] = [[] for _ in range(5)]
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                gone = np.zeros(len(text) + 1, np.int8)
                if whole[i] and len(text) >= width:
                    gone[:-1] = 1
                for a, b in np.frombuffer(lists[i] or b"", np.int64).reshape(-1, 2):
                    gone[a:b] = 1
                kept = text[gone[:-1] == 0].tobytes()
                spans = int(((gone[1:] == 0) & (gone[:-1] == 1)).sum())
                for x, value in zip(made, (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if keep_text else None), strict=True):
                    x.append(value)
            yield pa.RecordBatch.from_arrays([docs, *(pa.array(x, k) for x, k in zip(made, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 50, gram: int = 24, keep_text: bool = True, hot: int = 4096, bucket_bytes: int = 128 << 20) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, unless told otherwise, the kept bytes.

    ``bucket_bytes`` of text make a bucket, so a bucket's size does not grow
    with the input; a gram of more than ``hot`` texts may be hot.
    """
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
    buckets = max(partitions, -(-total // bucket_bytes))
    stands = firsts.select("doc", "key")
    standing = rows.join(stands.hint("shuffle_hash"), ["doc", "key"])
    names = standing.select("doc", "text").mapInArrow(_emit_hashes(width, gram, buckets), "bucket int, docs binary, slots binary, names binary")
    names = names.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket").mapInArrow(_shared_names(hot), "doc long, name long")
    wanted = names.groupBy("doc").agg(F.collect_list("name").alias("names")).join(stands, "doc")
    standing = rows.join(wanted.hint("shuffle_hash"), ["doc", "key"]).select("doc", "key", "text", "names")
    sent = standing.mapInArrow(_emit_runs(width, gram, buckets), "bucket int, run binary, part int, found binary")
    found = sent.repartitionById(partitions, F.col("bucket") % partitions).sortWithinPartitions("bucket").mapInArrow(_merge_runs(width, gram, buckets), "part int, found binary")
    spans = found.repartitionById(partitions, F.col("part") % partitions).sortWithinPartitions("part").mapInArrow(_gather, "doc long, key long, spans binary")
    copied = salted.select("key", "salt").join(firsts.filter("n > 1").select("key", F.col("doc").alias("first")), "key")
    copies = rows.select("doc", "key", salt).join(copied.hint("shuffle_hash"), ["key", "salt"]).filter("doc > first").select("doc", "key", F.lit(None).cast("binary").alias("spans")).distinct()
    told = spans.union(copies).withColumn("whole", F.col("spans").isNull())
    joined_ = rows.join(told.hint("shuffle_hash"), ["doc", "key"], "left").select("doc", "key", "text", "spans", "whole")
    out = joined_.mapInArrow(_cut(width, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = out.withColumn("doc_id", F.when(F.col("doc_id") != LAST, F.col("doc_id")))
    return out if keep_text else out.drop("kept")


def op7_suffix_dedup(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return suffix_dedup(docs.select("doc_id", "text"), keep_text=False)
