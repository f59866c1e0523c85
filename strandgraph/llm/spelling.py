"""Grouping of spelling variants by two-dimensional range reporting.

A word is a point: its rank among all words, and its rank among all words read
backwards.  Words that agree with a word before edit position i are an interval
of the first order, those that agree with it behind the position an interval of
the second; the words in both are near it.  Both are found for every position,
and a wavelet tree over the points reports what lies in the rectangle: words of
the same length differ by a replaced code point, words one longer by an
inserted one (a deletion is an insertion seen from the other word).

Two near words agree outside a window of edit positions, so words are dealt by
(length, window, what lies before and behind the window), at first with two
windows; each task builds trees over the words it holds.  A group of more than
``group`` words has its window halved until it is small: at a single position
only the alphabet is left.  Every pair is found at exactly one position.

A word's form is its most frequent near word (ties: the smallest in code-point
order) if that is ``ratio`` times as frequent.  Roots follow forms to the end by
pointer jumping; frequency grows along a chain, so there are no cycles.

Null and empty texts have no words; a null doc_id counts as the empty string in
the checksum that decides on deletions.  Repeated rows count once each.  Very
long texts are read whole, and a very long word is one row of its length.  An
empty table has no words.  Other columns are not looked at, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sparkops import bounded_batches, checkpoint

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A task builds its trees over so many characters of words at a time.
CHUNK = 1 << 20


class WaveletTree:
    """Points (place, value) of a sequence of distinct values, reported by rectangle."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = range(max(int(len(values) - 1).bit_length(), 1) - 1, -1, -1)
        #: By level: how many values before each place have a zero in this level's bit.
        self.zeros: list[np.ndarray] = []
        for bit in self.bits:
            one = (values >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for low <= place < high and least <= value < most; all queries go down the tree together."""
        query, base = np.arange(len(low)), np.zeros(len(low), np.int64)
        for bit, zeros in zip(self.bits, self.zeros, strict=True):
            low0, high0 = zeros[low], zeros[high]
            low1, high1 = zeros[-1] + low - low0, zeros[-1] + high - high0
            half = 1 << bit
            left = (high0 > low0) & (base < most[query]) & (base + half > least[query])
            right = (high1 > low1) & (base + half < most[query]) & (base + 2 * half > least[query])
            low, high = np.concatenate([low0[left], low1[right]]), np.concatenate([high0[left], high1[right]])
            base = np.concatenate([base[left], base[right] + half])
            query = np.concatenate([query[left], query[right]])
        return query, base


class _Order:
    """Words sorted, and for each length of prefix the interval of words that share it."""

    def __init__(self, letters: np.ndarray) -> None:
        rows = np.ascontiguousarray(letters)
        self.order = np.argsort(rows.view(f"U{rows.shape[1]}").ravel(), kind="stable")
        self.rank = np.empty(len(rows), np.int64)
        self.rank[self.order] = np.arange(len(rows))
        differ = rows[self.order[1:]] != rows[self.order[:-1]]
        self.common = np.where(differ.any(1), differ.argmax(1), rows.shape[1])

    def interval(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """By word: first rank and last rank + 1 of the words with its first ``length`` letters."""
        new = np.concatenate([[True], self.common < length])
        edges = np.append(np.flatnonzero(new), len(new))
        group = (np.cumsum(new) - 1)[self.rank]
        return edges[group], edges[group + 1]


def near_pairs(words: list[str], short: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray, _Order]:
    """(a, b) in both directions: places of distinct words of ``short`` or ``short + 1`` letters that differ by one edit at a position from ``first`` to ``last - 1``."""
    width = short + 1
    letters = np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)
    long = letters[:, short] != 0
    back = np.where(long[:, None], letters[:, ::-1], np.concatenate([letters[:, :short][:, ::-1], np.zeros((len(words), 1), np.uint32)], axis=1))
    forth, back = _Order(letters), _Order(back)

    def tree(mine: np.ndarray):
        """Ranks among these words only: counts before each rank of both orders, the tree, and words by their backward rank."""
        before = [np.concatenate([[0], np.cumsum(mine[o.order])]) for o in (forth, back)]
        by_back = back.order[mine[back.order]]
        place = np.empty(len(words), np.int64)
        place[by_back] = np.arange(len(by_back))
        return before, WaveletTree(place[forth.order[mine[forth.order]]]) if len(by_back) else None, by_back

    (sf, sb), same, same_words = tree(~long)
    (lf, lb), longer, longer_words = tree(long)
    asks = np.flatnonzero(~long)
    out_a, out_b = [], []

    def ask(i: int, rest: int, counts_f, counts_b, points, words_of, least: int) -> tuple[np.ndarray, np.ndarray]:
        (f0, f1), (b0, b1) = (o.interval(n) for o, n in ((forth, i), (back, rest)))
        f0, f1, b0, b1 = counts_f[f0[asks]], counts_f[f1[asks]], counts_b[b0[asks]], counts_b[b1[asks]]
        open_ = np.flatnonzero((f1 - f0 >= least) & (b1 - b0 >= least))
        query, value = points.report(f0[open_], f1[open_], b0[open_], b1[open_])
        return asks[open_[query]], words_of[value]

    for i in range(first, min(last, short + 1)):
        if same and i < short:
            # The word itself is in both intervals.
            a, b = ask(i, short - 1 - i, sf, sb, same, same_words, 2)
            other = a != b
            out_a.append(a[other])
            out_b.append(b[other])
        if same and longer:
            a, b = ask(i, short - i, lf, lb, longer, longer_words, 1)
            # Beside an equal letter the insertion counts at the leftmost place.
            if i:
                own = letters[a, i - 1] != letters[b, i]
                a, b = a[own], b[own]
            out_a += [a, b]
            out_b += [b, a]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b]), forth


NEAR = "word string, near long, best_n long, best string"


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (short, first, last, key, word, n), sorted by the first four: by word, its near words in this group."""

    def told(words: list[str], n: np.ndarray, short: int, first: int, last: int) -> Iterator[pa.RecordBatch]:
        a, b, forth = near_pairs(words, short, first, last)
        if not len(a):
            return
        order = np.lexsort((forth.rank[b], -n[b], a))
        a, b = a[order], b[order]
        edges = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        counts = np.diff(np.append(edges, len(a)))
        best = b[edges]
        names = pa.array(words, pa.string())
        yield pa.RecordBatch.from_arrays([names.take(pa.array(a[edges])), pa.array(counts), pa.array(n[best]), names.take(pa.array(best))], names=["word", "near", "best_n", "best"])

    def solved(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        short, first, last, key, n = (rows.column(c).to_numpy() for c in ("short", "first", "last", "key", "n"))
        group = np.concatenate([[True], (np.diff(short) != 0) | (np.diff(first) != 0) | (np.diff(last) != 0) | (np.diff(key) != 0)])
        starts = np.append(np.flatnonzero(group), len(key))
        # A word alone in its group has no near word there.
        many = np.flatnonzero(np.repeat(np.diff(starts) > 1, np.diff(starts)))
        kinds = np.concatenate([[0], np.flatnonzero((np.diff(short[many]) != 0) | (np.diff(first[many]) != 0) | (np.diff(last[many]) != 0)) + 1, [len(many)]])
        words = rows.column("word").take(pa.array(many)).to_pylist()
        for x, y in zip(kinds[:-1], kinds[1:], strict=True):
            # Groups of one kind share a tree; their intervals stay apart.
            while x < y:
                z = x + max(1, CHUNK // (int(short[many[x]]) + 1))
                if z < y:
                    at = starts[np.searchsorted(starts, many[z], side="right")]
                    z = int(np.searchsorted(many, at))
                z = min(z, y)
                part = many[x:z]
                yield from told(words[x:z], n[part], int(short[part[0]]), int(first[part[0]]), int(last[part[0]]))
                x = z

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= 1 << 17:
            rows = pa.Table.from_batches(held)
            kept = [rows.column(c).to_numpy() for c in ("short", "first", "last", "key")]
            # The last group may go on in the next batch.
            same = np.logical_and.reduce([k == k[-1] for k in kept])
            cut = size - int(np.argmin(same[::-1])) if not same.all() else 0
            if cut:
                yield from solved(rows.slice(0, cut))
                held, size = rows.slice(cut).to_batches(), size - cut
    if size:
        yield from solved(pa.Table.from_batches(held))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters with their counts; where ``every`` divides a checksum, one code point is deleted."""
    # Shorter runs cannot give a word of ``min_length``.
    runs = docs.select(doc_id, F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    low = runs.select(doc_id, F.translate("run", UPPER, LOWER).alias("low"))
    checked = low.withColumn("h", F.crc32(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.col("low"))))
    at = F.expr("cast(h % length(low) as int)")
    dropped = F.concat(F.substring("low", F.lit(1), at), F.substring("low", at + 2, F.length("low")))
    word = F.when(F.col("h") % every == 0, dropped).otherwise(F.col("low"))
    return checked.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _dealt(rows: DataFrame, windows: Column) -> DataFrame:
    """rows (word, n, short) once for each window, with the key of what lies outside it."""
    spread = rows.withColumn("w", F.explode(windows)).select("word", "n", "short", F.col("w.first").alias("first"), F.col("w.last").alias("last"))
    outside = [F.substring("word", F.lit(1), F.col("first")), F.right("word", F.greatest(F.col("short") - F.col("last"), F.lit(0)))]
    return spread.withColumn("key", F.xxhash64("short", "first", "last", *outside))


def _window(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def near_words(words: DataFrame, min_length: int = 7, group: int = 1 << 14) -> DataFrame:
    """(word, near, best_n, best) of words (word, n) that have near words: how many, and the most frequent one."""
    bounded_batches(words.sparkSession, 1 << 14)
    partitions = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A word is among those of its own length, and beside the words one shorter.
    length = F.length("word")
    roles = words.withColumn("short", F.explode(F.when(length > min_length, F.array(length, length - 1)).otherwise(F.array(length))))
    half = F.expr("(short + 1) div 2")
    rows = _dealt(roles, F.array(_window(F.lit(0), half), _window(half, F.col("short") + 1)))
    parts = []
    while True:
        wide = checkpoint(rows.filter("last - first > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > group).select("key"))
        if wide.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(wide, "key", "left_anti"))
        middle = F.expr("(first + last) div 2")
        again = rows.join(wide, "key", "left_semi").select("word", "n", "short", F.array(_window(F.col("first"), middle), _window(middle, F.col("last"))).alias("windows"))
        rows = checkpoint(_dealt(again, F.col("windows")))
    found = None
    for part in parts:
        sorted_ = part.select("short", "first", "last", "key", "word", "n").repartition(partitions, "key").sortWithinPartitions("short", "first", "last", "key")
        near = sorted_.mapInArrow(_near, NEAR)
        found = near if found is None else found.union(near)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("top")).select("word", "near", (-F.col("top.m")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form) without cycles: the last form of each chain, by pointer jumping."""
    now = checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = checkpoint(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_length: int = 7, min_count: int = 2, every: int = 31, ratio: int = 10, group: int = 1 << 14) -> DataFrame:
    """Per word: word, n, n_near, form, form_n, root."""
    words = checkpoint(vocabulary(docs, doc_id, text, min_length, min_count, every))
    near = near_words(words, min_length, group)
    own = F.col("best_n") >= ratio * F.col("n")
    told = words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(own, F.col("best")).alias("form"), F.when(own, F.col("best_n")).alias("form_n"))
    told = checkpoint(told)
    ends = roots(told.filter("form is not null"))
    return told.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(docs: DataFrame) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    return spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")
