"""Exact n-gram Jaccard join by filters under several global token orders.

A document is the set of its distinct ``n``-word shingles; two link when
``100 * |x & y| >= percent * |x | y|``.  If x and y link, then under *any* total
order of all tokens their prefixes of length ``size - ceil(t * size) + 1``
share a token.  So candidates are pairs that share prefix tokens under each of
several orders, and the sets of pairs that each order allows are intersected
before any pair is verified on whole sets.

1. One pass over the documents gives each set's size and 64-bit key (equal
   sets are one node from then on) and, dealt by token, the tokens of a prefix
   of twice the length under a hash order.  A document can link with another
   text only if enough of these occur elsewhere; the rest, most of a corpus,
   are done.  Tokens are dealt as packed arrays, one for each task and bucket.
2. Survivors' sets are made again from their texts.  Exact frequencies among
   them give the first order (rare tokens first, then by hash); nodes that
   share a token of their prefixes are candidates.
3. Nodes lie in blocks of at most ``block`` similar ones.  For two blocks with
   candidates, those nodes meet in one task, which intersects the candidates of
   all orders and verifies what is left.  A large family of near copies is thus
   spread over many tasks of bounded size; no list of all its pairs is made.
4. Each task returns one row for each linked node, with its local component
   and number of links; components are joined over all tasks.

Every pair of nodes is verified in exactly one task, so link counts are exact.

Null or empty texts (no words) have no shingles and link with nothing; fewer
than ``n`` words are one shingle.  Repeated rows are copies of each other.
Rows without a doc_id stay in the result, linked with nothing.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesops as B
from .components import components
from .sparkops import bounded_batches, checkpoint

#: Words end at space, tab, line feed, vertical tab, form feed and carriage return only.
WORD = np.ones(256, bool)
WORD[[32, 9, 10, 11, 12, 13]] = False
#: Seeds of the hash orders that candidates must pass besides the first; they do not look at frequencies.
ORDERS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: A token with over 1 / HEAVY of all rows is looked up in a broadcast table: there are fewer than HEAVY of these.
HEAVY = 4096


def need(size, percent: int):
    """Least overlap of a set of this size with any set it links with."""
    return -((-size * percent) // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, powers: B.Powers) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, rows) of the distinct shingles of each row, by row, then token."""
    starts, ends, rows = B.word_spans(data, offsets, WORD)
    words = B.span_hashes(data, starts, ends, B.LOWER_VALUES, powers)
    valid = B.gram_valid(rows, n)
    tokens, owner = [B.gram_hashes(words, n)[valid]], [rows[: len(valid)][valid]]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    for k in range(1, n):  # whole sequences that are shorter than a shingle
        few = counts[rows] == k
        w, r = words[few], rows[few]
        valid = B.gram_valid(r, k)
        tokens.append(B.gram_hashes(w, k)[valid])
        owner.append(r[: len(valid)][valid])
    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    keep = np.ones(len(tokens), bool)
    keep[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    return tokens[keep], owner[keep]


def set_keys(tokens: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, key) of each row's set."""
    size = np.bincount(owner, minlength=rows)
    mixed, key = B.mix64(tokens + np.uint64(0x632BE59BD9B4E019)), np.zeros(rows, np.uint64)
    filled = np.flatnonzero(size)
    if len(filled):
        key[filled] = np.add.reduceat(mixed, np.concatenate([[0], np.cumsum(size[filled])[:-1]]))
    return size, B.mix64(key + size.astype(np.uint64)).view(np.int64)


def _first_pass(n: int, percent: int, buckets: int):
    """(bucket, docs, slots, tokens, needs), all packed, docs and slots as differences; rows without slots hold sizes and keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = B.Powers()
        names = ["bucket", "docs", "slots", "tokens", "needs"]
        held, count, turn = [], 0, 0

        def packed(bucket: int, *parts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in parts)], names=names)

        def flush() -> Iterator[pa.RecordBatch]:
            tokens, docs, needs = (np.concatenate([h[i] for h in held]) for i in range(3))
            tokens = B.mix64(tokens ^ np.uint64(ORDERS[0]))  # a prefix holds small hashes only
            bucket = ((tokens >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((docs, bucket))
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                own = order[edges[k] : edges[k + 1]]
                if len(own):
                    used, first, slots = np.unique(docs[own], return_index=True, return_inverse=True)
                    low = ((tokens[own] * np.uint64(buckets)) >> np.uint64(32)).astype(np.uint32)
                    yield packed(k, np.diff(used, prepend=0), np.diff(slots, prepend=0).astype(np.uint8), low, np.minimum.reduceat(needs[own], first))

        for batch, data, offsets in B.pieces(batches, 1):
            tokens, owner = shingle_sets(data, offsets, n, powers)
            size, key = set_keys(tokens, owner, batch.num_rows)
            known = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy()
            turn += 1
            yield packed(turn * 7919 % buckets, ids, None, np.stack([size, key, known.astype(np.int64)]), None)
            least = need(size, percent)
            length = np.minimum(size, 2 * (size - least + 1))
            # What a prefix shares with that of the smallest set it may link with.
            small = need(size, percent)
            needs = np.minimum(need(small, percent), small - need(small, percent) + 2)
            place = np.arange(len(tokens)) - np.repeat(np.concatenate([[0], np.cumsum(size)[:-1]]), size)
            mine = (place < length[owner]) & known[owner]
            held.append((tokens[mine], ids[owner[mine]], needs.astype(np.int32)[owner[mine]]))
            count += int(mine.sum())
            if count > 1_500_000:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return run


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, needs, shared) where shared counts the tokens of a bucket that another document has too; (doc_id, n, node) of keys."""
    names = ["doc_id", "needs", "shared", "n", "node"]
    by: dict[int, list] = {}
    for batch in batches:
        for bucket, docs, slots, tokens, needs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if slots is not None:
                by.setdefault(bucket, []).append((docs, slots, tokens, needs))
            else:
                size, key, known = np.frombuffer(tokens, np.int64).reshape(3, -1)
                none = pa.nulls(len(size), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64), mask=known == 0), none, none, pa.array(size), pa.array(key)], names=names)
    for parts in by.values():
        ids = [np.cumsum(np.frombuffer(p[0], np.int64)) for p in parts]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        ids, needs = np.concatenate(ids), np.concatenate([np.frombuffer(p[3], np.int32) for p in parts])
        slots = np.concatenate([np.cumsum(np.frombuffer(p[1], np.uint8), dtype=np.int64) + s for p, s in zip(parts, starts, strict=False)])
        tokens = np.concatenate([np.frombuffer(p[2], np.uint32) for p in parts])
        order = np.argsort(tokens, kind="stable")
        tokens, slots = tokens[order], slots[order]
        same = tokens[1:] == tokens[:-1]
        shared = np.zeros(len(tokens), bool)
        shared[1:] |= same
        shared[:-1] |= same
        counts = np.bincount(slots[shared], minlength=len(ids))
        some = np.flatnonzero(counts)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[part]), pa.array(needs[part].astype(np.int64)), pa.array(counts[part].astype(np.int64)), none, none], names=names)


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = B.Powers()
        for batch, data, offsets in B.pieces(batches, 1):
            tokens, owner = shingle_sets(data, offsets, n, powers)
            size, key = set_keys(tokens, owner, batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(tokens.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(size.astype(np.int64)), lists], names=["node", "n", "tokens"])

    return run


def _prefix_pairs(tokens, owner, size, shared, least, hashes, levels) -> np.ndarray:
    """Codes first * count + second (first < second) of nodes whose prefixes share a token under an order."""
    order = np.lexsort((hashes, levels, owner))
    place = np.arange(len(tokens)) - np.repeat(np.concatenate([[0], np.cumsum(shared)[:-1]]), shared)
    # Tokens that no other node has come first in every order.
    inside = place + (size - shared)[owner[order]] < (size - least + 1)[owner[order]]
    t, o = tokens[order][inside], owner[order][inside]
    by = np.lexsort((o, t))
    t, o = t[by], o[by]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([first, [len(t)]]))
    count = len(size)
    codes = [np.zeros(0, np.int64)]
    for k in np.unique(length[length > 1]):
        lists = o[first[length == k][:, None] + np.arange(k)]
        a, b = np.triu_indices(int(k), 1)
        codes.append(np.unique(lists[:, a].astype(np.int64) * count + lists[:, b]))
    return np.unique(np.concatenate(codes))


def _verify(percent: int):
    """Links among the nodes of two blocks, or of one: (node, root, links, own)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        size = table["n"].to_numpy()
        node = table["node"].to_numpy()
        block = table["block"].to_numpy()
        times = table["times"].to_numpy()
        lists = table["tokens"].combine_chunks() if isinstance(table["tokens"], pa.ChunkedArray) else table["tokens"]
        if isinstance(lists, pa.ChunkedArray):
            lists = pa.concat_arrays(lists.chunks)
        level_lists = table["levels"].combine_chunks()
        if isinstance(level_lists, pa.ChunkedArray):
            level_lists = pa.concat_arrays(level_lists.chunks)
        shared = np.asarray(lists.value_lengths())
        tokens = lists.flatten().to_numpy().view(np.uint64)
        levels = level_lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(size)), shared)
        least = need(size, percent)
        between = bool(block.min() != block.max())
        codes = _prefix_pairs(tokens, owner, size, shared, least, tokens, levels)
        for seed in ORDERS:
            if len(codes):
                codes = np.intersect1d(codes, _prefix_pairs(tokens, owner, size, shared, least, B.mix64(tokens ^ np.uint64(seed)), np.zeros(len(tokens), np.int32)), assume_unique=True)
        a, b = codes // len(size), codes % len(size)
        fits = (np.minimum(size[a], size[b]) * 100 >= np.maximum(size[a], size[b]) * percent) & ((block[a] != block[b]) | (not between))
        a, b = a[fits], b[fits]
        common = np.zeros(len(a), np.int64)
        if len(a):
            ends = np.cumsum(shared)
            starts = ends - shared
            if len(a) < 4 * len(size):
                ordered = tokens[np.lexsort((tokens, owner))]
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    common[i] = len(np.intersect1d(ordered[starts[x] : ends[x]], ordered[starts[y] : ends[y]], assume_unique=True))
            else:
                used = np.unique(np.concatenate([a, b]))
                row = np.full(len(size), -1)
                row[used] = np.arange(len(used))
                mine = row[owner] >= 0
                names, column = np.unique(tokens[mine], return_inverse=True)
                overlap = np.zeros((len(used), len(used)), np.float32)
                rows = row[owner[mine]]
                for at in range(0, len(names), 8192):
                    part = (column >= at) & (column < at + 8192)
                    dense = np.zeros((len(used), min(8192, len(names) - at)), np.float32)
                    dense[rows[part], column[part] - at] = 1
                    overlap += dense @ dense.T
                common = overlap[row[a], row[b]].astype(np.int64)
        linked = common * 100 >= percent * (size[a] + size[b] - common)
        a, b = a[linked], b[linked]
        links = np.bincount(a, times[b], len(size)) + np.bincount(b, times[a], len(size))
        root = np.arange(len(size))
        while len(a):
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        has = links > 0
        return pa.table({"node": node[has], "root": node[root[has]], "links": links[has].astype(np.int64), "own": np.full(int(has.sum()), not between)})

    return run


def _by_token(rows: DataFrame, table: DataFrame, count: str, total: int) -> DataFrame:
    """rows joined with table by token, without a task that gets all rows of a frequent one.

    table has one row a token, ``count`` of ``rows`` have it, and there are
    ``total`` rows.  Tokens with more than total / HEAVY rows are broadcast,
    their rows stay where they are; the others are joined by a shuffle.
    """
    heavy = F.col(count) * HEAVY > total
    few, many = F.broadcast(table.filter(heavy)), table.filter(~heavy)
    return rows.join(few, "token").unionByName(rows.join(few.select("token"), "token", "left_anti").join(many, "token"))


def meeting(prefix: DataFrame, percent: int, block: int) -> DataFrame:
    """(b1, b2, node): the nodes of (token, node, n, block) that two blocks, or one, have to compare.

    Rows are one for each token and block, with the nodes that have it: no more
    than a block holds, however frequent the token.  A token of more nodes than
    a block holds would meet each of them with each block: such tokens pair
    blocks, and all their nodes in those meet.
    """
    held = prefix.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.collect_list(F.struct("node", "n")).alias("members"))
    held = checkpoint(held)
    everywhere = held.groupBy("token").agg(F.sum(F.size("members")).alias("k")).filter("k > 1")
    held = checkpoint(held.join(everywhere, "token"))
    there = held.select("token", F.col("block").alias("other"), F.col("low").alias("olow"), F.col("high").alias("ohigh"), "k")
    near = f"ohigh * 100 >= {percent} * low and high * 100 >= {percent} * olow"
    rare = held.filter(F.col("k") <= block).drop("k").join(there.filter(F.col("k") <= block).drop("k"), "token").filter(f"(block <> other or size(members) > 1) and {near}")
    fits = F.filter("members", lambda m: (m["n"] * 100 >= F.col("olow") * percent) & (F.col("ohigh") * 100 >= m["n"] * percent))
    rare = rare.select(F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), F.explode(fits["node"]).alias("node"))
    dense = held.filter(F.col("k") > block).drop("k")
    pairs = dense.join(there.filter(F.col("k") > block).drop("k"), "token").filter(f"(block < other or block = other and size(members) > 1) and {near}")
    pairs = pairs.select(F.col("block").alias("b1"), F.col("other").alias("b2")).distinct()
    both = pairs.select("b1", "b2", F.col("b1").alias("block")).union(pairs.filter("b1 < b2").select("b1", "b2", F.col("b2").alias("block")))
    nodes = dense.select("block", F.explode("members.node").alias("node")).distinct()
    return rare.union(both.join(nodes, "block").select("b1", "b2", "node")).distinct()


def _sum(df: DataFrame, what: str) -> int:
    return df.agg(F.sum(F.expr(what)).alias("s")).first()["s"] or 0


def ngram_jaccard_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 4, percent: int = 85, block: int = 128) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_links (other documents linked with it)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    packed = read.mapInArrow(_first_pass(n, percent, buckets), "bucket int, docs binary, slots binary, tokens binary, needs binary")
    told = packed.repartition("bucket").mapInArrow(_shared_counts, "doc_id long, needs long, shared long, n long, node long")
    # Texts that share an id are counted together against the smallest of their needs, which lets all that may link survive.
    # Rows without an id are spread by their key.
    salt = F.when(F.col("doc_id").isNull(), F.col("node")).otherwise(F.lit(0))
    key = F.when(F.col("node").isNotNull(), F.struct("n", "node"))
    told = checkpoint(told.groupBy("doc_id", salt.alias("salt")).agg(F.sum("shared").alias("shared"), F.min("needs").alias("needs"), F.collect_list(key).alias("keys")))
    keys = told.select("doc_id", F.inline("keys")).withColumnRenamed("n", "n_shingles")
    survivors = told.filter("doc_id is not null and shared >= needs").select("doc_id")

    # One document stands for each set; copies were only counted.
    classes = keys.filter("doc_id is not null and n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times"), F.first("n_shingles").alias("n"))
    classes = checkpoint(classes)
    standing = classes.select(F.col("first").alias("doc_id")).join(survivors, "doc_id", "left_semi").distinct()
    chosen = read.filter("doc_id is not null").join(standing.hint("shuffle_hash"), "doc_id", "left_semi")
    sets = checkpoint(chosen.mapInArrow(_sets(n), "node long, n long, tokens array<long>").filter("n > 0"))

    each = sets.select("node", F.explode("tokens").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token", F.floor(F.log2("df")).cast("int").alias("level"), "df")
    common = _by_token(each, often, "df", _sum(sets, "size(tokens)"))
    common = common.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("level", "token"))).alias("shared"))
    least = f"cast(ceil(n * {percent} / 100.0) as int)"
    common = common.join(classes.select("node", "n", "times"), "node").filter(f"size(shared) >= {least}")
    nodes = checkpoint(common.select("node", "n", "times", F.col("shared.level").alias("levels"), F.col("shared.token").alias("tokens"), F.array_min("shared.token").alias("near")))

    # Similar nodes lie together: ordered by a min-hash, then size.
    placed = nodes.select("node", "near", "n").repartitionByRange("near", "n", "node").sortWithinPartitions("near", "n", "node")
    row = F.monotonically_increasing_id()
    placed = checkpoint(placed.select("node", (F.shiftright(row, 33) * (1 << 33) + F.floor(row.bitwiseAND(F.lit((1 << 33) - 1)) / block)).alias("block")))
    nodes = checkpoint(nodes.drop("near").join(placed, "node"))
    length = f"size(tokens) - {least} + 1"
    prefix = nodes.select("node", "n", "block", F.explode(F.expr(f"slice(tokens, 1, {length})")).alias("token"))
    meet = meeting(prefix, percent, block)
    groups = meet.join(nodes, "node").groupBy("b1", "b2")
    found = checkpoint(groups.applyInArrow(_verify(percent), "node long, root long, links long, own boolean"))

    # Components within blocks first, so that between blocks only these are joined.
    local = checkpoint(classes.select("node", "first").join(found.filter("own").select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first"))
    rank = local.groupBy("root").agg(F.min("first").alias("rank")).withColumnRenamed("root", "node")
    to = local.filter("node <> root").select("node", F.col("root").alias("to"))
    crossing = found.filter("not own and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    crossing = crossing.join(to.withColumnsRenamed({"node": "a", "to": "la"}), "a", "left").join(to.withColumnsRenamed({"node": "b", "to": "lb"}), "b", "left")
    crossing = crossing.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b").distinct()
    rank = checkpoint(rank)
    joined = components(crossing, rank)
    labels = local.select("node", "root").join(rank.withColumnRenamed("node", "root"), "root").join(joined.withColumnsRenamed({"node": "root", "label": "wide"}), "root", "left").select("node", F.coalesce("wide", "rank").alias("label"))
    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = checkpoint(classes.join(labels, "node", "left").join(degree, "node", "left"))
    out = keys.join(classes, "node", "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(linked, F.coalesce("label", "first")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(linked, F.coalesce("links", F.lit(0)) + F.col("times") - 1).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )
