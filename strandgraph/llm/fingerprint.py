"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs (lines, cut further behind sentence
ends).  Each paragraph is hashed to a wide vector, and a fingerprint is the sum
of these vectors modulo powers of two, so it does not depend on their order,
and paragraphs are inserted or deleted by adding or subtracting their vectors
(``combine``) without the rest of the text.

A paragraph's vector has its count, 8 dense lanes modulo 2**32 of its hash
(equality), and sparse lanes modulo 2**53 (likeness) from its windows of
``WINDOW`` words: at level k a window takes part with probability 4**-k and
adds its value and a count to one of ``LANES`` lanes.  Levels with more than
``FULL`` lanes in use tell nothing and are not kept, so a fingerprint is short
however long the text is; after a deletion of most of a text its likeness is
only as fine as the levels that are left.  Two fingerprints are compared at the
first level that both have.  There, lanes with equal sums tell how many windows
differ, and those of them in use how many are shared; likeness is the share of
common windows (twice those shared by the windows of both); where windows
repeat, lanes whose sums are in proportion to their counts tell as much.  So a
text of which a quarter was replaced has about 0.75 in common with itself, an
unrelated one about 0.  ``LEVELS`` levels are enough for 2**30 windows, more
than a text of 2 GB holds.

Null and empty texts have the zero fingerprint; two of these are alike (1.0),
and no other text is like them (0.0).  Equal texts have equal fingerprints; so
have texts with the same paragraphs in another order.  A text's cost grows with
its length, whatever its lines are.  An empty table gives an empty result;
columns besides doc_id and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkops import checkpoint

PARAGRAPH_BREAK = r"\n+|(?<=[.!?])[ \t]+"
LEVELS, LANES, WINDOW = 13, 64, 3
#: Most lanes in use of a level that is kept: about a window a lane.
FULL = 40
DENSE_MASK, LANE_MASK = 0xFFFFFFFF, (1 << 53) - 1
#: A lane is one number: level (from bit 59), lane (53), count of windows (29), sum of their 12-bit values.
LEVEL_BIT, KEY_BIT, COUNT_BIT = 59, 53, 29


def _kept(lanes: Column) -> Column:
    """Lanes (ascending) from the first level on that has at most ``FULL`` in use."""

    def first(levels: Column) -> Column:
        def used(k: int) -> Column:
            # Levels ascend, and what is in one is in all above that are there.
            at, after = F.array_position(levels, k), F.array_position(levels, k + 1)
            return F.when(at == 0, LANES).otherwise(F.when(after == 0, F.size(levels) + 1).otherwise(after) - at)

        out = F.lit(LEVELS - 1)
        for k in range(LEVELS - 2, -1, -1):
            out = F.when(used(k) <= FULL, k).otherwise(out)
        return out

    of = F.transform(F.array(F.transform(lanes, lambda e: F.shiftright(e, LEVEL_BIT).cast("int"))), first)
    return F.flatten(F.transform(of, lambda k: F.filter(lanes, lambda e: F.shiftright(e, LEVEL_BIT) >= k)))


def fingerprint(text: str) -> Column:
    """struct<n, windows, dense array<bigint>, lanes array<bigint>> of a column; lanes in use, ascending."""
    units = f"filter(split(coalesce({text}, ''), '{PARAGRAPH_BREAK}', -1), u -> u != '')".replace("\\", "\\\\")
    lanes_of = lambda h, i: f"s[{i}] + (shiftrightunsigned(xxhash64({h}, {i // 2}), {32 * (i % 2)}) & {DENSE_MASK}L)"
    dense = f"aggregate(transform(p, u -> xxhash64(u)), array_repeat(0L, 8), (s, h) -> array({', '.join(f'({lanes_of("h", i)}) & {DENSE_MASK}L' for i in range(8))}))"
    # transform(array(e), x -> ...)[0] binds x, so that e is computed once.
    windows = f"flatten(transform(p, u -> transform(array(split(u, '[ \\\\t]+', -1)), w -> transform(sequence(0, greatest(0, size(w) - {WINDOW})), i -> xxhash64({', '.join(f'get(w, i + {j})' for j in range(WINDOW))})))[0]))"
    # Levels below this one have four distinct windows a lane or more.
    lowest = f"greatest(0, cast(ceil(log2(greatest(1, size(array_distinct(y))) / {LANES}.0D) / 2) as int) - 1)"
    # A window's highest level is half the number of zeros at its hash's end.
    low = f"((h & {(1 << 2 * LEVELS) - 1}L) | {1 << 2 * (LEVELS - 1)}L)"
    level = f"cast(bit_count(({low} & -{low}) - 1) div 2 as int)"
    entry = f"(shiftleft(cast(k * {LANES} as bigint) + (shiftrightunsigned(h, 30) & {LANES - 1}), {KEY_BIT}) + {1 << COUNT_BIT}L + (shiftrightunsigned(h, 40) & 4095))"
    sampled = "filter(y, h -> (h & (shiftleft(1L, 2 * k0) - 1)) = 0)"
    entries = f"sort_array(flatten(transform({sampled}, h -> transform(sequence(k0, {level}), k -> {entry}))))"
    step = f"""if(s.now < 0, named_struct('out', s.out, 'now', e), if(shiftright(s.now, {KEY_BIT}) = shiftright(e, {KEY_BIT}),
        named_struct('out', s.out, 'now', (s.now & {~LANE_MASK & (1 << 63) - 1}L) | ((s.now & {LANE_MASK}L) + (e & {LANE_MASK}L) & {LANE_MASK}L)),
        named_struct('out', array_append(s.out, s.now), 'now', e)))"""
    lanes = f"aggregate({entries}, named_struct('out', cast(array() as array<bigint>), 'now', -1L), (s, e) -> {step}, s -> if(s.now < 0, s.out, array_append(s.out, s.now)))"
    lanes = f"transform(array(least({lowest}, {LEVELS - 1})), k0 -> {lanes})[0]"
    body = f"transform(array({windows}), y -> named_struct('n', cast(size(p) as bigint), 'windows', cast(size(y) as bigint), 'dense', {dense}, 'lanes', {lanes}))[0]"
    whole = F.expr(f"transform(array({units}), p -> {body})")
    return F.get(F.transform(whole, lambda f: F.struct(f["n"].alias("n"), f["windows"].alias("windows"), f["dense"].alias("dense"), _kept(f["lanes"]).alias("lanes"))), 0)


def _lane_map(lanes: Column) -> Column:
    return F.map_from_arrays(F.transform(lanes, lambda e: F.shiftright(e, KEY_BIT)), F.transform(lanes, lambda e: e.bitwiseAND(F.lit(LANE_MASK))))


def _first_common(a: Column, b: Column) -> Column:
    """The first level that both sets of lanes have kept."""
    of = lambda x: F.coalesce(F.shiftright(F.get(x, 0), LEVEL_BIT), F.lit(0).cast("long"))
    return F.greatest(of(a), of(b))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The fingerprint of both multisets together (sign 1) or of left without right (-1)."""
    dense = F.zip_with(left["dense"], right["dense"], lambda a, b: (a + sign * b).bitwiseAND(F.lit(DENSE_MASK)))
    level = _first_common(left["lanes"], right["lanes"])
    kept = lambda p: _lane_map(F.filter(p["lanes"], lambda e: F.shiftright(e, LEVEL_BIT) >= level))
    sums = F.map_zip_with(kept(left), kept(right), lambda _, a, b: (F.coalesce(a, F.lit(0)) + sign * F.coalesce(b, F.lit(0))).bitwiseAND(F.lit(LANE_MASK)))
    lanes = F.sort_array(F.transform(F.filter(F.map_entries(sums), lambda e: e["value"] != 0), lambda e: F.shiftleft(e["key"], KEY_BIT) + e["value"]))
    return F.struct((left["n"] + sign * right["n"]).alias("n"), (left["windows"] + sign * right["windows"]).alias("windows"), dense.alias("dense"), _kept(lanes).alias("lanes"))


def text_form(print_: Column) -> Column:
    """A fingerprint as hexadecimal text: counts and dense lanes, then the sparse lanes in use."""
    wide = F.transform(F.concat(F.array(print_["n"], print_["windows"]), print_["dense"]), lambda v: F.lpad(F.lower(F.hex(v)), 8, "0"))
    lanes = F.transform(print_["lanes"], lambda e: F.lower(F.hex(e)))
    return F.concat(F.array_join(wide, ""), F.lit("-"), F.array_join(lanes, "."))


def likeness(a: Column, b: Column) -> Column:
    """Share of common windows, from 0 to 1, by the lanes of the first level that both have."""
    at = lambda p, k: _lane_map(F.filter(p["lanes"], lambda e: F.shiftright(e, LEVEL_BIT) == k))

    def compared(z: Column) -> Column:
        count = lambda total: F.shiftright(total, COUNT_BIT)
        value = lambda total: total.bitwiseAND(F.lit((1 << COUNT_BIT) - 1))
        windows = lambda m: F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda s, x: s + count(x))

        def lane(_: Column, x: Column, y: Column) -> Column:
            # Sums in proportion to their counts are those of the same windows, repeated more or less often.
            like = value(x) * count(y) == value(y) * count(x)
            return F.struct((x == y).alias("equal"), F.when(like, F.least(count(x), count(y))).alias("shared"))

        both = F.map_values(F.map_zip_with(z["a"], z["b"], lane))
        return F.struct(
            (windows(z["a"]) + windows(z["b"])).alias("both"),
            (LANES - F.size(both)).alias("unused"),
            F.size(F.filter(both, lambda e: e["equal"])).alias("equal"),
            F.aggregate(both, F.lit(0).cast("long"), lambda s, e: s + F.coalesce(e["shared"], F.lit(0))).alias("shared"),
        )

    def told(c: Column) -> Column:
        share = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
        same = c["unused"] + c["equal"]
        # Lanes without a window that differs number e ** (-differing / LANES) of all; those of them without any, e ** (-shared / LANES).
        by_differing = share(1 + LANES * F.log(F.greatest(same, F.lit(0.5)) / LANES) / c["both"])
        by_shared = share(2 * LANES * F.log(same / F.greatest(c["unused"], F.lit(0.5))) / c["both"])
        mixed = F.when(c["equal"] > 0, by_differing * by_differing + (1 - by_differing) * by_shared).otherwise(0.0)
        return F.when(c["both"] == 0, 0.0).otherwise(F.greatest(mixed, share(2 * c["shared"] / c["both"])))

    pair = F.transform(F.array(_first_common(a["lanes"], b["lanes"])), lambda k: F.struct(at(a, k).alias("a"), at(b, k).alias("b")))
    estimate = F.get(F.transform(F.transform(pair, compared), told), 0)
    return F.when((a["n"] == b["n"]) & (a["dense"] == b["dense"]), 1.0).otherwise(estimate)


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """key and next_key of distinct non-null ids, in ascending order; the first follows the last.

    Ids are dealt by range; each range looks ahead within itself, and a table
    with one row for each range tells what follows its last id.
    """
    ranged = checkpoint(ids.select(key).repartitionByRange(key).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range").orderBy(key)
    firsts = ranged.groupBy("_range").agg(F.min(key).alias("_first"))
    whole = Window.partitionBy(F.lit(0))
    following = firsts.select("_range", F.coalesce(F.lead("_first").over(whole.orderBy("_range")), F.min("_first").over(whole)).alias("_follows"))
    looked = ranged.withColumn("_next", F.lead(key).over(within))
    return looked.join(F.broadcast(following), "_range").select(key, F.coalesce("_next", "_follows").alias("next_key"))


def op9_fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null doc_id comes before all others.  Rows that share a doc_id all have
    the same next document; of several rows with the next doc_id the smallest
    text is taken.
    """
    lowest = F.lit(-(1 << 63)).cast("long")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k"), F.coalesce("text", F.lit("")).alias("text")).withColumn("print", fingerprint("text"))
    lengths = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), lowest).alias("k")).agg(F.coalesce(F.max(F.length("text")), F.lit(0)).alias("n"))
    lengths = checkpoint(lengths)
    follows = next_ids(lengths, "k").join(lengths, "k")
    wanted = follows.select(F.col("next_key").alias("k"), F.col("k").alias("before"), F.expr("n div 4").cast("int").alias("take"))
    heads = base.join(wanted, "k").select(F.col("before").alias("k"), F.struct(F.expr("substring(text, 1, take)").alias("head"), F.col("print").alias("next_print")).alias("after"))
    heads = heads.groupBy("k").agg(F.min("after").alias("after"))
    both = base.join(heads, "k").withColumn("n_chars", F.length("text").cast("long"))
    tail = F.expr("cast(n_chars div 4 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail), F.substring("after.head", F.lit(1), tail))
    both = both.withColumn("edited", edited).withColumn("edited_print", fingerprint("edited"))
    return both.select(
        F.when(F.col("k") != lowest, F.col("k")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_form(F.col("print")).alias("fingerprint"),
        text_form(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("after.next_print")).alias("near_next"),
    )
