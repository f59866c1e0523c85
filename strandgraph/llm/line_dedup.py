"""Line dedup by a distributed suffix array over line-id sequences.

A text is its lines (between line feeds); a line's id is a 64-bit hash.  The
suffixes of all id sequences are ranked by prefix doubling: from ranks by the
first k lines, ranks by the first 2k lines are those of the pairs (rank at i,
rank at i + k); two doublings are done in one round, on (rank at i, i + k,
i + 2k, i + 3k).  Suffixes whose rank is unique are in their final place and
leave; the others stay, so each round handles only runs that repeat.  Suffixes
with one rank at depth k are an LCP interval of depth k or more: one repeated
run and all its places.  Doubling goes on until no run repeats.

A line is deleted if a repeated run of ``min_lines`` or more lines that also
starts earlier (smaller document, then smaller line) covers it, so the first
copy stays.  Overlaps count, and runs are judged on the input.  With
``min_words``, a single line of so many words (runs without ASCII whitespace)
is a run too, whatever its neighbours are.

Equal texts are one sequence, which their smallest doc_id holds; the others
are copies, all of whose lines go if there are ``min_lines`` of them, and else
those of ``min_words``.  Texts themselves are moved only once, to the join with
what is deleted.

Null texts have no lines, an empty text has one empty line.  Rows that share
doc_id and text get the same result.  A null doc_id comes after all others.
Texts whose lines all go become empty, with n_kept 0.  Other columns pass
through; a clash with an output name is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sparkops import checkpoint

WORD = r"[^\x20\x09-\x0D]+"
#: A passage: so many words of one line are deleted without a second line.
PASSAGE = 50
LAST = (1 << 63) - 1


def has_words(line: Column, least: int) -> Column:
    """Whether a line has ``least`` words or more; too short ones are told by their bytes."""
    return F.when(F.octet_length(line) >= 2 * least - 1, F.size(F.regexp_extract_all(line, F.lit(WORD), F.lit(0))) >= least).otherwise(False)


def ranks(keys: DataFrame, *order: str) -> DataFrame:
    """keys (distinct rows) with rank: numbers that ascend in the order given, by a range sort.

    A rank is the number of the row's range and its place in it, so ranks have
    gaps between ranges and need no count over all rows.
    """
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order)
    return checkpoint(ordered.withColumn("rank", F.monotonically_increasing_id()))


def repeated_runs(lines: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """(doc, pos, depth) of suffixes whose first ``depth`` lines also start earlier.

    lines: (doc, pos, id, long), doc and pos giving the order.  ``depth`` is the
    largest ``min_lines * 4 ** k`` reached, so that runs cover just the lines
    that runs of ``min_lines`` lines cover; 1 for a long line in no such run.
    """
    place = F.struct("doc", "pos")
    names = lines.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    active = checkpoint(lines.join(ranks(names, "id"), "id").select("doc", "pos", "rank", "long"))

    def later(rows: DataFrame, depth: int) -> DataFrame:
        # Written, so that the join has plain shuffles on both sides and a hot run's rows can be split.
        first = checkpoint(rows.groupBy("rank").agg(F.min(place).alias("first")))
        return rows.join(first, "rank").filter(place > F.col("first")).select("doc", "pos", F.lit(depth).alias("depth"))

    out = active.select("doc", "pos", F.lit(0).alias("depth")).filter("false")
    if min_words is not None and min_lines > 1:
        out = out.union(later(active.filter("long"), 1))
    active, depth = active.drop("long"), 1
    while not active.isEmpty():
        if depth >= min_lines:
            out = out.union(later(active, depth))
        # Below min_lines depths double, the last of them overlapping; then two doublings make a round.
        if depth < min_lines:
            offsets = [0, min(depth, min_lines - depth)]
        else:
            offsets = [0, depth, 2 * depth, 3 * depth]
        parts = [f"r{j}" for j in range(len(offsets))]
        spread = F.array(*(F.struct((F.col("pos") - o).alias("at"), F.lit(j).alias("j")) for j, o in enumerate(offsets)))
        rows = active.select("doc", "rank", F.explode(spread).alias("s")).select("doc", F.col("s.at").alias("pos"), F.col("s.j").alias("j"), "rank")
        tuples = rows.groupBy("doc", "pos").agg(F.count(F.lit(1)).alias("n"), *(F.max(F.when(F.col("j") == j, F.col("rank"))).alias(r) for j, r in enumerate(parts))).filter(F.col("n") == len(parts)).drop("n")
        names = tuples.groupBy(*parts).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        active = checkpoint(tuples.join(ranks(names, *parts), parts).select("doc", "pos", "rank"))
        depth += offsets[-1]
    return out.groupBy("doc", "pos").agg(F.max("depth").alias("depth"))


def intervals(runs: DataFrame) -> DataFrame:
    """(doc, start, end) of the maximal stretches of lines that runs (doc, pos, depth) cover; end is exclusive.

    One row a stretch, so what follows is linear in lines however long the runs are.
    """
    order = Window.partitionBy("doc").orderBy("pos")
    reach = F.max(F.col("pos") + F.col("depth")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = runs.withColumn("new", F.when(F.col("pos") <= reach, 0).otherwise(1))
    numbered = opened.withColumn("k", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("doc", "k").agg(F.min("pos").alias("start"), F.max(F.col("pos") + F.col("depth")).alias("end")).drop("k")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_lines: int = 2, min_words: int | None = None) -> DataFrame:
    """docs with the text's kept lines, n_lines and n_kept."""
    if clash := {"n_lines", "n_kept", "_doc", "_key", "_gone", "_first", "_lines", "_kept"} & {*docs.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    long = lambda line: F.lit(False) if min_words is None else has_words(line, min_words)
    doc = F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))
    texts = docs.select(doc.alias("doc"), F.xxhash64(text, F.octet_length(text)).alias("key"), F.col(text).alias("text")).filter("text is not null")
    exploded = texts.select("key", "doc", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("key", "doc", "pos", F.xxhash64("line").alias("id"), long(F.col("line")).alias("long"))
    # Copies collapse before the shuffle; the smallest doc_id stands for a text.
    lines = checkpoint(exploded.groupBy("key", "pos", "id").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("copies"), F.first("long").alias("long")))
    order = F.struct("doc", "key")
    sequences = lines.select(order.alias("doc"), "pos", "id", "long")
    runs = repeated_runs(sequences, min_lines, min_words)
    gone = intervals(runs).groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    shared = lines.filter("pos = 0 and copies > 1").select("key", F.col("doc").alias("_first"))
    told = gone.select(F.col("doc.key").alias("key"), "_gone").join(shared, "key", "full").withColumnRenamed("key", "_key")
    told = checkpoint(told)
    keyed = docs.withColumns({"_doc": doc, "_key": F.xxhash64(text, F.octet_length(text))})
    joined = keyed.join(told.hint("shuffle_hash"), "_key", "left")
    split = joined.withColumn("_lines", F.split(text, "\n", -1))
    copy = F.col("_first").isNotNull() & (F.col("_doc") > F.col("_first"))
    whole = copy & (F.size("_lines") >= min_lines)
    # What is kept lies between the intervals: from the end of one to the start of the next, or to the last line.
    ends = F.concat(F.array(F.lit(0)), F.transform("_gone", lambda g: g["end"]))
    start_after = lambda i, lines: F.coalesce(F.get(F.col("_gone"), i)["start"], F.size(lines))
    piece = lambda lines: F.transform(ends, lambda end, i: F.slice(lines, end + 1, start_after(i, lines) - end))
    # Bound by the outer lambda, the lines are split once.
    without_gone = lambda lines: F.flatten(piece(lines))
    kept = (
        F.when(F.col(text).isNull(), F.expr("cast(array() as array<string>)"))
        .when(whole, F.expr("cast(array() as array<string>)"))
        .when(copy, F.filter("_lines", lambda line: ~long(line)))
        .when(F.col("_gone").isNull(), F.col("_lines"))
        .otherwise(F.flatten(F.transform(F.array("_lines"), without_gone)))
    )
    out = split.withColumn("_kept", kept)
    return out.select(
        *(F.when(F.col(text).isNotNull(), F.array_join("_kept", "\n")).alias(text) if c == text else F.col(c) for c in docs.columns),
        F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.size("_kept").cast("long").alias("n_kept"),
    )


def op2_line_dedup(docs: DataFrame, min_words: int | None = None) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_chars, kept_sha256 (null text: none)."""
    done = dedup_lines(docs.select("doc_id", "text"), min_words=min_words)
    return done.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
