"""Each operator against a plain version, and on awkward tables."""

import os
import random
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from strandgraph.llm import chat, components, decontam, fingerprint, line_dedup, ngram_join, pii, quality, queries, sentencepiece_table, shard, suffix_dedup


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("options", [{}, {"block": 1}, {"block": 2, "n": 5, "percent": 80}])
def test_ngram_join(docs, plain, options):
    got = rows_of(ngram_join.ngram_jaccard_join(docs, **options), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == sorted(brute.op1(plain, options.get("n", 4), options.get("percent", 85)))


def test_ngram_join_hot_group(spark):
    """A large family of near copies over blocks of two."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    plain = []
    for d in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"e{d}"
        plain.append((d, " ".join(w)))
    df = spark.createDataFrame(plain, "doc_id long, text string")
    got = rows_of(ngram_join.ngram_jaccard_join(df, block=2), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == sorted(brute.op1(plain))


@pytest.mark.parametrize("heavy", [2, 40, 1 << 40])
def test_ngram_join_frequent_tokens(spark, monkeypatch, heavy):
    """Tokens that are broadcast or shuffled, frequent ones in a third of all texts: the same links."""
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    rng = random.Random(5)
    plain = [(d, " ".join(["the same five words again"] * (d % 3 == 0) + [f"v{rng.randrange(30)}" for _ in range(4)] + [f"w{d // 4}-{i}" for i in range(40)])) for d in range(90)]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    got = rows_of(ngram_join.ngram_jaccard_join(df, block=2), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == sorted(brute.op1(plain)) and any(r[3] for r in got)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    rank = spark.createDataFrame([(i, 1000 - i) for i in [*range(41), 100, 101]], "node long, rank long")
    got = {r["node"]: r["label"] for r in components.components(edges, rank).collect()}
    assert got == {**{i: 960 for i in range(41)}, 100: 899, 101: 899}


@pytest.mark.parametrize("m", [1, 2, 3])
def test_line_dedup(docs, plain, m):
    done = line_dedup.dedup_lines(docs.select("doc_id", "text"), min_lines=m)
    got = rows_of(done.select("doc_id", "n_lines", (F.col("n_lines") - F.col("n_kept")).alias("g"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "doc_id", "n_lines", "g", "h")
    assert got == sorted(brute.op2(plain, m))


def test_line_runs_within_a_document(spark):
    plain = [(1, "a\nb\na\nb\na\nb\nc"), (2, "x\na\nb\nc\nx"), (3, "\n\n\n\n")]
    got = rows_of(line_dedup.op2_line_dedup(spark.createDataFrame(plain, "doc_id long, text string")), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == sorted(brute.op2(plain))


BENCH = [(1, None), (2, ""), (3, "one two"), (10, " ".join(f"w{i}" for i in range(5, 40))), (11, "W9 w8, w7")]


@pytest.fixture(scope="module")
def bench(spark, plain):
    words = next(t for _, t in plain if t and len(t.split()) > 80 and "\n" in t).split()
    items = BENCH + [(20, " ".join(words[5:30])), (21, " ".join(words[10:20])), (22, "-- ".join(words[40:52]).upper())]
    return items, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block_bytes", [32 << 20, 100])
def test_decontamination(docs, plain, bench, block_bytes):
    items, frame = bench
    found = decontam.decontaminate(docs.select("doc_id", "text"), frame, block_bytes=block_bytes, blocks_per_pass=2)
    got = rows_of(found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("h"), (F.col("n_hit") > 0).alias("c")), "doc_id", "n_words", "n_hit", "n", "h", "c")
    assert got == sorted(brute.op3(plain, items)) and any(r[5] for r in got)


def test_shards(docs, plain):
    got = shard.op4_hilbert_shards(docs, 7).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(got) == len(plain) and max(sizes.values()) - min(sizes.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = dict(plain)
    assert all((r["size"], r["text_crc32"]) == (len((texts[r["doc_id"]] or "").encode()) + 8, zlib.crc32((texts[r["doc_id"]] or "").encode())) for r in got)
    order = [r["hilbert"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_hilbert_curve_steps_by_one():
    import numpy as np

    side = np.arange(8)
    for d in (2, 3):
        points = np.stack(np.meshgrid(*[side] * d, indexing="ij"), -1).reshape(-1, d)
        index = shard.hilbert([points[:, i] for i in range(d)], 3)
        assert sorted(index) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(index)], axis=0)).sum(1) == 1).all()


def test_small_buckets_keep_the_law(docs):
    df = docs.select("doc_id", "lang", "source")
    got = shard.hilbert_shards(df, shard.curve(shard.category(df, "lang"), shard.category(df, "source")), 5, "doc_id", bucket_rows=3).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(s, i) for s in range(5) for i in range(sum(r["shard"] == s for r in got))]


def test_pii(docs, plain, spark):
    got = rows_of(pii.op5_pii(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == sorted(brute.op5(plain))
    rng = random.Random(2)
    alphabet = list("aB1.@+- ()_%:é\n0245") + ["4111111111111111", "a@b.c", "1.2.3.4", "+12 345-678.9 01"]
    odd = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(1000, "1 " * 20000), (1001, "a." * 20000 + "@"), (1002, "9" * 30000)]
    assert rows_of(pii.op5_pii(spark.createDataFrame(odd, "doc_id long, text string")), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(brute.op5(odd))


def test_pii_methods_own_spans(spark):
    df = spark.createDataFrame([(1, "account GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82 WEST 1234 5698 7654 33"), (3, "ssn: 123-45-6789"), (4, "part 123-45-6789"), (5, "pay 4111-1111-1111-1111 by card")], "doc_id long, text string")
    found = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["pii"]] for r in pii.find_pii(df).collect()}
    assert found == {1: [("iban", 1.1)], 2: [], 3: [("ssn", 0.5)], 4: [], 5: [("card", 1.0)]}
    text = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(df)).collect()}
    assert text[5] == "pay [CARD] by card" and text[4] == "part 123-45-6789"


def test_quality_learns_junk(spark):
    rng = random.Random(4)
    words = [f"wo{i}rd" for i in range(60)]
    docs, labels = [], []
    for d in range(300):
        clean = d % 3 > 0
        t = " ".join(rng.choice(words) for _ in range(rng.randint(20, 300)))
        docs.append((d, t if clean else " ".join(w.upper() + "!!" for w in t.split())))
        labels.append((d, int(clean)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = quality.op6_quality(frame, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == labels[r["doc_id"]][1] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = quality.op6_quality(frame, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert {r["score"] for r in none} == {0.5}


@pytest.mark.parametrize("options", [{}, {"gram": 8, "width": 20}])
def test_suffix_dedup(docs, plain, options):
    got = rows_of(suffix_dedup.suffix_dedup(docs.select("doc_id", "text"), keep_text=False, **options), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == sorted(brute.op7(plain, options.get("width", 50)))


def test_suffix_dedup_periodic_and_hot(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(200))
    plain = [(i, "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 60))) + passage[rng.randint(0, 60) : rng.randint(120, 200)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))) for i in range(320)]
    plain += [(1000, "a" * 500), (1001, "ab" * 200), (1002, "a" * 90), (1003, "b" + "ab" * 60), (1004, "a" * 50)]
    df = spark.createDataFrame(plain, "doc_id long, text string").repartition(5)
    assert rows_of(suffix_dedup.op7_suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(brute.op7(plain))


def test_loser_tree_against_sort():
    rng = random.Random(1)
    width = 6
    runs = []
    for _ in range(5):
        strings = sorted(bytes(rng.choice(b"ab") for _ in range(width)) for _ in range(rng.randint(0, 40)))
        values = [int.from_bytes(s, "big") for s in strings]
        known = [0] + [next((i for i in range(width) if a[i] != b[i]), width) for a, b in zip(strings, strings[1:], strict=False)]
        runs.append((values, known[: len(values)]))
    run, at, known = suffix_dedup.LoserTree(runs, width).merge()
    out = [runs[r][0][i] for r, i in zip(run, at, strict=True)]
    assert out == sorted(v for r in runs for v in r[0])
    for a, b, k in zip(out, out[1:], known[1:], strict=False):
        x, y = a.to_bytes(width, "big"), b.to_bytes(width, "big")
        assert k == next((i for i in range(width) if x[i] != y[i]), width)


TURNS = [(1, 0, "user", "hi <|im_end|> <\\|x| \\ <|"), (1, 1, "assistant", "<|im_start|>assistant\nyes\n"), (1, 2, "assistant", ""), (2, 0, "system", None), (2, 1, None, "é\U0001f600"), (3, 5, "assistant", "b"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a")]


def test_chat_format(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    probe = "<|im_end|><|im_start|>assistant ok"
    want = sorted(brute.op8(TURNS + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)]))
    assert rows_of(chat.op8_chat_format(df), "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256") == want


def test_chat_layouts(spark):
    made = chat.canonical_turns(spark.createDataFrame([(7, "do", "x", "done")], "id long, instruction string, input string, output string"), ("id",)).first()
    assert [(t["role"], t["text"]) for t in made["turns"]] == [("user", "do\n\nx"), ("assistant", "done")]
    with pytest.raises(ValueError):
        chat.canonical_turns(spark.createDataFrame([(1,)], "foo int"))
    records = ['{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', '{"prompt": "a", "response": "b"}', '{"x": 1}', "not json", None]
    got = chat.canonical_turns_json(spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, r string"), "r").orderBy("i").collect()
    assert [r["layout"] for r in got] == ["messages", "from-value", "prompt and response", None, None, None]
    assert all([(t["role"], t["text"]) for t in r["turns"]] == [("user", "a"), ("assistant", "b")] for r in got[:3])


def test_fingerprints(docs, plain, spark):
    got = fingerprint.op9_fingerprints(docs).collect()
    assert sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == sorted(brute.op9(plain))
    by = defaultdict(set)
    for r in got:
        by[dict(plain)[r["doc_id"]] or ""].add(r["fingerprint"])
    assert all(len(s) == 1 for s in by.values())
    long = [r for r in got if r["n_chars"] > 400]
    assert sum(r["near_edited"] for r in long) > sum(r["near_next"] for r in long)
    one = fingerprint.op9_fingerprints(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_are_homomorphic(spark):
    df = spark.createDataFrame([("a b.\nc d.", "e.\nf.", "f.\nc d.\ne.\na b.")], "x string, y string, z string")
    p = df.select(fingerprint.fingerprint("x").alias("p"), fingerprint.fingerprint("y").alias("q"), fingerprint.fingerprint("z").alias("r"))
    r = p.select(fingerprint.combine(F.col("p"), F.col("q")) == F.col("r"), fingerprint.combine(F.col("r"), F.col("q"), -1) == F.col("p")).first()
    assert r[0] and r[1]


def test_sentencepiece(docs, plain):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.tokenizer_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert rows_of(sentencepiece_table.op10_sentencepiece(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(brute.op10(plain, sp))
    with open(path, "rb") as f:
        table = sentencepiece_table.ChunkTable(f.read(), True, 50)  # a small table starts anew often
    rng = random.Random(9)
    for _ in range(3000):
        t = "".join(rng.choice(list("  ▁abcthe\n\té一😀<>/s0")) for _ in range(rng.randint(0, 25)))
        ids = table.encode(table.keys_of(t))
        assert ids == sp.encode(t) and table.decode(table.keys_of(t)) == sp.decode(ids)


def queries_on(docs, spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    labels = spark.createDataFrame([(0, 1), (None, 0), (3, None)], "doc_id long, quality int")
    return {
        "op1": lambda: ngram_join.ngram_jaccard_join(docs),
        "op2": lambda: line_dedup.op2_line_dedup(docs),
        "op3": lambda: decontam.op3_decontamination(docs, bench),
        "op4": lambda: shard.op4_hilbert_shards(docs),
        "op5": lambda: pii.op5_pii(docs),
        "op6": lambda: quality.op6_quality(docs, labels),
        "op7": lambda: suffix_dedup.op7_suffix_dedup(docs),
        "op9": lambda: fingerprint.op9_fingerprints(docs),
        "op10": lambda: sentencepiece_table.op10_sentencepiece(docs, queries.tokenizer_path()),
    }


@pytest.mark.parametrize("op", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op9", "op10"])
def test_awkward_tables(op, messy, nothing, spark):
    assert queries_on(messy, spark)[op]().count() == messy.count()
    assert queries_on(nothing, spark)[op]().count() == 0


def test_empty_benchmark_and_conversations(docs, spark):
    assert decontam.op3_decontamination(docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0
    assert chat.op8_chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1


def test_clashing_columns_are_refused(docs):
    with pytest.raises(ValueError):
        pii.find_pii(docs.withColumn("pii", F.lit(1)))
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(docs.withColumn("n_kept", F.lit(1)))


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, names in os.walk(os.path.join(root, "strandgraph")):
        if f"{os.sep}llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert ".llm" not in f.read()
