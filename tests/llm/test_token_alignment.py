import numpy as np
import pytest
from brute import op13

from strandgraph.llm import token_alignment as A

COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a b", "<|endoftext|> x<s> </s>", "▁x y", "q ▁ r", "\n\n x\ty ", "x" * 5000, " " * 3000, "中文 字符 中 文", "🙂 é 🙂🙂 a b", "it's we'll 12 345", "ab\x00cd \x1f e", "é è­ ñ", "  a  b ᠎ c"]


@pytest.fixture(scope="module")
def tools():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    path, model = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return open(path).read(), open(model, "rb").read(), tokenizer, sentencepiece.SentencePieceProcessor(model_file=model)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize(("kind", "entries", "frequent"), [("ends", 150_000, 1 << 20), ("ends", 700, 40), ("overlaps", 150_000, 0), ("products", 900, 1 << 20)])
def test_like_plain_version(spark, plain, tools, kind, entries, frequent):
    a_json, b_model, tokenizer, sp = tools
    rows = [(d, t) for d, t in plain if not t or len(t) < 20_000] + [(1000 + k, t) for k, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got, pairs = A.align_tokens(docs, a_json, b_model, kind=kind, table_entries=entries, frequent=frequent)
    want, corpus = op13(rows, tokenizer, sp, kind)
    assert rows_of(got) == sorted(want, key=str)
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == corpus
    assert got.columns == ["doc_id", "text", *A.OUTPUTS]


def test_links_of_a_group():
    # A ends 2 5 6, B ends 1 5 6: one group of four tokens, one of two.
    a, b = np.array([2, 5, 6]), np.array([1, 5, 6])
    assert [x.tolist() for x in A.links(a, b, "overlaps")] == [[0, 0, 1, 2], [0, 1, 1, 2]]
    assert [x.tolist() for x in A.links(a, b, "products")] == [[0, 0, 1, 1, 2], [0, 1, 0, 1, 2]]
    assert [x.tolist() for x in A.links(a, b)] == [[1, 2], [1, 2]]
    assert A.align(a, b)[2].tolist() == [0, 0, 0, 1]


def test_empty_clash_and_other_columns(spark, nothing, messy, tools):
    a_json, b_model, *_ = tools
    got, pairs = A.align_tokens(nothing, a_json, b_model)
    assert got.count() == 0 and pairs.count() == 0 and got.columns == [*nothing.columns, *A.OUTPUTS]
    got, _ = A.align_tokens(messy, a_json, b_model)
    assert sorted(map(str, got.select("doc_id", "text", "label").collect())) == sorted(map(str, messy.select("doc_id", "text", "label").collect()))
    with pytest.raises(ValueError, match="n_a"):
        A.align_tokens(messy.withColumn("n_a", messy.doc_id), a_json, b_model)
    with pytest.raises(ValueError, match="BPE"):
        A.align_tokens(messy, '{"model": {"type": "Unigram"}}', b_model)
