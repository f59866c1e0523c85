"""SentencePiece encoding and decoding by a table of distinct marked chunks.

In a BPE model whose pieces never hold a white-space marker after another
character, no merge can cross the border in front of a marker that follows
such a character.  A text is cut at these borders; each distinct chunk is
segmented once per task, and its ids, their decimal form and its decoded text
are joined back by position.  ``check_model`` proves the property for the
model at hand, so a model for which it fails is refused rather than encoded
wrongly.  There is no shuffle: the table lives in the task, is bounded by
``table_entries`` and starts anew when full, which changes no result.

Nulls and empty texts encode to the end id alone; repeated rows give repeated
results; other columns pass through untouched (``encode_decode`` keeps any
column and refuses a clash of its output names).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sparkops import bounded_batches

MARK = "▁"
#: One chunk: markers, then other characters.
CHUNK = rf"{MARK}*[^{MARK}]+|{MARK}+"


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def check_model(model: bytes) -> dict:
    """The model's normaliser settings, if the chunk table is exact for it."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    spec.ParseFromString(model)
    normal, train = spec.normalizer_spec, spec.trainer_spec
    bad = []
    if train.model_type != 2:
        bad.append("it is not a BPE model")
    if train.treat_whitespace_as_suffix or not normal.escape_whitespaces:
        bad.append("markers do not lead words")
    if normal.precompiled_charsmap or normal.remove_extra_whitespaces or spec.denormalizer_spec.precompiled_charsmap:
        bad.append("its normaliser changes texts")
    if any(p.type == 4 for p in spec.pieces):
        bad.append("it has user-defined pieces")
    if any(MARK in p.piece.lstrip(MARK) for p in spec.pieces if p.type in (1, 5)):
        bad.append("a piece crosses a marker")
    if bad:
        raise ValueError("the chunk table does not fit this model: " + "; ".join(bad))
    return {"prefix": bool(normal.add_dummy_prefix)}


class _Column(dict):
    """One column of the chunk table; a missing chunk is segmented once and enters all columns."""

    def __init__(self, add, place: int) -> None:
        super().__init__()
        self.add, self.place = add, place

    def __missing__(self, key: str):
        return self.add(key)[self.place]


class ChunkTable:
    """Distinct chunk -> its ids, their decimal form and its decoded text.

    With a dummy prefix every chunk starts with a marker, which its key leaves
    out, so the words of an ordinary text are keys as they are.
    """

    def __init__(self, model: bytes, prefix: bool, entries: int) -> None:
        import re

        self.sp, self.prefix, self.entries = load(model), prefix, entries
        self.chunks = re.compile(CHUNK).findall
        self.ids, self.told, self.decoded_texts = (_Column(self.add, i) for i in range(3))
        # A first piece after which decoding no longer drops a leading space.
        self.anchor = self.sp.encode("a")
        self.skip = len(self.sp.decode(self.anchor))

    def add(self, key: str) -> tuple[list[int], str, str]:
        if len(self.ids) >= self.entries:
            for column in (self.ids, self.told, self.decoded_texts):
                column.clear()
        ids = self.sp.encode(key) if key else [self.sp.piece_to_id(MARK)]
        row = ids, " ".join(map(str, ids)), self.sp.decode(self.anchor + ids)[self.skip :]
        self.ids[key], self.told[key], self.decoded_texts[key] = row
        return row

    def add_many(self, lists: list[list[str]]) -> None:
        """Segment the chunks that the table lacks in one call."""
        new = [*set().union(*lists).difference(self.ids)]
        if len(self.ids) + len(new) > self.entries:
            for column in (self.ids, self.told, self.decoded_texts):
                column.clear()
            new = [*set().union(*lists)]
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = [i if k else [self.sp.piece_to_id(MARK)] for k, i in zip(part, self.sp.encode(part, num_threads=1), strict=True)]
            texts = self.sp.decode([self.anchor + i for i in ids], num_threads=1)
            self.ids.update(zip(part, ids, strict=True))
            self.told.update(zip(part, (" ".join(map(str, i)) for i in ids), strict=True))
            self.decoded_texts.update(zip(part, (t[self.skip :] for t in texts), strict=True))

    def keys_of(self, text: str) -> list[str]:
        """The chunks of a text, in order."""
        if not text:
            return []
        if self.prefix and MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = text.replace(" ", MARK)
        if self.prefix:
            return [c[1:] for c in self.chunks(MARK + marked)]
        return self.chunks(marked)

    def encode(self, keys: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.ids.__getitem__, keys)))

    def encode_text(self, keys: list[str], end: int) -> str:
        """The ids in decimal, joined by spaces, with the end id if there is one."""
        body = " ".join(map(self.told.__getitem__, keys))
        return body if end < 0 else f"{body} {end}" if keys else str(end)

    def decode(self, keys: list[str]) -> str:
        """What decoding the whole list of ids gives: the joined texts without the prefix's space."""
        out = "".join(map(self.decoded_texts.__getitem__, keys))
        return out[1:] if self.prefix and out[:1] == " " else out


def encode_decode(df: DataFrame, model: bytes, text: str = "text", end_id: bool = True, table_entries: int = 150_000, outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """df with any of: ids array<int>, decoded, n_tokens, ids_sha256, decoded_sha256."""
    if clash := {*outputs} & {*df.columns}:
        raise ValueError(f"the input already has {sorted(clash)}")
    bounded_batches(df.sparkSession)
    prefix = check_model(model)["prefix"]
    kinds = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    types = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
    end = load(model).eos_id() if end_id else -1
    at = df.columns.index(text)
    columns = [*df.columns, *outputs]
    schema = T.StructType([*df.schema.fields, *(T.StructField(o, kinds[o]) for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model, prefix, table_entries)
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                made: dict[str, list] = {o: [] for o in outputs}
                chunked = [table.keys_of(value or "") for value in batch.column(at).to_pylist()]
                table.add_many(chunked)
                for keys in chunked:
                    if "ids" in made:
                        made["ids"].append(table.encode(keys) + [end] * (end >= 0))
                    if "n_tokens" in made or "ids_sha256" in made:
                        told = table.encode_text(keys, end)
                        if "n_tokens" in made:
                            made["n_tokens"].append(told.count(" ") + 1 if told else 0)
                        if "ids_sha256" in made:
                            made["ids_sha256"].append(hashlib.sha256(told.encode()).hexdigest())
                    if "decoded" in made or "decoded_sha256" in made:
                        decoded = table.decode(keys)
                        if "decoded" in made:
                            made["decoded"].append(decoded)
                        if "decoded_sha256" in made:
                            made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[o], types.get(o, pa.string())) for o in outputs)], names=columns)

    return df.mapInArrow(run, schema)


def op10_sentencepiece(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    with open(model_path, "rb") as f:
        model = f.read()
    return encode_decode(docs.select("doc_id", "text"), model, outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text").withColumn("n_tokens", F.col("n_tokens").cast("long"))
