"""OTLP trace requests in protobuf's wire format, brought to the shape of the JSON ones.

Only the fields the engine reads are decoded; others are skipped by wire type.
Each file is one request; a file that is not valid gives no row but an error.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .otlp import REQUEST


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        if c < 128:
            return out, i
        shift += 7


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: integers for numbers, bytes for the rest."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 1:
            value, i = b[i : i + 8], i + 8
        elif kind == 2:
            size, i = _varint(b, i)
            value, i = b[i : i + size], i + size
        elif kind == 5:
            value, i = b[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind}")
        if i > len(b):
            raise ValueError("the message is cut short")
        yield key >> 3, value


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


# Field numbers of the published trace schema.
def _any(b: bytes) -> dict:
    for n, v in fields(b):
        if n == 1:
            return {"stringValue": v.decode(errors="replace")}
        if n == 2:
            return {"boolValue": bool(v)}
        if n == 3:
            return {"intValue": str(_signed(v))}
        if n == 4:
            return {"doubleValue": struct.unpack("<d", v)[0]}
        if n == 5:
            return {"arrayValue": {"values": [_any(x) for m, x in fields(v) if m == 1]}}
    return {}


def _attribute(b: bytes) -> dict:
    out = {"key": "", "value": {}}
    for n, v in fields(b):
        if n == 1:
            out["key"] = v.decode(errors="replace")
        elif n == 2:
            out["value"] = _any(v)
    return out


def _fixed64(v) -> str:
    return str(struct.unpack("<Q", v)[0] if isinstance(v, bytes) else v)


def _span(b: bytes) -> dict:
    out: dict = {"attributes": [], "events": [], "status": {}}
    for n, v in fields(b):
        if n in (1, 2, 4):
            out[{1: "traceId", 2: "spanId", 4: "parentSpanId"}[n]] = v.hex()
        elif n == 5:
            out["name"] = v.decode(errors="replace")
        elif n == 6:
            out["kind"] = v
        elif n in (7, 8):
            out["startTimeUnixNano" if n == 7 else "endTimeUnixNano"] = _fixed64(v)
        elif n == 9:
            out["attributes"].append(_attribute(v))
        elif n == 11:
            event: dict = {"attributes": []}
            for m, x in fields(v):
                if m == 1:
                    event["timeUnixNano"] = _fixed64(x)
                elif m == 2:
                    event["name"] = x.decode(errors="replace")
                elif m == 3:
                    event["attributes"].append(_attribute(x))
            out["events"].append(event)
        elif n == 15:
            for m, x in fields(v):
                if m == 2:
                    out["status"]["message"] = x.decode(errors="replace")
                elif m == 3:
                    out["status"]["code"] = x
    return out


def decode_request(b: bytes) -> dict:
    """A request as the JSON encoding has it."""
    out = {"resourceSpans": []}
    for n, v in fields(b):
        if n == 1:
            item: dict = {"resource": {"attributes": []}, "scopeSpans": []}
            for m, x in fields(v):
                if m == 1:
                    item["resource"]["attributes"] = [_attribute(a) for k, a in fields(x) if k == 1]
                elif m == 2:
                    item["scopeSpans"].append({"spans": [_span(s) for k, s in fields(x) if k == 2]})
            out["resourceSpans"].append(item)
    return out


def read_protobuf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(requests, errors) of landed protobuf files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, failed = [], []
            for content in batch.column(1).to_pylist():
                try:
                    texts.append(json.dumps(decode_request(content)))
                    failed.append(None)
                except (ValueError, IndexError, AttributeError, struct.error) as e:
                    texts.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(failed, pa.string())], names=["path", "body", "error"])

    raw = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, body string, error string")
    good = raw.filter("body is not null").select(F.from_json("body", "struct<" + REQUEST.replace("resourceSpans array", "resourceSpans:array", 1) + ">").alias("r")).select("r.*")
    return good, raw.filter("error is not null").select("path", "error")
