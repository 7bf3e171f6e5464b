"""The binary vector store: magic, version, then records of little-endian strings and floats."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values of the format
MAGIC, VERSION, MAX_RECORDS, MAX_DIMS = b"GRVX", 1, 10_000_000, 100_000
SCHEMA = "id string, kind string, text string, vector array<float>, content_hash string"


def decode(data: bytes) -> list[tuple]:
    """Records of a store; one that is cut off or beyond the limits is an error."""
    if data[:4] != MAGIC:
        raise ValueError("not a vector store")
    version, count = struct.unpack_from("<II", data, 4)
    if version != VERSION or count > MAX_RECORDS:
        raise ValueError("unknown version or too many records")
    at = 12

    def text() -> str:
        nonlocal at
        (n,) = struct.unpack_from("<I", data, at)
        at += 4 + n
        if at > len(data):
            raise ValueError("cut off")
        return data[at - n : at].decode()

    out = []
    for _ in range(count):
        key, kind, body = text(), text(), text()
        (dims,) = struct.unpack_from("<I", data, at)
        if dims > MAX_DIMS:
            raise ValueError("too many dimensions")
        vector = list(struct.unpack_from(f"<{dims}f", data, at + 4))
        at += 4 + 4 * dims
        out.append((key, kind, body, vector, text()))
    return out


def encode(records: list[tuple]) -> bytes:
    """A store of ``(id, kind, text, vector, content_hash)`` records."""
    parts = [MAGIC, struct.pack("<II", VERSION, len(records))]
    for key, kind, body, vector, digest in records:
        for s in (key, kind, body):
            raw = s.encode()
            parts += [struct.pack("<I", len(raw)), raw]
        parts += [struct.pack("<I", len(vector)), struct.pack(f"<{len(vector)}f", *vector)]
        raw = digest.encode()
        parts += [struct.pack("<I", len(raw)), raw]
    return b"".join(parts)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Vectors of the store files under a path, one task per file."""

    def run(batches):
        for pdf in batches:
            rows = [r for data in pdf.content for r in decode(bytes(data))]
            yield pd.DataFrame(rows, columns=["id", "kind", "text", "vector", "content_hash"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def hash_embedding(text_words, dims: int = 64):
    """A vector of word counts by hash: a stand-in for an embedding service, the same everywhere."""
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(text_words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)) == k)).cast("float"))
    return counts
