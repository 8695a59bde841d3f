"""1. Token-ID files: fixed-width bit packing, blocks with offsets, vectorised unpacking and random access.

Layout: a folder of Parquet files written by Spark, so that it lives on any store and survives lost executors. A row is
a block of whole documents of one shard, shards and blocks in ascending document order:

    shard int, block int, first long (ids of the shard before the block), n_ids long, bits int,
    doc_ids array<long>, starts array<long> (ids of the block before each document), payload binary

``payload`` holds id i of the block in bits [i*bits, (i+1)*bits), least significant bit first. A block closes at
``BLOCK`` ids; a longer document is a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.llm.vocabulary import default_path, vocabulary

BLOCK, SLICE, FEW = 1 << 18, 1 << 16, 100_000
LAYOUT = "shard int, block int, first long, n_ids long, bits int, doc_ids array<{kind}>, starts array<long>, payload binary"


def bits_for(size: int) -> int:
    """Least bits that hold ids 0 .. size-1."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids to ``bits`` bits each, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    parts = []
    for i in range(0, len(ids), SLICE):  # a multiple of 8 ids fills whole bytes
        planes = (ids[i : i + SLICE].astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
        parts.append(np.packbits(planes.astype(np.uint8).reshape(-1), bitorder="little").tobytes())
    return b"".join(parts)


def unpack(payload: bytes, bits: int, begin: int, end: int) -> np.ndarray:
    """Ids [begin, end) of a block, reading only their bytes."""
    if bits in (8, 16, 32):
        w = bits // 8
        return np.frombuffer(payload, f"<u{w}", end - begin, begin * w).astype(np.uint32)
    if end - begin > SLICE:
        return np.concatenate([unpack(payload, bits, i, min(i + SLICE, end)) for i in range(begin, end, SLICE)])
    low, high = begin * bits // 8, -(-end * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, high - low, low), bitorder="little")[begin * bits - 8 * low :][: (end - begin) * bits]
    return (flat.reshape(-1, bits).astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


def write_tokens(docs: DataFrame, out: str, doc_id="doc_id", text="text", path: str | None = None, end_id: int = 2, block: int = BLOCK, order: Column | None = None) -> None:
    """Encode ``docs`` and write the files to folder ``out``, ascending by doc_id, or by ``order``, an expression over ``docs``.

    Null text counts as empty and is just the end id. Rows of one doc_id stand together, ordered by their text's hash;
    null ids come first. An empty table writes an empty folder. Further columns are not read. Texts move once, to their
    range of ids; a task holds one batch of texts and one block.
    """
    path = path or default_path()
    place = F.lit(None).cast("string") if order is None else order
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), place.alias("place"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    tie = F.xxhash64("text")
    by = ["doc_id", tie] if order is None else ["place", "doc_id", tie]
    ordered = rows.repartitionByRange(*by).sortWithinPartitions(*by).select("doc_id", "text").withColumn("shard", F.spark_partition_id())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path)
        bits = bits_for(max(vocab.size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        number, first, shard = 0, 0, 0
        names: list = []
        held: list[bytes] = []

        def closed() -> pd.DataFrame:
            nonlocal number, first, names, held
            sizes = np.array([len(x) // 4 for x in held], np.int64)
            ids = np.frombuffer(b"".join(held), "<u4")
            row = pd.DataFrame({"shard": [shard], "block": [number], "first": [first], "n_ids": [len(ids)], "bits": [bits], "doc_ids": [names], "starts": [(np.cumsum(sizes) - sizes).tolist()], "payload": [pack(ids, bits)]})
            number, first, names, held = number + 1, first + len(ids), [], []
            return row

        n = 0
        for b in batches:
            shard = int(b["shard"].iloc[0]) if len(b) else shard
            for name, ids in zip(b["doc_id"].astype(object).where(b["doc_id"].notna(), None), vocab.ids(b["text"].tolist()), strict=True):
                size = len(ids) // 4 + 1
                if names and n + size > block:
                    yield closed()
                    n = 0
                names.append(name)
                held.append(ids + end)
                n += size
        if names:
            yield closed()

    ordered.mapInPandas(encode, LAYOUT.format(kind=kind)).write.parquet(out)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``base``, the ids of all shards before their own: a sum over one row per shard.

    Up to ``FEW`` shards this table is sent to every task, so that payloads don't move; beyond that it is a plain join.
    """
    found = spark.read.parquet(path)
    shards = found.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1))
    bases = shards.select("shard", F.coalesce(before, F.lit(0)).alias("base"))
    return found.join(F.broadcast(bases) if shards.count() <= FEW else bases, "shard")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    return _per_document(blocks(spark, path), "ids binary", lambda ids: ids.tobytes())


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_tokens``, with the ids' unsigned crc32 in their place."""
    return _per_document(blocks(spark, path), "ids_crc32 long", lambda ids: zlib.crc32(ids))


def read_range(spark: SparkSession, path: str, begin: int, end: int) -> DataFrame:
    """Ids [begin, end) of the whole corpus as rows (position, id); only blocks that hold some are unpacked."""
    at = F.col("base") + F.col("first")
    found = blocks(spark, path).filter((at < end) & (at + F.col("n_ids") > begin)).select(at.alias("at"), "n_ids", "bits", "payload")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                low, high = max(begin - r.at, 0), min(end - r.at, r.n_ids)
                yield pd.DataFrame({"position": np.arange(r.at + low, r.at + high), "id": unpack(r.payload, r.bits, low, high).astype(np.int64)})

    return found.mapInPandas(part, "position long, id long")


def _per_document(found: DataFrame, column: str, digest) -> DataFrame:
    kind = found.schema["doc_ids"].dataType.elementType.simpleString()
    name = column.split()[0]

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                starts = np.append(np.asarray(r.starts, np.int64), r.n_ids)
                ids = unpack(r.payload, r.bits, 0, int(r.n_ids)).astype("<u4")
                cuts = starts.tolist()
                own = [digest(ids[a:z]) for a, z in zip(cuts, cuts[1:])]
                yield pd.DataFrame({"doc_id": list(r.doc_ids), "start": starts[:-1] + (r.base + r.first), "n_tokens": np.diff(starts), name: own})

    return found.select("base", "first", "n_ids", "bits", "doc_ids", "starts", "payload").mapInPandas(documents, f"doc_id {kind}, start long, n_tokens long, {column}")
