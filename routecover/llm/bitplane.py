"""Token ids in planes: blocks of ids transposed into bit or byte planes, each compressed, behind a chunk index.

One Parquet row holds one chunk: at most ``block`` consecutive ids of a shard, as one zstandard frame
per plane, with the index of what it holds: the shard, the position of its first id there, and for each
document in it the id, its row in the shard, where its piece begins and how long it is. A chunk can be
decoded alone, so reading needs no order, and files can be split anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routecover.llm.texts import crc_joined, strings
from routecover.llm.tokens import encoder, in_chunks
from routecover.runtime import written

CHUNK_SCHEMA = (
    "shard int, chunk int, first long, n_ids int, plane string, doc_ids array<long>, doc_rows array<int>, "
    "doc_starts array<long>, piece_at array<int>, piece_from array<long>, piece_len array<int>, planes array<binary>"
)


def to_planes(ids: np.ndarray, plane: str, level: int = 3) -> list[bytes]:
    """One compressed frame for each of the 32 bit planes or 4 byte planes, the lowest first."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if plane == "bit":
        bits = np.unpackbits(octets, axis=1, bitorder="little").T
        rows = np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little")
    elif plane == "byte":
        rows = np.ascontiguousarray(octets.T)
    else:
        raise ValueError(f"plane is 'bit' or 'byte', not {plane!r}")
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(r.tobytes()) for r in rows]


def from_planes(frames: list[bytes], n_ids: int, plane: str) -> np.ndarray:
    """The ids of ``to_planes``, as little-endian unsigned 32-bit integers."""
    expand = zstandard.ZstdDecompressor()
    rows = np.stack([np.frombuffer(expand.decompress(f), np.uint8) for f in frames])
    if plane == "bit":
        bits = np.unpackbits(rows, axis=1, bitorder="little", count=n_ids)
        rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").T
    return np.ascontiguousarray(rows.T).view("<u4").ravel()


def write_tokens(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    block: int = 65_536,
    plane: str = "byte",
    shards: int | None = None,
) -> DataFrame:
    """Encode every whole text, and write the ids in ascending id order as chunks; returns the written chunks.

    A shard is one range of ids (rows of equal id stay together, ordered by text; a null id comes first), sorted within
    its task, so shards in order hold the documents in order. A null or empty text is the end id
    alone; other columns are ignored; an empty table gives no chunk. A task holds one block and one
    batch of texts at a time.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        .repartitionByRange(n, "id")
        .sortWithinPartitions("id", "text")
    )

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, chunk, row, at = TaskContext.get().partitionId(), 0, 0, 0
        held: list[np.ndarray] = []
        n_held = 0
        pieces: list[tuple] = []  # id, row, start of the document in the shard, place in chunk, place in document, length

        def flush(ids: np.ndarray) -> pa.RecordBatch:
            nonlocal chunk, at, pieces
            columns = list(zip(*pieces))
            values = [shard, chunk, at, len(ids), plane, *map(list, columns), to_planes(ids, plane)]
            out = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, ARROW)], schema=ARROW)
            chunk, at, pieces = chunk + 1, at + len(ids), []
            return out

        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = strings(batch)
            for lo, hi in in_chunks(texts):
                flat, offsets = encoder(vocabulary).encode(texts[lo:hi], end_id)
                for k in range(hi - lo):
                    begin, end = int(offsets[k]), int(offsets[k + 1])
                    start, done = at + n_held, 0
                    while begin < end:
                        take = min(block - n_held, end - begin)
                        pieces.append((names[lo + k], row, start, n_held, done, take))
                        held.append(flat[begin : begin + take])
                        n_held, begin, done = n_held + take, begin + take, done + take
                        if n_held == block:
                            yield flush(np.concatenate(held))
                            held, n_held = [], 0
                    row += 1
                held = [np.concatenate(held)] if held else []
        if n_held:
            yield flush(np.concatenate(held))

    ARROW = pa.schema(
        [("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("plane", pa.string()),
         ("doc_ids", pa.list_(pa.int64())), ("doc_rows", pa.list_(pa.int32())), ("doc_starts", pa.list_(pa.int64())),
         ("piece_at", pa.list_(pa.int32())), ("piece_from", pa.list_(pa.int64())), ("piece_len", pa.list_(pa.int32())),
         ("planes", pa.list_(pa.binary()))]
    )
    return written(ordered.mapInArrow(chunks, CHUNK_SCHEMA), "tokens", compression="uncompressed")


def read_pieces(chunks: DataFrame) -> DataFrame:
    """Decode every chunk: one row for each piece of a document, with the CRC-32 of its ids as little-endian unsigned 32-bit integers."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for c in batch.to_pylist():
                ids = from_planes(c["planes"], c["n_ids"], c["plane"])
                for name, row, start, at, begin, size in zip(*(c[x] for x in PER_PIECE)):
                    out.append((c["shard"], row, name, start, begin, size, zlib.crc32(ids[at : at + size])))
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), ARROW)] if out else [pa.array([], f.type) for f in ARROW], schema=ARROW)

    PER_PIECE = ("doc_ids", "doc_rows", "doc_starts", "piece_at", "piece_from", "piece_len")
    ARROW = pa.schema([("shard", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("begin", pa.int64()), ("size", pa.int64()), ("crc", pa.int64())])
    return chunks.mapInArrow(decode, "shard int, row int, doc_id long, local long, begin long, size long, crc long")


def read_documents(chunks: DataFrame) -> DataFrame:
    """Per document, from the chunks alone: ``doc_id, start`` (ids of all documents before it), ``n_tokens, ids_crc32``.

    Pieces of a document that lies in several chunks are joined in order by combining their checksums. The
    shards' sizes (one row per shard, however large the shards are) are summed in order and joined back.
    """
    in_order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("shard", F.coalesce(F.sum("n").over(in_order), F.lit(0)).alias("base"))
    parts = (
        read_pieces(chunks)
        .groupBy("shard", "row")
        .agg(F.first("doc_id").alias("doc_id"), F.first("local").alias("local"), F.sum("size").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("begin", "size", "crc"))).alias("pieces"))
    )

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for pieces in batch.column(4).to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc_joined(crc, p["crc"], 4 * p["size"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], names=["shard", "doc_id", "local", "n_tokens", "ids_crc32"])

    whole = parts.select("shard", "doc_id", "local", "n_tokens", "pieces").mapInArrow(join_pieces, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return whole.join(before, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
