"""Line dedup by a deletion-neighbourhood join: later lines within one word of an earlier line go.

Two lines are within one word edit exactly if they are equal once the same word position is deleted from both (a
substitution), or if deleting a word of one gives the other. So all of a line's variants with one word deleted
are emitted as hashed keys, and the earliest line of each key is enough: a group of any size costs one row per member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from routecover.llm.texts import byte_texts, free_name, give_back
from routecover.llm.tokens import in_chunks
from routecover.runtime import written

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up))
            for name, base in (("up", BASE), ("down", INVERSE)):
                values = np.full(size, base, np.uint64)
                values[0] = 1
                setattr(self, name, np.multiply.accumulate(values))


POWERS = _Powers()


def _mix(x: np.ndarray, salt: np.ndarray | int) -> np.ndarray:
    """Scramble sums, with a salt, into keys."""
    x = x ^ (np.asarray(salt).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def running_sums(words: list[bytes], first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Running sums over all words of hash times base to the power of the place in its line, from 0."""
    POWERS.upto(int(n.max(initial=1)))
    within = np.arange(len(words)) - np.repeat(first, n)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(words) * POWERS.up[within], dtype=np.uint64)])


def half_keys(words: list[bytes]) -> list[int]:
    """Keys of a line's first and last h words for h = n // 2 and (n - 1) // 2: two if these are equal, else four.

    Lines within one edit share at least one: the edit leaves the first or the last half of the shorter one's words as they are.
    A half is hashed at once, not word by word.
    """
    n, keys = len(words), []
    for h in {n // 2, (n - 1) // 2}:
        keys.append(xxhash.xxh3_64_intdigest(b" ".join(words[:h]), 2 * h))
        keys.append(xxhash.xxh3_64_intdigest(b" ".join(words[n - h :]), 2 * h + 1))
    return keys


def deletion_keys(lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every line: its own key at place 0, and at place p the key of its variant without its p-th word; as (row of the line, place, key).

    Equal word sequences have equal keys.
    """
    n = np.array([len(x) for x in lines], np.int64)
    first = np.cumsum(n) - n
    sums = running_sums([w for x in lines for w in x], first, n)
    row = np.repeat(np.arange(len(lines)), n)
    at = np.arange(len(row))
    without = (sums[at] - sums[first[row]]) + (sums[(first + n)[row]] - sums[at + 1]) * INVERSE
    whole = _mix(sums[first + n] - sums[first], n)
    keys = np.concatenate([whole, _mix(without, n[row] - 1)])
    return np.concatenate([np.arange(len(lines)), row]), np.concatenate([np.zeros(len(lines), np.int64), at - first[row] + 1]), keys


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the word edit distance is at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def squeezed(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the texts as zstandard frames, so that a shuffle of whole texts writes and sends less. Null stays null."""
    names = docs.columns
    at = names.index(text_col)

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            frames = [None if x is None else codec.compress(x) for x in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary()) if i == at else c for i, c in enumerate(batch.columns)], names=names)

    return docs.mapInArrow(squeeze, T.StructType([T.StructField(f.name, T.BinaryType()) if i == at else f for i, f in enumerate(docs.schema.fields)]))


def scan_lines(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """``(doc_id, line, n, digest, halves)`` for every line of at least ``min_words`` words; ``halves`` only from ``near_words`` words on."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), byte_texts(batch)
            for lo, hi in in_chunks(texts):
                yield lines_of(names[lo:hi], texts[lo:hi])
            give_back()

    def lines_of(names: list[int], texts: list[bytes]) -> pa.RecordBatch:
        ids, numbers, sizes, digests, keys, ends = [], [], [], [], [], [0]
        for name, text in zip(names, texts):
            for k, line in enumerate(text.split(b"\n")):
                cut = line.split()
                if len(cut) >= min_words:
                    ids.append(name)
                    numbers.append(k)
                    sizes.append(len(cut))
                    digests.append(xxhash.xxh3_128_digest(b" ".join(cut)))
                    if len(cut) >= near_words:
                        keys += half_keys(cut)
                    ends.append(len(keys))
        halves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(keys, np.uint64).view(np.int64)))
        columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), halves]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "line", "n", "digest", "halves"])

    return docs.mapInArrow(scan, "doc_id long, line int, n int, digest binary, halves array<long>")


def repeated_lines(docs: DataFrame, *, min_words: int = 1, near_words: int = 4) -> DataFrame:
    """``(doc_id, line, first_doc, first_line)``: every line with an earlier equal or nearly equal line, and that line's place.

    ``docs`` is ``(doc_id, text)``. Lines are told apart by their words (runs of other bytes than ASCII white space). Equal lines
    count from ``min_words`` words on, lines one word edit apart if both have ``near_words`` or more. Places are ordered by
    (doc_id, line number); the earlier line may itself be one that goes.
    """
    lines = written(scan_lines(docs, min_words, near_words), "lines")
    distinct = lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line")).alias("at"), F.first("halves").alias("halves"))
    distinct = written(distinct.select("digest", "at.doc_id", "at.line", "halves"), "distinct-lines")
    # Only lines that share a half with another distinct line can have a partner.
    halves = distinct.select("doc_id", "line", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    wanted = halves.join(shared, "half", "left_semi").groupBy("doc_id").agg(F.collect_set("line").alias("wanted"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for name, frame, asked in zip(*(c.to_pylist() for c in batch.columns)):
                rows = codec.decompress(frame).split(b"\n")
                for x in asked:
                    cut = rows[x].split() if x < len(rows) else []
                    if len(cut) >= near_words:
                        words = b" ".join(cut)
                        digest = xxhash.xxh3_128_digest(words)
                        out.append((name, x << 32 | int.from_bytes(digest[:4], "big"), digest, words))
            columns = list(zip(*out)) if out else [[]] * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "mark", "digest", "words"])

    # ``mark`` is the line's number with a part of its digest, as rows of one id may hold different texts.
    emitted = squeezed(docs.select("doc_id", "text"), "text").join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(pick, "doc_id long, mark long, digest binary, words binary")
    emitted = written(emitted.dropDuplicates(["doc_id", "mark"]), "near-lines")

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, key = deletion_keys([x.split(b" ") for x in batch.column(2).to_pylist()])
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(taken), batch.column(1).take(taken), pa.array(place.astype(np.int32)), pa.array(key)], names=["doc_id", "mark", "place", "key"])

    keys = emitted.select("doc_id", "mark", "words").mapInArrow(variants, "doc_id long, mark long, place int, key long")
    at, least = F.struct("doc_id", "mark"), F.min(F.struct("doc_id", "mark")).alias("other")
    # Equal after the same deletion: one edit apart, whatever the group's size.
    same_place = keys.where("place > 0").groupBy("key", "place").agg(least, F.count("*").alias("c")).where("c > 1").drop("c")
    substituted = keys.where("place > 0").join(same_place, ["key", "place"]).select(at.alias("at"), "other")
    whole = keys.where("place = 0").select("key", at.alias("short"))
    shorter = keys.where("place > 0").select("key", at.alias("at")).join(whole, "key")
    longer = shorter.groupBy("short").agg(F.min("at").alias("other")).select(F.col("short").alias("at"), "other")
    pairs = substituted.unionByName(shorter.select("at", F.col("short").alias("other"))).unionByName(longer).where("other < at")
    pairs = pairs.groupBy("at").agg(F.min("other").alias("other"))
    text = emitted.select(at.alias("at"), "digest", "words")
    checked = pairs.join(text, "at").join(text.select(F.col("at").alias("other"), F.col("words").alias("other_words")), "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = [within_one(a.split(b" "), b.split(b" ")) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.select([0, 1, 2]).filter(pa.array(fine, pa.bool_()))

    near = checked.select("digest", F.col("other.doc_id").alias("other_doc"), F.shiftright("other.mark", 32).cast("int").alias("other_line"), "words", "other_words")
    near = near.mapInArrow(verify, "digest binary, other_doc long, other_line int")
    near = near.select("digest", F.struct(F.col("other_doc").alias("doc_id"), F.col("other_line").alias("line")).alias("place"))
    own = distinct.select("digest", F.struct("doc_id", "line").alias("place"))
    first = own.unionByName(near).groupBy("digest").agg(F.min("place").alias("first"))
    # From files, so that the join is on its own and the lines of one very common digest can be dealt to many tasks.
    first = written(first, "first-lines")
    return lines.join(first, "digest").where(F.col("first") < F.struct("doc_id", "line")).select("doc_id", "line", F.col("first.doc_id").alias("first_doc"), F.col("first.line").alias("first_line"))


def drop_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 1, near_words: int = 4, counts: tuple[str, str] = ("n_lines", "n_removed")
) -> DataFrame:
    """``docs`` without its repeated lines, with the columns ``counts`` (its lines, and those removed) added; every row stays.

    The rest of the lines keep their order and text. Lines shorter than ``min_words`` words stay: an empty line always does. A null
    text stays null with 0 lines; a null id is not compared and loses nothing; rows of one id hold
    the same places, so repeated rows keep each other's lines. Of two lines that repeat each other the one at the smaller (id, line number)
    stays. A very long text is one row, and costs memory for itself. An empty table gives no rows. Columns of any other name are
    kept as they are; a column of ``docs`` named as one of ``counts`` is replaced.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    gone = repeated_lines(picked, min_words=min_words, near_words=near_words)
    own, lost = free_name(docs, "__id"), free_name(docs, "__gone")
    gone = gone.groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("line").alias(lost))
    held = docs.drop(*counts)
    packed = squeezed(held, text_col)
    joined = packed.join(gone, packed[id_col].cast("long") == gone[own], "left").drop(own)
    text_at, gone_at, names = held.columns.index(text_col), len(held.columns), [*held.columns, *counts]

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, n_lines, n_gone = [], [], []
            for frame, lost in zip(batch.column(text_at).to_pylist(), batch.column(gone_at).to_pylist()):
                text = None if frame is None else codec.decompress(frame)
                rows = [] if text is None else text.split(b"\n")
                out = set(lost or ())
                texts.append(b"\n".join(x for i, x in enumerate(rows) if i not in out) if out and text is not None else text)
                n_lines.append(len(rows))
                n_gone.append(len(out))
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == text_at else c for i, c in enumerate(batch.columns[:gone_at])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_lines, pa.int32()), pa.array(n_gone, pa.int32())], names=names)

    return joined.mapInArrow(restore, T.StructType([*held.schema.fields, *(T.StructField(c, T.IntegerType()) for c in counts)]))
