"""Substring dedup: word windows that start earlier elsewhere, found in compressed FM-indexes.

Windows are routed to shards by their smallest word gram, so equal windows meet in one shard and every document is
streamed only past shards that can know it. A shard lays its distinct pieces of text out in document order, builds
an FM-index over a wavelet matrix of packed bits, and searches every window of the streamed pieces backwards; the
interval of a window names all its occurrences, and the least position in it the earliest. Equal pieces are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.llm.line_dedup import POWERS, _mix, squeezed, word_hashes
from routecover.llm.texts import byte_texts
from routecover.llm.tokens import in_chunks
from routecover.runtime import deleted, settled_at, shuffles_dropped, written


class PackedBits:
    """A bit vector of 64-bit words with the ones before each word."""

    def __init__(self, bits: np.ndarray):
        octets = np.zeros(8 * (len(bits) // 64 + 1), np.uint8)
        packed = np.packbits(bits, bitorder="little")
        octets[: len(packed)] = packed
        self.words = octets.view("<u8")
        ones = np.bitwise_count(self.words)
        self.before = (np.cumsum(ones, dtype=np.int64) - ones).astype(np.uint32)
        self.zeros = len(bits) - int(ones.sum())

    def ones_to(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits, for each i."""
        at = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at] + np.bitwise_count(self.words[at] & low)


class FMIndex:
    """Backward search over a text of word numbers; patterns of up to ``order`` words.

    Suffixes are sorted by their first ``order`` words or more, which is all that patterns of that length can tell apart.
    """

    def __init__(self, text: np.ndarray, order: int):
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        seen = 1
        while seen < order:  # by doubling
            after = np.zeros(n, np.int64)
            after[: max(0, n - seen)] = rank[seen:] + 1
            rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
            seen *= 2
        self.suffixes = np.argsort(rank, kind="stable")
        self.n = n
        last = text[self.suffixes - 1]  # what stands before each suffix; text ends with 0, which no pattern holds
        counts = np.bincount(text, minlength=int(text.max(initial=0)) + 1)
        self.smaller = np.cumsum(counts) - counts
        self.levels: list[PackedBits] = []
        self.depth = max(1, int(text.max(initial=0)).bit_length())
        for level in range(self.depth - 1, -1, -1):
            bits = (last >> level & 1).astype(bool)
            self.levels.append(PackedBits(bits))
            last = np.concatenate([last[~bits], last[bits]])
        # Where each symbol's run begins after the last level.
        self.run = np.searchsorted(_reversed_bits(last, self.depth), _reversed_bits(np.arange(len(counts)), self.depth))

    def ranks(self, symbols: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i of the transformed text."""
        for level, packed in zip(range(self.depth - 1, -1, -1), self.levels):
            ones = packed.ones_to(i).astype(np.int64)
            i = np.where(symbols >> level & 1, packed.zeros + ones, i - ones)
        return i - self.run[symbols]

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of patterns with a symbol put before them."""
        both = self.ranks(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.smaller[symbols]
        return base + both[: len(symbols)], base + both[len(symbols) :]


def _reversed_bits(x: np.ndarray, depth: int) -> np.ndarray:
    """Order of symbols after a wavelet matrix's last level: by their bits, the lowest first."""
    out = np.zeros(len(x), np.int64)
    for level in range(depth):
        out = out << 1 | (x >> level & 1)
    return out


def first_places(pieces: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bases, starts, first)``: where each piece begins in the indexed text, where each window does, and where the same words first stand.

    All windows of all pieces are searched backwards at once. The matching statistic of a window's end is at least ``window`` exactly
    if its interval is not empty after that many steps; the least place in the interval is the first. An indexed piece finds itself at
    least, so a search ends once its own place is the only one left.
    """
    numbers: dict[bytes, int] = {}
    text = np.fromiter((numbers.setdefault(w, len(numbers) + 1) if w is not None else 0 for p in pieces for w in (*p, None)), np.int64)
    index = FMIndex(text, window)
    sizes = np.array([len(p) for p in pieces])
    bases = np.cumsum(sizes + 1) - (sizes + 1)
    count = np.maximum(sizes - window + 1, 0)
    starts = np.repeat(bases - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    first = starts.copy()
    # Windows that have the same interval and go on with the same word are one search from there on.
    who, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, index.n, np.int64)
    wide = len(numbers) + 1
    for back in range(window - 1, -1, -1):
        states, group = np.unique(group * wide + text[starts[who] + back], return_inverse=True)
        low, high = index.extend(states % wide, low[states // wide], high[states // wide])
        shared = high - low > 1
        if not shared.all():
            keep = shared[group]
            who, group = who[keep], (np.cumsum(shared) - 1)[group[keep]]
            low, high = low[shared], high[shared]
    if len(who):
        order = np.argsort(low)  # intervals of one length don't overlap
        edges = np.stack([low[order], high[order]], 1).ravel()
        least = np.empty(len(low), np.int64)
        least[order] = np.minimum.reduceat(np.append(index.suffixes, index.n), edges)[::2]
        first[who] = least[group]
    return bases, starts, first


def earlier_windows(pieces: list[list[bytes]], window: int) -> list[np.ndarray]:
    """For every piece, in the order of their places, the starts of windows that also start earlier in some piece."""
    bases, starts, first = first_places(pieces, window)
    later = starts[first < starts]
    piece = np.searchsorted(bases, later, "right") - 1
    cuts = np.searchsorted(piece, np.arange(len(pieces) + 1))
    return [later[lo:hi] - base for lo, hi, base in zip(cuts[:-1], cuts[1:], bases)]


def streamed_ranges(indexed: pd.DataFrame, stream: pd.DataFrame, window: int, at_once: int = 4096) -> pd.DataFrame:
    """``(doc_id, begin, end)`` of the streamed pieces' windows whose first place in the index is earlier than their own.

    ``indexed(doc_id, start, digest, words)`` are one shard's distinct pieces at their first places, ``stream(doc_id, start, digest)`` the
    pieces of documents. Pieces of one digest are searched once, and each is judged by its own place.
    """
    indexed = indexed.sort_values(["doc_id", "start"], ignore_index=True)
    bases, starts, first = first_places([w.encode().split() for w in indexed["words"]], window)
    piece = np.searchsorted(bases, first, "right") - 1
    first_doc = indexed["doc_id"].to_numpy()[piece]
    first_start = indexed["start"].to_numpy()[piece] + first - bases[piece]
    head = np.searchsorted(starts, bases)
    count = np.diff(np.append(head, len(starts)))
    which = pd.Index(indexed["digest"]).get_indexer(stream["digest"])
    docs, begins = stream["doc_id"].to_numpy(), stream["start"].to_numpy().astype(np.int64)
    out = []
    for lo in range(0, len(which), at_once):
        k, doc, begin = (x[lo : lo + at_once] for x in (which, docs, begins))
        n = count[k]
        row = np.repeat(np.arange(len(k)), n)
        j = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        at = head[k][row] + j
        gone = (first_doc[at] < doc[row]) | ((first_doc[at] == doc[row]) & (first_start[at] < begin[row] + j))
        before, after = np.zeros(len(row), bool), np.zeros(len(row), bool)
        before[1:] = gone[:-1] & (row[1:] == row[:-1])
        after[:-1] = before[1:] & gone[1:]
        opens, closes = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
        out.append(pd.DataFrame({"doc_id": doc[row[opens]], "begin": begin[row[opens]] + j[opens], "end": begin[row[closes]] + j[closes] + window}))
    return pd.concat(out) if out else pd.DataFrame({"doc_id": [], "begin": [], "end": []})


def _batch_pieces(texts: list[bytes], window: int, gram: int, longest: int) -> tuple[np.ndarray, ...]:
    """Pieces ``(text number, first window, windows, key, twice)``: runs of windows with one smallest gram.

    ``twice``: the gram stands there more than once, so the piece may repeat a window of its own.
    """
    words, sizes = [], []
    for t in texts:
        cut = t.split()
        sizes.append(len(cut))
        words += cut
    n, total = np.array(sizes, np.int64), len(words)
    ends = np.cumsum(n)
    text_of = np.repeat(np.arange(len(texts)), n)
    whole = np.arange(total) + window <= ends[text_of] if total else np.zeros(0, bool)
    if not whole.any():
        return (*(np.empty(0, np.int64),) * 4, np.empty(0, bool))
    POWERS.upto(total + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(word_hashes(words) * POWERS.up[:total], dtype=np.uint64)])
    grams = _mix((sums[gram:] - sums[:-gram]) * POWERS.down[: total + 1 - gram], gram)
    least, wide, reach = grams, 1, window - gram + 1
    while 2 * wide <= reach:
        least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
    if wide < reach:
        least = np.minimum(least[: len(least) - (reach - wide)], least[reach - wide :])
    at = np.flatnonzero(whole)
    key, text = least[at], text_of[at]
    new = np.ones(len(at), bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    run = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    head = np.flatnonzero(within % longest == 0)
    times = sum((grams[at + j] == key).astype(np.int8) for j in range(reach))
    inside = np.ones(len(at), bool)  # the next window belongs to the piece too
    inside[:-1] = within[1:] % longest != 0
    inside[-1] = False
    next_gram = np.minimum(at + reach, len(grams) - 1)
    twice = (times > 1) | (inside & (grams[at] == key) & (grams[next_gram] == key))
    return text[head], at[head] - (ends - n)[text[head]], np.diff(np.append(head, len(at))), key[head], np.logical_or.reduceat(twice, head)


def repeated_windows(
    docs: DataFrame, *, window: int = 20, gram: int = 5, longest: int = 64, shard_words: int = 400_000, hot: int = 20_000, stream_rows: int = 200_000
) -> DataFrame:
    """``(doc_id, begin, end)``: word ranges of ``docs(doc_id, text)`` covered by windows that also start earlier.

    Earlier is a smaller doc_id, or the same and an earlier start. A piece is a run of up to ``longest`` windows that
    share their smallest gram of ``gram`` words. Pieces whose gram stands once in all documents can hold no repeat and
    stay where they are. Of equal pieces the earliest is indexed, and all pieces, copies too, are streamed past their shard's index, which
    decides every window. A gram with over ``hot`` pieces is routed by whole windows instead; shards hold about ``shard_words`` words. A
    shard with over ``stream_rows`` streamed pieces is indexed in several tasks, each for a part of the stream, so no task grows with a group of copies.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.array(batch.column(0).to_pylist(), np.int64), byte_texts(batch)
            for lo, hi in in_chunks(texts):
                text, start, n, key, twice = _batch_pieces(texts[lo:hi], window, gram, longest)
                yield pa.RecordBatch.from_arrays([pa.array(ids[lo:hi][text]), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(key), pa.array(twice)], names=["doc_id", "start", "n", "key", "twice"])

    pieces, first_pieces = settled_at(docs.mapInArrow(scan, "doc_id long, start int, n int, key long, twice boolean"), "pieces")
    shared = pieces.groupBy("key").agg(F.count("*").alias("c"), F.max("twice").alias("twice")).where("c > 1 or twice").select("key", (F.col("c") > hot).alias("is_hot"))
    wanted = pieces.join(shared, "key").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "key", "is_hot")).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown: set[bytes] = set()
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for name, frame, asked in zip(*(c.to_pylist() for c in batch.columns)):
                words = codec.decompress(frame).split()
                for p in asked:
                    single = p["is_hot"]
                    for start in range(p["start"], p["start"] + p["n"]) if single else (p["start"],):
                        n = 1 if single else p["n"]
                        part = words[start : start + n + window - 1]
                        if len(part) < n + window - 1:
                            continue  # of another row with this id
                        joined = b" ".join(part)
                        digest = xxhash.xxh3_128_digest(joined)
                        key = xxhash.xxh3_64_intdigest(joined) - (1 << 63) if single else p["key"]
                        new = digest not in shown
                        if new:
                            shown.add(digest)
                        out.append((name, start, n, key, digest, joined if new else None))
            if len(shown) > 2_000_000:
                shown.clear()
            columns = list(zip(*out)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "start", "n", "key", "digest", "words"])

    asked = squeezed(docs.select("doc_id", "text"), "text").join(wanted, "doc_id").select("doc_id", "text", "wanted")
    found = written(asked.mapInArrow(cut, "doc_id long, start int, n int, key long, digest binary, words string"), "found-pieces", compression="zstd")
    deleted(docs.sparkSession, first_pieces)
    each = found.groupBy("digest").agg(
        F.min(F.struct("doc_id", "start")).alias("place"), F.count("*").alias("c"), F.first("words", True).alias("words"), F.first("key").alias("key"), F.first("n").alias("n")
    )
    distinct = written(each, "distinct-pieces", compression="zstd")
    total = distinct.agg(F.sum(F.col("n") + window - 1)).first()[0] or 0
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // shard_words)))).alias("shard")
    parts = F.ceil(F.sum("c") / stream_rows).cast("int")
    busy = written(distinct.groupBy(shard).agg(parts.alias("parts")).where("parts > 1"), "busy-shards")
    spread = lambda df: df.join(busy, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    indexed = spread(distinct.select(shard, "place.doc_id", "place.start", "digest", "words")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    stream = spread(found.select(shard, "doc_id", "start", "digest")).withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.col("parts")).cast("int"))

    def search(pieces: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return streamed_ranges(pieces, asked, window)

    by = ("shard", "part")
    return indexed.drop("parts").groupBy(*by).cogroup(stream.drop("parts").groupBy(*by)).applyInPandas(search, "doc_id long, begin int, end int")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, text)`` for every row: its words, joined by one space, without those in repeated windows.

    Windows are judged on the input. A null text has no words (and becomes empty); a row with a null id is not compared and loses
    nothing; rows of one id count as one document, so repeated rows keep what the first would. Other columns are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with shuffles_dropped(docs.sparkSession):
        ranges = written(repeated_windows(picked.where("doc_id is not null and text is not null"), window=window), "ranges")
    ranges = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, left = [], [], []
            for frame, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = codec.decompress(frame).split() if frame is not None else []
                keep = np.ones(len(words), bool)
                for r in gone or ():
                    keep[r["begin"] : r["end"]] = False
                sizes.append(len(words))
                removed.append(len(words) - int(keep.sum()))
                left.append(b" ".join(words if not gone else [w for w, k in zip(words, keep.tolist()) if k]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "text"])

    joined = squeezed(picked, "text").join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, text string")
