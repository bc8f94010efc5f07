"""Target-distribution importance resampling over hashed n-grams, with a vocabulary of frequent words and pairs.

The CRC-32 of joined strings follows from the CRC-32 of each and the later one's length: the first one's is moved on by that many zero bytes, a linear map kept as four
tables of 256 values. So a word is hashed once, and longer features come from words' states. The states of frequent words, and the buckets of
frequent pairs, are sent to every task; all other words and features are hashed directly. Both give the same buckets, so totals are exact.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routecover.llm.texts import byte_texts, crc_joined, give_back
from routecover.operators.scans import numbered
from routecover.runtime import written

#: Longer words are always hashed directly.
LONGEST = 48
#: Bytes that are no part of a word become spaces, and A-Z are lowered.
KEPT = bytes(b if b > 0x7F or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII bytes, A-Z lowered first."""
    return text.translate(KEPT).split()


@dataclass
class Vocabulary:
    """Frequent words, at most ``LONGEST`` bytes each, and frequent pairs of them as places in ``words``."""

    words: list[bytes]
    pairs: list[tuple[int, int]]


class Hasher:
    """Buckets of all features of a text; made once in each task."""

    def __init__(self, vocabulary: Vocabulary, buckets: int, longest_run: int):
        self.buckets, self.longest_run = buckets, longest_run
        self.place = {w: i for i, w in enumerate(vocabulary.words)}
        head = vocabulary.words
        self.state = np.array([zlib.crc32(w) for w in head], np.uint32)
        self.after = np.array([zlib.crc32(b" " + w) for w in head], np.uint32)
        self.size = np.array([len(w) + 1 for w in head], np.int64)
        # moved[n, k, b]: the CRC-32 with byte k equal to b and all else 0, moved on by n bytes.
        self.moved = np.zeros((LONGEST + 2, 4, 256), np.uint32)
        for n in range(LONGEST + 2):
            bit = [crc_joined(1 << i, 0, n) for i in range(32)]
            for k in range(4):
                for i in range(8):
                    self.moved[n, k, 1 << i : 2 << i] = self.moved[n, k, : 1 << i] ^ np.uint32(bit[8 * k + i])
        pairs = np.array(vocabulary.pairs, np.int64).reshape(-1, 2)
        names = pairs[:, 0] * len(head) + pairs[:, 1]
        by_name = np.argsort(names)
        self.pair_names = names[by_name]
        joined = self.follow(self.state[pairs[:, 0]], self.after[pairs[:, 1]], self.size[pairs[:, 1]])
        self.pair_states = joined[by_name]

    def follow(self, state: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
        """States with a space and a word after them."""
        part = lambda k: self.moved[size, k, (state >> np.uint32(8 * k)) & np.uint32(255)]
        return part(0) ^ part(1) ^ part(2) ^ part(3) ^ after

    def states(self, words: list[bytes]) -> Iterator[np.ndarray]:
        """The CRC-32 of all runs of 1, 2, ... words."""
        n = len(words)
        place = np.fromiter(map(self.place.get, words, (-1,) * n), np.int64, n)
        tail = np.flatnonzero(place < 0)
        own, after, size = (np.empty(n, kind) for kind in (np.uint32, np.uint32, np.int64))
        known = place >= 0
        at = place[known]
        own[known], after[known], size[known] = self.state[at], self.after[at], self.size[at]
        for i in tail.tolist():
            w = words[i]
            own[i], after[i], size[i] = zlib.crc32(w), zlib.crc32(b" " + w), len(w) + 1
        yield own
        state = own
        for run in range(2, self.longest_run + 1):
            if n < run:
                return
            before, state = state[: n - run + 1], np.empty(n - run + 1, np.uint32)
            todo = np.ones(len(state), bool)
            if run == 2 and len(self.pair_names):
                name = np.where(known[:-1] & known[1:], place[:-1] * len(self.place) + place[1:], -1)
                found = np.minimum(np.searchsorted(self.pair_names, name), len(self.pair_names) - 1)
                hit = self.pair_names[found] == name
                state[hit] = self.pair_states[found[hit]]
                todo = ~hit
            last = size[run - 1 :]
            moved = todo & (last <= LONGEST + 1)
            state[moved] = self.follow(before[moved], after[run - 1 :][moved], last[moved])
            for i in np.flatnonzero(todo & ~moved).tolist():  # a long word
                state[i] = zlib.crc32(b" " + words[i + run - 1], int(before[i]))
            yield state

    def features(self, words: list[bytes]) -> np.ndarray:
        """The bucket of every feature, repeats included."""
        found = [s % np.uint32(self.buckets) for s in self.states(words)] if words else []
        return np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int64)


def _pruned(counts: Counter, most: int) -> Counter:
    least = 1
    while len(counts) > most:
        counts = Counter({k: c for k, c in counts.items() if c > least})
        least *= 2
    return counts


def frequent(texts: DataFrame, n_words: int, n_pairs: int, held: int = 200_000) -> Vocabulary:
    """The most frequent words of ``texts(text)`` and pairs of them, counted over all texts.

    A task that holds more than ``held`` words or pairs drops the rarest, so memory is bounded and counts of rare ones may be too
    low; which words are in the vocabulary changes the work but no result. At most ``n_words`` and ``n_pairs`` reach the driver.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs: Counter = Counter()
        for batch in batches:
            for text in byte_texts(batch):
                found = words_of(text)
                words.update(found)
                pairs.update(zip(found, found[1:]))
                words, pairs = _pruned(words, held), _pruned(pairs, held)
            give_back()
        some = [((a, None), c) for a, c in words.items() if len(a) <= LONGEST and c > 1]
        some += [(ab, c) for ab, c in pairs.items() if max(map(len, ab)) <= LONGEST and c > 1]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in some], pa.binary()), pa.array([k[1] for k, _ in some], pa.binary()), pa.array([c for _, c in some], pa.int64())], names=["a", "b", "c"])

    counts = written(texts.mapInArrow(of, "a binary, b binary, c long").groupBy("a", "b").agg(F.sum("c").alias("c")), "word-counts")
    top = lambda rows, n: rows.orderBy(F.desc("c"), "a", "b").limit(n).collect()
    words = [bytes(r["a"]) for r in top(counts.where("b is null"), n_words)]
    place = {w: i for i, w in enumerate(words)}
    pairs = [(place.get(bytes(r["a"])), place.get(bytes(r["b"]))) for r in top(counts.where("b is not null"), n_pairs)]
    return Vocabulary(words, [p for p in pairs if None not in p])


def bucket_totals(texts: DataFrame, vocabulary: Vocabulary, buckets: int, longest_run: int) -> np.ndarray:
    """How many features of all ``texts(text)`` are in every bucket."""
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, totals = Hasher(shared.value, buckets, longest_run), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in byte_texts(batch):
                totals += np.bincount(hasher.features(words_of(text)), minlength=buckets)
            give_back()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.mapInArrow(of, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of every bucket, in doubles."""
    of_source, of_target = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1) * of_source / ((s + 1) * of_target))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(seed: int, id_col: Column) -> Column:
    """A whole-number Gumbel variate of every id: floor(-1000 * ln(-ln((h + 0.5) / 2 ** 32))), h from the first 8 hex digits of sha256("seed:id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), id_col.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def importance_sample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = 10_000, longest_run: int = 3,
    least_words: int = 20, percent: int = 5, seed: int = 42, n_words: int = 32_768, n_pairs: int = 65_536,
) -> DataFrame:
    """``(doc_id, n_features, n_words, weight, score, rank)`` of every document.

    ``weight`` sums, over all runs of 1 to ``longest_run`` words, how much likelier their buckets are in ``target`` than in ``docs``; ``score`` adds Gumbel noise by id, so that the
    highest scores are a draw without replacement in proportion to the exponential of the weight. Of the N documents of at least ``least_words`` words
    floor(percent * N / 100) are drawn and ranked from 1, ties to smaller ids; undrawn documents have a null rank.

    A null or empty text has no features and weight 0. A document without an id counts in the totals and has a weight, but no score, isn't counted in N and isn't drawn.
    Repeated rows are documents of their own, of equal score if the texts are equal; an empty ``docs`` gives no rows, an empty target totals of 0. Texts of any length are hashed word
    by word. Other columns are ignored. The vocabulary sent to the tasks is bounded by ``n_words`` and ``n_pairs`` of at most 48 bytes a word.
    """
    texts = docs.select(F.col(text_col).alias("text"))
    wanted = target.select(F.col(target_col).alias("text"))
    vocabulary = frequent(texts.unionByName(wanted), n_words, n_pairs)
    gain = gains(bucket_totals(texts, vocabulary, buckets, longest_run), bucket_totals(wanted, vocabulary, buckets, longest_run))
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, gain))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, own = Hasher(shared.value[0], buckets, longest_run), shared.value[1]
        for batch in batches:
            out = []
            for text in byte_texts(batch):
                words = words_of(text)
                features = hasher.features(words)
                out.append((len(features), len(words), int(own[features].sum())))
            rows = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, j]) for j in range(3))], names=["doc_id", "n_features", "n_words", "weight"])
            give_back()

    weighed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(of, "doc_id long, n_features long, n_words long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(seed, F.col("doc_id"))), "weights")
    fit = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    drawn = scored.where(fit).count() * percent // 100
    placed = numbered(scored.withColumn("fit", fit), [], [F.desc("fit"), F.desc("score"), F.asc("doc_id"), F.asc("weight"), F.asc("n_features")], "place")
    return placed.select("doc_id", "n_features", "n_words", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
