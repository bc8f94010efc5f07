"""Packing by multiway differencing: near-equal windows from documents of any length."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.llm.tokens import byte_chunks, encoder


def differencing(sizes: list[int], n_windows: int) -> list[list[int]]:
    """Karmarkar-Karp: the items of the given sizes dealt into ``n_windows`` windows of near-equal totals.

    Every item begins as a partial partition with one loaded window. The two partitions of the largest
    spread are merged, the heaviest windows of one with the lightest of the other, until one is left.
    Windows at the end of a partition that are still empty are not stored.
    """
    heap = [(-size, i, [size], [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, in_a = heapq.heappop(heap)
        _, _, b, in_b = heapq.heappop(heap)
        empty = n_windows - len(a)  # windows that take b's heaviest; the rest of b goes on a's lightest
        meet = len(a) - max(0, len(b) - empty)
        loads = a[:meet] + [x + y for x, y in zip(a[meet:], b[:empty - 1 if empty else None : -1])] + b[:empty]
        members = in_a[:meet] + [x + y for x, y in zip(in_a[meet:], in_b[:empty - 1 if empty else None : -1])] + in_b[:empty]
        order = sorted(range(len(loads)), key=loads.__getitem__, reverse=True)
        low = loads[order[-1]] if len(loads) == n_windows else 0
        loads, members = [loads[i] - low for i in order], [members[i] for i in order]
        heapq.heappush(heap, (-loads[0], tie, loads, members))
    members = heap[0][3] if heap else []
    return members + [[] for _ in range(n_windows - len(members))]


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows, counted up from the total's share, that differencing keeps within ``capacity``."""
    n = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, n)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return [w for w in windows if w]
        n += 1


def lay_out(lengths: list[int], capacity: int, slack: float = 0.01) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(item, from, size)`` that hold all items, each of at most ``capacity``.

    Differencing needs the windows' total to be near a multiple of the capacity. Where it isn't (a last, small
    group), tokens at the end of the list that would leave a window mostly empty are cut off and laid
    into sequences whose lengths are powers of two, which are not padded.
    """
    total = sum(lengths)
    n = max(1, -(-total // capacity))
    pieces = [(i, 0, size) for i, size in enumerate(lengths)]
    tail: list[tuple[int, int, int]] = []
    if n * capacity - total > 2 * slack * total:
        cut = total - int((n - 1) * capacity * (1 - slack))
        while cut:
            i, begin, size = pieces.pop()
            take = min(size, cut)
            tail.insert(0, (i, begin + size - take, take))
            if take < size:
                pieces.append((i, begin, size - take))
            cut -= take
    out = [[pieces[k] for k in w] for w in windows_of([p[2] for p in pieces], capacity)] if pieces else []
    left = sum(p[2] for p in tail)
    while left:
        room = length = min(capacity, 1 << (left.bit_length() - 1))
        sequence = []
        while room:
            i, begin, size = tail.pop(0)
            take = min(size, room)
            sequence.append((i, begin, take))
            if take < size:
                tail.insert(0, (i, begin + take, size - take))
            room -= take
        out.append(sequence)
        left -= length
    return out


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    capacity: int = 2048,
    group_windows: int = 128,
    slack: float = 0.01,
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.

    ``capacity`` is a power of two. A document longer than it gives full sequences of its own; what
    remains of the documents of a task is gathered to about ``group_windows`` windows and dealt by
    differencing. There is no shuffle, and a task holds one group, one batch of texts as it came, and the ids of a part of it. A null or
    empty text is the end id alone. Rows of equal id are packed as documents of their own, a null id
    stays null, other columns are ignored, and an empty table gives no rows.
    """
    enough = int(group_windows * capacity * (1 - slack))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, int, np.ndarray, int]] = []  # id, start, ids, tokens of the document
        n_held = 0

        def rows(group: list, sequences: list) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for pieces in sequences:
                offset = 0
                for i, begin, size in pieces:
                    name, start, ids, tokens = group[i]
                    out.append((name, start + begin, size, ids[begin : begin + size].astype("<u4").tobytes(), tokens, sequence, offset))
                    offset += size
                sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), ARROW)], schema=ARROW)

        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in byte_chunks(texts):
                flat, offsets = encoder(vocabulary).encode(texts.slice(lo, hi - lo), end_id)
                full = []
                for k in range(hi - lo):
                    ids = flat[offsets[k] : offsets[k + 1]]
                    n = len(ids)
                    whole = n - n % capacity
                    full += [(names[lo + k], b, ids[b : b + capacity], n) for b in range(0, whole, capacity)]
                    if whole < n:
                        held.append((names[lo + k], whole, ids[whole:].copy(), n))
                        n_held += n - whole
                    if n_held >= enough:
                        yield rows(held, lay_out([len(x[2]) for x in held], capacity, slack))
                        held, n_held = [], 0
                if full:
                    yield rows(full, [[(i, 0, capacity)] for i in range(len(full))])
        if held:
            yield rows(held, lay_out([len(x[2]) for x in held], capacity, slack))

    ARROW = pa.schema(
        [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    )
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        dealt, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
