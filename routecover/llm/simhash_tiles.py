"""SimHash near-duplicates by exact comparison of fingerprint tiles.

Fingerprints are split into tiles by the population counts of their parts. If two fingerprints differ
in at most ``radius`` bits, their counts differ by at most that in total, so only tiles that near are
compared, each pair in one task, with numpy's exclusive-or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.llm.groups import Near, by_group, dealt, linked, similar, with_heads
from routecover.llm.texts import byte_texts, give_back
from routecover.operators.components import connected_components
from routecover.runtime import written

#: Shingles whose bits are counted at once.
SLICE = 1 << 16
#: Least values of sets are taken under this many orders, two for each lane (made from a fixed seed).
LANES = 12
#: Groups of at most so many fingerprints are compared all at once.
SMALL = 256
ORDERS = np.random.default_rng(5).integers(0, 1 << 63, (2, 2 * LANES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingle_places(text: bytes, shingle: int) -> tuple[bytes, list[int], list[int]]:
    """The lowered words joined by a space, and where each shingle begins and ends there (with the space after it)."""
    words = text.lower().split()
    if not words:
        return b"", [], []
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [int(ends[-1])]
    return joined, [0, *ends[: len(last) - 1].tolist()], last


def _hashes(joined: bytes, first: list[int], last: list[int], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip(first, last)), np.uint64, len(last))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), SLICE):
        octets = hashes[i : i + SLICE].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def text_fingerprint(text: bytes, shingle: int, units: int) -> list[int]:
    """``units`` unsigned 64-bit words: a bit is 1 if it is set in over half of the shingles' hashes.

    A-Z are lowered, words are runs of other bytes than ASCII white space, shingles are ``shingle`` words
    joined by a space, repeats included (fewer words: all of them as one; none: all zero). Word j uses XXH64 of seed 42 + j.
    """
    places = _shingle_places(text, shingle)
    return [_majority(_hashes(*places, seed)) for seed in range(42, 42 + units)]


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, in order."""
    return np.unique(_hashes(*_shingle_places(text, shingle), 42))


def lanes_of(hashes: np.ndarray) -> np.ndarray:
    """One key for each lane, from the set's least values under two orders; sets of similarity s share a given key with probability s * s."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    least = np.full(2 * LANES, ~np.uint64(0))
    for i in range(0, len(hashes), SLICE >> 4):
        least = np.minimum(least, ((hashes[None, i : i + (SLICE >> 4)] ^ ORDERS[0]) * ORDERS[1]).min(1))
    return (least[::2] * np.uint64(0x9E3779B97F4A7C15)) ^ least[1::2] ^ np.arange(LANES, dtype=np.uint64)


def set_fingerprint(text: bytes, shingle: int, units: int) -> tuple[int, list[int], int, np.ndarray]:
    """A 64-bit name of the text's set of shingles, its fingerprint with each distinct shingle counted once, the set's size, and its lanes."""
    joined, first, last = _shingle_places(text, shingle)
    hashes, at = np.unique(_hashes(joined, first, last, 42), return_index=True)
    first, last = [first[i] for i in at], [last[i] for i in at]
    more = [_majority(_hashes(joined, first, last, seed)) for seed in range(43, 42 + units)]
    return xxhash.xxh3_64_intdigest(hashes.tobytes()), [_majority(hashes), *more], len(hashes), lanes_of(hashes)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, units: int = 1) -> DataFrame:
    """``(doc_id, f0, ...)``: the fingerprint of every whole text as ``units`` signed longs. A null text has no words."""
    names = [f"f{j}" for j in range(units)]
    arrow = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([text_fingerprint(t, shingle, units) for t in byte_texts(batch)], np.uint64).reshape(-1, units)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, j].astype(np.int64)) for j in range(units))], schema=arrow)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(of, ", ".join(["doc_id long", *(f"{n} long" for n in names)]))


def near_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links ``(row of a, row of b)`` at ``radius`` bits or fewer: of all of them, as many as connect what they connect.

    ``a`` and ``b`` are (n, units) arrays; ``same``: b is a. Rows are taken in strips against the rows
    of b whose population counts are within the radius.
    """
    n_a = len(a)
    order = np.argsort(np.bitwise_count(b).sum(1), kind="stable")
    b = b[order]
    counts = np.bitwise_count(b).sum(1)
    a_counts = np.bitwise_count(a).sum(1)
    by_count = np.argsort(a_counts, kind="stable")
    label = np.arange(n_a if same else n_a + len(b))
    out: list[tuple[int, int]] = []
    strip = max(1, (1 << 18) // max(1, len(b)))
    for i in range(0, n_a, strip):
        rows = by_count[i : i + strip]
        lo = np.searchsorted(counts, int(a_counts[rows[0]]) - radius, "left")
        hi = np.searchsorted(counts, int(a_counts[rows[-1]]) + radius, "right")
        if lo == hi:
            continue
        apart = np.zeros((len(rows), hi - lo), np.uint8)
        for j in range(a.shape[1]):
            apart += np.bitwise_count(a[rows, j, None] ^ b[None, lo:hi, j])
        near = apart <= radius
        for r in np.flatnonzero(near.any(1)):
            row = int(rows[r])
            partners = order[lo + np.flatnonzero(near[r])]
            nodes = partners if same else partners + n_a
            labels, at = np.unique(label[nodes], return_index=True)
            for other, k in zip(labels.tolist(), at.tolist()):
                own = int(label[row])
                if other != own:
                    label[label == max(own, other)] = min(own, other)
                    out.append((row, int(partners[k])))
    return out


def near_pairs(prints: np.ndarray, sides: np.ndarray, sizes: np.ndarray, radius: int, least: float, alone: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows (i, j, bits apart) at ``radius`` bits or fewer, in strips: every pair once if ``alone``, else of side False with side True.

    Rows are taken in order of population counts, and only those within the radius of a strip's counts are compared; sets
    of sizes too far apart for a similarity of ``least`` are passed over.
    """
    counts = np.bitwise_count(prints).sum(1).astype(np.int64)
    order = np.argsort(counts, kind="stable")
    first, second = (order, order) if alone else (order[~sides[order]], order[sides[order]])
    strip = max(1, (1 << 18) // max(1, len(second)))
    for k in range(0, len(first), strip):
        rows = first[k : k + strip]
        lo, hi = np.searchsorted(counts[second], [counts[rows[0]] - radius, counts[rows[-1]] + radius + 1], "left")
        others = second[lo:hi]
        apart = np.zeros((len(rows), len(others)), np.int32)
        for j in range(prints.shape[1]):
            apart += np.bitwise_count(prints[rows, j, None] ^ prints[None, others, j])
        x, y = np.nonzero(apart <= radius)
        i, j, bits = rows[x], others[y], apart[x, y]
        fine = np.minimum(sizes[i], sizes[j]) * 1000 >= np.maximum(sizes[i], sizes[j]) * round(least * 1000)
        if alone:
            fine &= i < j
        yield i[fine], j[fine], bits[fine]


def connecting(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> list[tuple[int, int]]:
    """Of pairs (i, j, bits apart) of n rows as many as connect what all of them connect."""
    label, out = np.arange(n), []
    for i, j, _ in pairs:
        for a, b in zip(i.tolist(), j.tolist()):
            if label[a] != label[b]:
                label[label == max(label[a], label[b])] = min(label[a], label[b])
                out.append((a, b))
    return out


def _tile_offsets(parts: int, width: int, radius: int) -> list[tuple[int, ...]]:
    """Steps from a tile to those that can hold a fingerprint within the radius, one of each step and its opposite."""
    reach = (radius + width - 1) // width
    least = lambda d: sum(max(0, (abs(x) - 1) * width + 1) if x else 0 for x in d)
    return [d for d in product(range(-reach, reach + 1), repeat=parts) if least(d) <= radius and d >= (0,) * parts]


def link_fingerprints(prints: DataFrame, *, units: int = 1, radius: int = 2, block: int = 4096) -> DataFrame:
    """``(u, v)``: pairs of ids whose fingerprints differ in ``radius`` bits or fewer, enough to connect all that such pairs connect.

    ``prints`` is ``(id, f0, ...)`` with distinct ids. A tile's population counts are those of
    four quarters of the bits for a small radius, else one count in steps of ``radius + 1``. Tiles of
    more than ``block`` fingerprints are cut by hash, so no task holds more than two blocks. The tables
    of tiles and of block pairs are derived from counts, not from pairs of fingerprints.
    """
    names = [f"f{j}" for j in range(units)]
    parts, width = (4, 1) if radius <= 3 else (1, radius + 1)
    mask = lambda q: (1 << 16) - 1 << 16 * q
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    if parts == 4:
        counts = [sum((F.bit_count(F.col(n).bitwiseAND(F.lit(signed(mask(q))))) for n in names[1:]), F.bit_count(F.col("f0").bitwiseAND(F.lit(signed(mask(q)))))) for q in range(4)]
    else:
        counts = [sum((F.bit_count(n) for n in names[1:]), F.bit_count("f0"))]
    step = 1 + 64 * units
    tile = F.lit(0).cast("long")
    for c in counts:
        tile = tile * step + F.floor(c / width)
    tiled = prints.withColumn("tile", tile)
    # At most 17**4 or 64 * units + 1 rows, whatever the input.
    sizes = written(tiled.groupBy("tile").agg(F.ceil(F.count("*") / block).cast("int").alias("n")).coalesce(1), "tiles")
    blocks = (
        tiled.join(F.broadcast(sizes), "tile")
        .withColumn("cut", F.pmod(F.xxhash64(*names, "id"), F.col("n")).cast("int"))
        .groupBy("tile", "cut")
        .agg(F.collect_list(F.struct("id", *names)).alias("rows"))
    )
    blocks = blocks.select("tile", "cut", F.col("rows.id").alias("ids"), *(F.col(f"rows.{n}").alias(n) for n in names))
    offsets = []
    for d in _tile_offsets(parts, width, radius):
        total = 0
        for x in d:
            total = total * step + x
        offsets.append(total)
    around = sizes.select("tile", "n", F.explode(F.array(*map(F.lit, offsets))).alias("d"))
    pairs = (
        around.select(F.col("tile").alias("a_tile"), F.col("n").alias("a_n"), (F.col("tile") + F.col("d")).alias("b_tile"))
        .join(sizes.select(F.col("tile").alias("b_tile"), F.col("n").alias("b_n")), "b_tile")
        .withColumn("a_cut", F.explode(F.sequence(F.lit(0), F.col("a_n") - 1)))
        .withColumn("b_cut", F.explode(F.sequence(F.lit(0), F.col("b_n") - 1)))
        .where((F.col("a_tile") != F.col("b_tile")) | (F.col("a_cut") <= F.col("b_cut")))
        .select("a_tile", "a_cut", "b_tile", "b_cut")
    )
    side = lambda p: blocks.select(*(F.col(c).alias(f"{p}_{c}") for c in ("tile", "cut", "ids", *names)))
    met = pairs.join(side("a"), ["a_tile", "a_cut"]).join(side("b"), ["b_tile", "b_cut"]).withColumn("same", (F.col("a_tile") == F.col("b_tile")) & (F.col("a_cut") == F.col("b_cut")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u: list[np.ndarray] = [np.empty(0, np.int64)]
            v: list[np.ndarray] = [np.empty(0, np.int64)]
            for k in range(batch.num_rows):
                get = lambda c: np.asarray(batch.column(at[c])[k].values)  # noqa: B023, E731
                a_ids, b_ids = get("a_ids"), get("b_ids")
                a, b = (np.stack([get(f"{p}_{n}") for n in names], 1).astype(np.uint64) for p in "ab")
                i, j = np.array(near_links(a, b, radius, batch.column(at["same"])[k].as_py()), np.int64).reshape(-1, 2).T
                u.append(a_ids[i])
                v.append(b_ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (u, v)], names=["u", "v"])
            give_back()

    columns = [*(f"{p}_{c}" for p in "ab" for c in ("ids", *names)), "same"]
    at = {c: i for i, c in enumerate(columns)}
    return met.select(*columns).mapInArrow(compare, "u long, v long")


def simhash_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, units: int = 1, radius: int = 2
) -> DataFrame:
    """``(doc_id, f0, ..., component_id)``: one row per document, with the smallest id reachable over links.

    Documents link at ``radius`` or fewer differing bits. Equal fingerprints are one node, named by the
    smallest id, before anything is compared. A document with a null id keeps its row and its
    fingerprint and gets the component of that fingerprint, but names none (null if no other has it). Null and empty
    texts have the zero fingerprint and link like any other. Repeated rows keep their rows; other columns are
    ignored.
    """
    names = [f"f{j}" for j in range(units)]
    prints = written(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, units=units), "prints")
    nodes = prints.groupBy(*names).agg(F.min("doc_id").alias("id"))
    links = written(link_fingerprints(nodes.where("id is not null"), units=units, radius=radius), "links")
    groups = connected_components(links).select(F.col("node").alias("id"), "component")
    named = nodes.join(groups, "id", "left").select(*names, F.coalesce("component", "id").alias("component_id"))
    return prints.join(named, names).select("doc_id", *names, "component_id")


def near_copy_groups(docs: DataFrame, *, shingle: int = 5, units: int = 2, radius: int = 36, least: float = 0.8, block: int = 16_384, set_block: int = 2_000_000, max_broadcast: int = 200_000) -> DataFrame:
    """``(doc_id, text_hash, component_id)``: one row per row of ``docs`` (doc_id, text), ``text_hash`` being Spark's xxhash64 of the text.

    Two texts link if their fingerprints over distinct shingles differ in ``radius`` bits or fewer and the Jaccard
    similarity of their sets of shingles is ``least`` or more; components of such links are groups. Nodes are distinct sets.
    Only sets that share a lane are compared, so the work grows with the near pairs and not with all pairs: at a similarity of 0.8 two sets share
    none of the 12 lanes with probability 0.36 ** 12, under one in 200 000. A row with a null text has an empty set; rows with empty sets are one group. An empty table gives no rows; texts may have any length.
    Rows without an id are rows like others. Lanes give links between near fingerprints, at most one for each row; the sets of what these connect are fetched once for each
    node and compared there. So what is written grows with the rows, not with the pairs, also where many texts are near but not near enough: only lanes of over
    ``block`` rows and clusters of over ``set_block`` shingles are cut, and then only rows that don't link with the first are sent more than once.
    """
    longs = ["doc_id", "text_hash", "id", "size"]
    arrow = pa.schema([*((n, pa.int64()) for n in longs), ("print", pa.binary()), ("lanes", pa.list_(pa.int64()))])
    bound = round(least * 100)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [set_fingerprint(t, shingle, units) for t in byte_texts(batch)]
            ends = np.cumsum([0, *(len(x[-1]) for x in found)])
            flat = np.concatenate([np.empty(0, np.uint64), *(x[-1] for x in found)]).astype(np.int64)
            lanes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
            own = pa.array(np.array([x[0] for x in found], np.uint64).astype(np.int64))
            sizes, prints = pa.array([x[2] for x in found], pa.int64()), pa.array([np.array(x[1], np.uint64).tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), own, sizes, prints, lanes], schema=arrow)
            give_back()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.sort(shingle_set(t, shingle).astype(np.int64)).tobytes() for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])
            give_back()

    def apart(a: bytes, b: bytes) -> int:
        return int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum())

    def prints_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return np.stack([np.frombuffer(x, np.uint64) for x in group.column("print").to_pylist()]), np.asarray(group.column("size"))

    def small(group: pa.Table) -> list[tuple[int, int]]:
        prints, sizes = prints_of(group)
        sides, alone = np.asarray(group.column("cut")) == 0, group.column("a")[0].as_py() < 0
        return connecting(near_pairs(prints, sides, sizes, radius, least, alone), len(prints))

    def near_prints(group: pa.Table) -> Near:
        prints, sizes = prints_of(group)

        def near(row: int, others: np.ndarray) -> np.ndarray:
            others = others[100 * np.minimum(sizes[others], sizes[row]) >= bound * np.maximum(sizes[others], sizes[row])]
            return others[np.bitwise_count(prints[others] ^ prints[row]).sum(1) <= radius]

        return near

    def near_sets(group: pa.Table) -> Near:
        near = near_prints(group)
        sets = [np.frombuffer(x, np.int64) for x in group.column("shingles").to_pylist()]

        def both(row: int, others: np.ndarray) -> np.ndarray:
            others = near(row, others)
            return others[[similar(sets[row], sets[k], bound) for k in others.tolist()]] if len(others) else others

        return both

    def links_of(rows: DataFrame, value: str, with_head, near, block: int, name: str) -> DataFrame:
        marked, found = with_heads(rows, value, lambda values, heads: np.array([with_head(a, b) for a, b in zip(values, heads)], bool), block)

        def each(group: pa.Table) -> Iterator[pa.RecordBatch]:
            if value == "print" and group.num_rows <= SMALL:  # all at once
                ids = np.asarray(group.column("id"))
                u, v = np.array(small(group), np.int64).reshape(-1, 2).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])
            else:
                yield linked(group, near(group))

        return written(found.unionByName(by_group(dealt(marked, block), each, "u long, v long")).distinct(), name)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    prints = written(texts.mapInArrow(of, ", ".join([*(f"{n} long" for n in longs), "print binary", "lanes array<long>"])), "set-prints")
    nodes = written(prints.groupBy("id").agg(F.min("text_hash").alias("text_hash"), F.first("size").alias("size"), F.first("print").alias("print"), F.first("lanes").alias("lanes")), "set-nodes")
    each_lane = nodes.select("id", "size", "print", F.explode("lanes").alias("lane"))
    shared_lanes = each_lane.groupBy("lane").agg(F.count("*").alias("c")).where("c > 1").select("lane")
    rows = written(each_lane.join(shared_lanes, "lane").withColumn("weight", F.lit(1)), "lanes")
    proposed = links_of(rows, "print", lambda a, b: apart(a, b) <= radius, near_prints, block, "near-links")
    clusters = connected_components(proposed).select(F.col("component").alias("lane"), F.col("node").alias("id"))
    clusters = written(clusters.join(nodes.select("id", "size", "text_hash", "print"), "id"), "near-nodes")
    wanted = clusters.select("id", "text_hash")
    wanted = F.broadcast(wanted) if clusters.count() <= max_broadcast else wanted
    sets = written(texts.select("text_hash", "text").join(wanted, "text_hash").dropDuplicates(["id"]).select("id", "text").mapInArrow(sets_of, "id long, shingles binary"), "near-sets")
    full = written(clusters.select("lane", "id", "size", "print", F.col("size").alias("weight")).join(sets, "id"), "near-clusters")
    similar_links = links_of(full, "shingles", lambda a, b: similar(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), bound), near_sets, set_block, "similar-links")
    groups = connected_components(similar_links).withColumnRenamed("node", "id")
    return prints.join(groups, "id", "left").select("doc_id", "text_hash", F.coalesce("component", "id").alias("component_id"))
