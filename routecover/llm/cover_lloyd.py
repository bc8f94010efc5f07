"""Vector code compression: codebooks for the parts of vectors, fitted by Lloyd rounds over cover trees.

A block of rows of one partition has a cover tree for each part. Its points lie in the tree's own order, so a node is a run of them, and differences of
cumulative sums give a node's sum. A node of radius r whose point is at distances d1 and d2 from its nearest two entries goes whole to
the nearest if d1 + r < d2 - r; only other nodes are opened, and only points of ambiguous leaves are compared one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.runtime import written

#: A component of this size or more could bring a squared distance beyond a long.
LARGEST = 1 << 28
#: Below this a sum of squares is exact in doubles.
EXACT = float(1 << 52)


@dataclass
class CoverTree:
    """``points`` in the tree's order, and where each came from; nodes with their point, run, children and radius. Node 0 is the root."""

    points: np.ndarray
    order: np.ndarray
    center: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray

    def to_bytes(self) -> bytes:
        n, d = self.points.shape
        narrow = bool(np.abs(self.points).max(initial=0) < 1 << 31)
        head = np.array([n, d, len(self.center), narrow], np.int64)
        nodes = np.stack([self.center, self.lo, self.hi, self.child, self.children]).astype(np.int32)
        return b"".join(x.tobytes() for x in (head, self.radius, self.points.astype(np.int32 if narrow else np.int64), self.order.astype(np.int32), nodes))

    @staticmethod
    def from_bytes(data: bytes) -> CoverTree:
        n, d, m, narrow = np.frombuffer(data, np.int64, 4).tolist()
        at = 32

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        radius = take(np.float64, m)
        points = take(np.int32 if narrow else np.int64, n * d).astype(np.int64).reshape(n, d)
        order, nodes = take(np.int32, n), take(np.int32, 5 * m).reshape(5, m)
        return CoverTree(points, order, *nodes, radius)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows: in doubles where these are exact, else in longs."""
    most = float(max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)))
    if 4 * most * most * max(1, a.shape[1]) < EXACT:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None]
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def cover_tree(points: np.ndarray, leaf: int = 16, base: float = 1.5) -> CoverTree:
    """A cover tree over integer rows: a node's children cover its points within ``radius / base``, and lie farther than that from each other.

    A node of at most ``leaf`` points, or of equal points only, is a leaf. Equal rows are in one leaf, however many.
    """
    order, nodes = [], []
    # (rows, their distances to the node's point, the node's point, its number)
    root = np.arange(len(points))
    apart = np.sqrt(squared(points, points[:1])[:, 0]) if len(points) else np.empty(0)
    level = [(root, apart, 0)]
    tree: list[list] = [[]]
    shape: list[tuple] = []
    while level:
        below = []
        for rows, apart, center in level:
            number, radius = len(shape), float(apart.max(initial=0.0))
            shape.append((center, radius, rows))
            if len(rows) <= leaf or radius == 0:
                continue
            reach = radius / base
            left, dist, own = rows, apart, apart
            pick = center
            while True:
                near = own <= reach
                below.append((left[near], own[near], pick))
                tree[number].append(len(tree))
                tree.append([])
                left, dist, own = left[~near], dist[~near], own[~near]
                if not len(left):
                    break
                at = int(dist.argmax())  # the farthest from all points picked so far
                pick = int(left[at])
                own = np.sqrt(squared(points[left], points[pick][None])[:, 0])
                dist = np.minimum(dist, own)
        level = below
    # Depth first, every node is a run of the order.
    lo, hi = np.zeros(len(shape), np.int64), np.zeros(len(shape), np.int64)
    stack, count = [(0, False)], 0
    while stack:
        number, done = stack.pop()
        if done:
            hi[number] = count
            continue
        lo[number] = count
        stack.append((number, True))
        if tree[number]:
            stack.extend((c, False) for c in reversed(tree[number]))
        else:
            order.append(shape[number][2])
            count += len(shape[number][2])
    placed = np.concatenate([np.empty(0, np.int64), *order]).astype(np.int64)
    back = np.empty(len(placed), np.int64)
    back[placed] = np.arange(len(placed))
    center = back[[s[0] for s in shape]] if len(points) else np.zeros(len(shape), np.int64)
    nodes = [np.array([t[0] if t else 0 for t in tree]), np.array([len(t) for t in tree])]
    return CoverTree(points[placed], placed, center, lo, hi, *nodes, np.array([s[1] for s in shape]))


def nearest_entries(tree: CoverTree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of every point, in the tree's order, the nearest entry (of equals the first); each entry's sum and number of points; and how many points were compared one by one."""
    n, d = tree.points.shape
    labels = np.zeros(n, np.int64)
    upto = np.zeros((n + 1, d), np.int64)
    np.cumsum(tree.points, axis=0, out=upto[1:])
    sums, counts = np.zeros((len(entries), d), np.int64), np.zeros(len(entries), np.int64)
    open_, single = np.zeros(1 if n else 0, np.int64), [np.empty(0, np.int64)]
    while len(open_):
        apart = squared(tree.points[tree.center[open_]], entries)
        first = apart.argmin(1)
        rows = np.arange(len(open_))
        nearest = np.sqrt(apart[rows, first].astype(np.float64))
        apart = apart.astype(np.float64)
        apart[rows, first] = np.inf
        second = np.sqrt(apart.min(1)) if len(entries) > 1 else np.full(len(open_), np.inf)
        radius = tree.radius[open_]
        # The margin covers the rounding of roots; at radius 0 the point's own entry is exact.
        whole = (radius == 0) | (nearest + 2 * radius < second * (1 - 1e-9) - 1e-6)
        lo, hi, to = tree.lo[open_[whole]], tree.hi[open_[whole]], first[whole]
        np.add.at(sums, to, upto[hi] - upto[lo])
        np.add.at(counts, to, hi - lo)
        for a, b, c in zip(lo.tolist(), hi.tolist(), to.tolist()):
            labels[a:b] = c
        rest = open_[~whole]
        inner = tree.children[rest] > 0
        single.extend(np.arange(a, b) for a, b in zip(tree.lo[rest[~inner]].tolist(), tree.hi[rest[~inner]].tolist()))
        begin, size = tree.child[rest[inner]], tree.children[rest[inner]]
        open_ = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(begin) else np.empty(0, np.int64)
    left = np.concatenate(single)
    for i in range(0, len(left), 4096):
        some = left[i : i + 4096]
        labels[some] = squared(tree.points[some], entries).argmin(1)
    np.add.at(sums, labels[left], tree.points[left])
    np.add.at(counts, labels[left], 1)
    return labels, sums, counts, len(left)


def _blocks(rows: DataFrame, parts: int, block: int, label_type: str) -> DataFrame:
    """One row per block: its ids and labels, and for each part the tree as bytes."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block_of(table: pa.Table) -> pa.RecordBatch:
            table = table.combine_chunks()
            flat = np.asarray(table.column("v").chunk(0).flatten())
            whole = flat.reshape(table.num_rows, -1)
            width = whole.shape[1] // parts
            trees = [cover_tree(whole[:, p * width : (p + 1) * width]).to_bytes() for p in range(parts)]
            one = lambda name: pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(name).chunk(0))
            return pa.RecordBatch.from_arrays([one("id"), one("label"), pa.array([trees], pa.list_(pa.binary()))], names=["ids", "labels", "trees"])

        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(block - n, batch.num_rows)
                held.append(batch.slice(0, take))
                n, batch = n + take, batch.slice(take)
                if n == block:
                    yield block_of(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield block_of(pa.Table.from_batches(held))

    return rows.select("id", "label", "v").mapInArrow(of, f"ids array<long>, labels array<{label_type}>, trees array<binary>")


def _sums(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``(part, entry, n, sums)`` of the points nearest to every entry of every part."""
    kind = "part int, entry int, n long, sums array<long>"

    def rows(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part, entry = np.nonzero(counts)
        flat = pa.array(sums[part, entry].reshape(-1))
        ends = pa.array(np.arange(len(part) + 1, dtype=np.int32) * sums.shape[2])
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.ListArray.from_arrays(ends, flat)], names=["part", "entry", "n", "sums"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            for trees in batch.column(0):
                for p, data in enumerate(trees.as_py()):
                    _, s, c, _ = nearest_entries(CoverTree.from_bytes(data), codebooks[p])
                    sums[p] += s
                    counts[p] += c
        yield rows(sums, counts)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            part, entry = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            np.add.at(counts, (part, entry), np.asarray(batch.column(2)))
            np.add.at(sums, (part, entry), np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1))
        yield rows(sums, counts)

    return blocks.select("trees").mapInArrow(local, kind).repartition("part", "entry").mapInArrow(merged, kind)


def _coded(blocks: DataFrame, codebooks: np.ndarray, label_type: str) -> DataFrame:
    """``(vec_id, label, code, error)`` of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                codes, error = np.zeros((len(ids), len(codebooks)), np.uint8), np.zeros(len(ids), np.int64)
                for p, data in enumerate(batch.column(2)[i].as_py()):
                    tree = CoverTree.from_bytes(data)
                    nearest, *_ = nearest_entries(tree, codebooks[p])
                    codes[tree.order, p] = nearest
                    error[tree.order] += ((tree.points - codebooks[p][nearest]) ** 2).sum(1)
                digits = codes.tobytes().hex()
                width = 2 * len(codebooks)
                texts = [digits[k : k + width] for k in range(0, len(digits), width)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(texts, pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(of, f"vec_id long, label {label_type}, code string, error long")


def compress_vectors(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4, block: int = 2048,
) -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, label, code, error, label_error, codebooks_sha256)`` of every usable vector, and the codebooks (part, entry, position).

    Components become floor(scale * x); a vector is cut into ``parts`` equal parts. A codebook starts as that part of the rows of the ``entries`` (at most 256) smallest
    ids; each round assigns every part to its nearest entry (of equals the lower) and moves each entry to the floor of its parts' mean, unused entries stay. ``code`` has
    two hex digits a part, ``error`` is the sum of squared distances, ``label_error`` its sum over equal labels (nulls are equal).

    Left out are null vectors, vectors with null or non-finite components, and those of another length than the row of the smallest id or of a length that ``parts``
    doesn't divide. A row without an id is coded and counts in all sums, but starts no codebook entry unless no row has an id. Rows of one id are rows of their own (ordered by vector);
    fewer rows than ``entries`` make smaller codebooks; an empty table gives no rows and empty codebooks. Other columns are ignored. Components of 2 ** 28 and
    more after scaling are an error. Sent to the driver: the first rows and one codebook's sums a round, of sizes fixed by the parameters.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    spark = vectors.sparkSession
    label = F.col(label_col) if label_col in vectors.columns else F.lit(None).cast("int")
    x = F.col("x")
    picked = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = picked.where(x.isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0) & finite)
    label_type = usable.schema["label"].dataType.simpleString()
    small = F.forall("x", lambda c: F.abs(c * scale) < LARGEST)
    whole = F.when(small, F.transform("x", lambda c: F.floor(c * scale).cast("long"))).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("array<long>"))
    rows = usable.select("id", "label", whole.alias("v"))
    first = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(1).collect()
    width = len(first[0]["v"]) if first else parts
    rows = rows.where(F.size("v") == width)
    ids = rows.where("id is not null") if first and first[0]["id"] is not None else rows
    start = [r["v"] for r in ids.select("id", "v").orderBy("id", "v").limit(entries).collect()]
    books = np.array(start, np.int64).reshape(len(start), parts, width // parts).transpose(1, 0, 2).copy()
    if start:
        # Few input files would make few trees at a time.
        few = spark.sparkContext.defaultParallelism
        blocks = written(_blocks(rows.repartition(few) if rows.rdd.getNumPartitions() < few else rows, parts, block, label_type), "cover-trees")
        for _ in range(rounds):
            for r in _sums(blocks, books).collect():
                books[r["part"], r["entry"]] = np.array(r["sums"], np.int64) // r["n"]
        coded = written(_coded(blocks, books, label_type), "vector-codes")
    else:
        coded = spark.createDataFrame([], f"vec_id long, label {label_type}, code string, error long")
    per_label = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    per_label = written(per_label, "label-errors") if start else per_label
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = coded.join(per_label, F.col("label").eqNullSafe(F.col("own"))).drop("own")
    return out.withColumn("codebooks_sha256", F.lit(digest)), books
