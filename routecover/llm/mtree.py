"""Exact top-k inner products by best-first search in M-trees, one tree for each shard of the rows.

In a shard of largest norm m, a vector x becomes the point (x, sqrt(m^2 - |x|^2)) and a query q the point (q, 0). Then
d(q, x)^2 = |q|^2 + m^2 - 2 q.x, so the nearest points are those of the largest products. All
components are integers, so products are exact, and a small margin covers the rounding of distances.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARGIN = 1e-6
PAGE_SCHEMA = "shard int, kind int, page int, leaf boolean, ids array<long>, copies array<int>, radii array<double>, from_parent array<double>, vectors binary"


class Page:
    """A node: its entries' vectors, and for each its distance to this node's routing point and its covering radius.

    In a leaf the entries are rows (radius 0, ``ids`` are row ids); above, routing points of child pages (``ids`` are pages).
    """

    __slots__ = ("leaf", "ids", "copies", "radii", "from_parent", "vectors")

    def __init__(self, leaf, ids, copies, radii, from_parent, vectors):
        self.leaf, self.ids, self.copies, self.radii, self.from_parent, self.vectors = leaf, ids, copies, radii, from_parent, vectors


def build_pages(vectors: np.ndarray, ids: np.ndarray, copies: np.ndarray, leaf_size: int, fanout: int) -> list[Page]:
    """Bulk-load a tree over integer-valued rows; page 0 is the root."""
    squares = (vectors**2).sum(1)
    lift = np.sqrt(squares.max() - squares) if len(vectors) else squares
    pages: list[Page] = []
    random = np.random.default_rng(len(vectors))

    def distances(rows: np.ndarray, router: int) -> np.ndarray:
        flat = squares[rows] + squares[router] - 2 * (vectors[rows] @ vectors[router])
        return np.sqrt(np.maximum(flat, 0) + (lift[rows] - lift[router]) ** 2)

    def load(rows: np.ndarray, router: int | None) -> int:
        at = len(pages)
        pages.append(None)
        near = np.zeros(len(rows)) if router is None else distances(rows, router)
        if len(rows) <= leaf_size:
            pages[at] = Page(True, ids[rows], copies[rows], np.zeros(len(rows)), near, vectors[rows])
            return at
        seeds = random.choice(rows, min(fanout, len(rows)), replace=False)
        to_seed = np.stack([distances(rows, s) for s in seeds], 1)
        nearest = to_seed.argmin(1)
        groups = [(int(s), rows[nearest == j]) for j, s in enumerate(seeds) if (nearest == j).any()]
        if len(groups) == 1:  # equal points: any cut will do
            groups = [(int(part[0]), part) for part in np.array_split(rows, min(fanout, -(-len(rows) // leaf_size)))]
        children = [load(part, s) for s, part in groups]
        routers = np.array([s for s, _ in groups])
        radii = np.array([distances(part, s).max() for s, part in groups])
        from_parent = np.zeros(len(routers)) if router is None else distances(routers, router)
        pages[at] = Page(False, np.array(children), np.zeros(len(children), np.int32), radii, from_parent, vectors[routers])
        return at

    load(np.arange(len(vectors)), None)
    return pages


def search(pages: list[Page], top: float, query: np.ndarray, k: int, own: tuple[int, int]) -> list[tuple[int, int, int]]:
    """The k best ``(score, id, copy)`` but for the row ``own``; ``top`` is the shard's largest squared norm.

    Pages are taken nearest lower bound first. An entry's distance is computed only if the difference of two stored or known
    distances, |d(q, router) - d(entry, router)| - radius, is not beyond the k-th best; equal bounds are kept, for ties.
    """
    base = float(query @ query) + top
    best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -copy): the worst first
    bound = np.inf
    queue = [(0.0, 0, 0.0)]
    while queue:
        lower, at, to_router = heapq.heappop(queue)
        if lower > bound + MARGIN:
            break
        page = pages[at]
        open_ = np.arange(len(page.ids)) if at == 0 else np.flatnonzero(np.abs(to_router - page.from_parent) - page.radii <= bound + MARGIN)
        if not len(open_):
            continue
        scores = page.vectors[open_] @ query
        far = np.sqrt(np.maximum(base - 2 * scores, 0))
        if page.leaf:
            for j in np.flatnonzero(far <= bound + MARGIN).tolist():
                row, copy = int(page.ids[open_[j]]), int(page.copies[open_[j]])
                if (row, copy) == own:
                    continue
                entry = (int(scores[j]), -row, -copy)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
            if len(best) == k:
                bound = np.sqrt(max(base - 2 * best[0][0], 0))
        else:
            bounds = np.maximum(far - page.radii[open_], 0)
            for j in np.flatnonzero(bounds <= bound + MARGIN).tolist():
                heapq.heappush(queue, (float(bounds[j]), int(page.ids[open_[j]]), float(far[j])))
    return [(s, -i, -c) for s, i, c in best]


def whole_numbers(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of every component as double; null where the vector or a component is null or not finite."""
    fine = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(vectors.isNotNull() & F.coalesce(fine, F.lit(False)), F.transform(vectors, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def top_k(
    rows: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    k: int = 10,
    shard_rows: int = 8192,
    leaf_size: int = 64,
    fanout: int = 16,
) -> DataFrame:
    """Each query row's k rows of the largest integer product: ``query_id, rank, vec_id, score``; ties to the smaller id.

    Queries are the rows where ``is_query`` holds; candidates are all rows but the query's own row. Rows whose
    id is null, or whose vector is null or has null or non-finite components, take no part. Vectors of
    unequal length are filled up with zeros; products must stay under 2**53. Repeated rows are rows of
    their own (equal ids tie by vector order). An empty table gives no rows; other columns are ignored.

    Rows are dealt to shards by hash, however they cluster, and each shard's tree is built in one task of
    about ``shard_rows`` rows. Every query goes to every shard as the query set is stated; a task holds one tree and
    streams the queries past it. k rows per query and shard are ranked at the end.
    """
    picked = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col), scale).alias("v"), is_query.alias("asks"))
    picked = picked.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    counted = picked.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    n_shards, dims = max(1, -(-counted["n"] // shard_rows)), max(1, counted["dims"] or 1)
    numbered = picked.withColumn("copy", F.row_number().over(Window.partitionBy("vec_id").orderBy("v")) - 1)
    dealt = numbered.withColumn("shard", F.pmod(F.xxhash64("vec_id", "copy"), F.lit(n_shards)).cast("int"))

    def padded(arrays: list) -> np.ndarray:
        out = np.zeros((len(arrays), dims))
        for i, a in enumerate(arrays):
            out[i, : len(a)] = a
        return out

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["vec_id", "copy"])
        pages = build_pages(padded(part["v"].tolist()), part["vec_id"].to_numpy(), part["copy"].to_numpy(), leaf_size, fanout)
        shard = int(part["shard"].iloc[0])
        out = [(shard, 0, i, p.leaf, p.ids, p.copies, p.radii, p.from_parent, p.vectors.tobytes()) for i, p in enumerate(pages)]
        return pd.DataFrame(out, columns=["shard", "kind", "page", "leaf", "ids", "copies", "radii", "from_parent", "vectors"])

    pages = dealt.select("shard", "vec_id", "copy", "v").groupBy("shard").applyInPandas(build, PAGE_SCHEMA)
    none = lambda kind: F.lit(None).cast(kind)
    asked = dealt.where("asks").select(
        F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"),
        F.lit(1).alias("kind"), F.lit(0).alias("page"), none("boolean").alias("leaf"), F.array("vec_id").alias("ids"),
        F.array("copy").alias("copies"), F.col("v").alias("radii"), none("array<double>").alias("from_parent"), none("binary").alias("vectors"),
    )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, top = None, [], 0.0
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, tree, top = r["shard"], [], 0.0
                if r["kind"] == 0:
                    vectors = np.frombuffer(r["vectors"]).reshape(-1, dims)
                    tree.append(Page(r["leaf"], np.array(r["ids"]), np.array(r["copies"]), np.array(r["radii"]), np.array(r["from_parent"]), vectors))
                    if r["leaf"]:
                        top = max(top, float((vectors**2).sum(1).max()))
                elif tree:
                    own = (r["ids"][0], r["copies"][0])
                    out += [(*own, s, i, c) for s, i, c in search(tree, top, padded([r["radii"]])[0], k, own)]
            columns = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], names=["query_id", "query_copy", "score", "vec_id", "copy"])

    KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]
    met = pages.unionByName(asked).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind", "page")
    found = met.mapInArrow(answer, "query_id long, query_copy int, score long, vec_id long, copy int")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "query_copy").orderBy(F.desc("score"), "vec_id", "copy")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
