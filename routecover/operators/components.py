"""Connected components: links contracted within tasks, the rest by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType, StructField, StructType

from routecover.runtime import Rounds, chunks, codes, in_areas, large_areas, split_areas

#: Links are contracted in tasks so many times before the rest goes by steps over all of them.
CONTRACTIONS = 3


def least_linked(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """The least node that each of ``n`` nodes is linked with over ``u[i] - v[i]``: roots hook to smaller ones, and trees are flattened."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        apart = a != b
        if not apart.any():
            return parent
        np.minimum.at(parent, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _roots(rows: pa.Table, k: list[str]) -> pa.Table:
    """``(*k, node, root)``: every node of the links with the least one it is linked with by them."""
    n = rows.num_rows
    where = pa.concat_arrays([x for c in ("u", "v") for x in rows.column(c).chunks]).to_numpy(zero_copy_only=False)
    at, first = codes([np.tile(codes([rows.column(c)])[0], 2) for c in k] + [where])
    root = least_linked(at[:n], at[n:], len(first))
    keys = [rows.column(c).take(pa.array(first % n)).combine_chunks() for c in k]
    return pa.table([*keys, pa.array(where[first]), pa.array(where[first[root]])], names=[*k, "node", "root"])


def _rooted(links: DataFrame, k: list[str]) -> StructType:
    node = links.schema["u"].dataType
    return StructType([*(StructField(c, links.schema[c].dataType) for c in k), StructField("node", node), StructField("root", node)])


def _contracted(links: DataFrame, k: list[str]) -> DataFrame:
    """``(*k, node, root)``: of each chunk of links, every node with the least one it is linked with there."""

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for rows in chunks(batches):
            yield from _roots(rows, k).to_batches(max_chunksize=100_000)

    # A partition comes in no order and may be many chunks: unsorted, each of them would hold some links of every area.
    return links.repartitionByRange(*k, "u").sortWithinPartitions(*k, "u").mapInArrow(contract, _rooted(links, k))


def _stars(links: DataFrame, k: list[str], max_rounds: int) -> DataFrame:
    """``(*k, node, component)`` of links ``(*k, u, v)`` without loops. Each round is two joins on the node; a hub's rows are split by the adaptive skew join."""
    now = links.select(*k, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    # As many files a round as the cluster has cores: the edges left are few beside the rows they stand for.
    width = links.sparkSession.sparkContext.defaultParallelism
    rounds = Rounds()
    now = rounds.settle("links", now.coalesce(width))
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(*k, F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(*k, "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (
            both.join(least, [*k, "u"])
            .where(F.col("v") > F.col("u"))
            .select(*k, F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy(*k, "u").agg(F.min("v").alias("m"))
        small = large.join(least, [*k, "u"]).select(
            *k, F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        )
        now = rounds.settle("links", small.select(*k, "e.u", "e.v").where(F.col("u") != F.col("v")).distinct().coalesce(width))
        state = now.agg(F.count("*"), F.sum(F.xxhash64(*k, "u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = now.select(*k, F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(named.select(*k, F.col("component").alias("node"), "component")).distinct()


def connected_components(edges: DataFrame, keys: tuple[str, ...] = (), max_rounds: int = 60, contractions: int = CONTRACTIONS) -> DataFrame:
    """``(*keys, node, component)`` for every end of an edge ``(*keys, u, v)``; a component's name is its least node.

    Edges join only within equal ``keys``. Self-loops and rows with a null end make no link (a loop's
    node is still returned). With ``keys=("area_id",)`` areas of up to ``AREA_ROWS`` links are done whole in tasks. Other links are range-partitioned and sorted by keys and node and contracted in chunks of bounded size; only the roots of nodes that lie in several
    chunks are linked on, so an area within one chunk is done at once, and what a large one leaves grows with its chunks' borders.
    """
    k = list(keys)
    links = edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(*k, "u", "v")
    # Nodes and keys other than whole numbers, and keys that may be null, are left to the joins.
    plain = all(isinstance(links.schema[c].dataType, (IntegralType, LongType)) for c in [*k, "u", "v"]) and links.schema["u"].dataType == links.schema["v"].dataType
    if plain and k == ["area_id"] and contractions:
        total, large = large_areas(links)
        if large is None:
            return in_areas(links, total, partial(_roots, k=k), _rooted(links, k)).withColumnRenamed("root", "component")
        ((small, links),) = split_areas(large, links)
        done = in_areas(small, total, partial(_roots, k=k), _rooted(links, k)).withColumnRenamed("root", "component")
        return done.unionByName(_over_all(links, k, plain, max_rounds, contractions))
    return _over_all(links, k, plain, max_rounds, contractions)


def _over_all(links: DataFrame, k: list[str], plain: bool, max_rounds: int, contractions: int) -> DataFrame:
    levels: list[DataFrame] = []
    rounds = Rounds()
    for level in range(contractions if plain else 0):
        links = links.dropna(subset=k) if k and not level else links
        found = rounds.settle("roots", _contracted(links, k))
        least = found.groupBy(*k, "node").agg(F.min("root").alias("root"), F.max("root").alias("last"))
        levels.append(rounds.settle(f"least-{level}", least))
        split = levels[-1].where("root != last").select(*k, "node", F.col("root").alias("v"))
        links = rounds.settle(f"split-{level}", found.join(split, [*k, "node"]).where("root != v").select(*k, F.col("root").alias("u"), "v").distinct())
        rounds.drop(links.sparkSession, "roots")
        if links.isEmpty():
            named = None
            break
    else:
        alone = links.where(F.col("u") == F.col("v")).select(*k, F.col("u").alias("node")).distinct()
        named = _stars(links.where(F.col("u") != F.col("v")), k, max_rounds)
        lone = alone.join(named, [*k, "node"], "left_anti")
        named = named.unionByName(lone.select(*k, "node", F.col("node").alias("component")))
    for found in reversed(levels):
        own = found.select(*k, "node", "root")
        if named is None:
            named = own.withColumnRenamed("root", "component")
        else:
            above = named.withColumnRenamed("node", "root")
            named = own.join(above, [*k, "root"], "left").select(*k, "node", F.coalesce("component", "root").alias("component"))
    return named
