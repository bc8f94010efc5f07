"""Comparing rows within groups of any size: groups are cut into tasks of bounded weight, and yield links that connect, not pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.llm.texts import give_back
from routecover.runtime import written

#: Takes a row number and row numbers; gives those of the latter that link with the row.
Near = Callable[[int, np.ndarray], np.ndarray]
GROUP = ["lane", "a", "b"]


def by_group(rows: DataFrame, each, schema: str) -> DataFrame:
    """``each(table)`` for every group of rows, one after the other; a task holds one group and one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [np.asarray(batch.column(k)) for k in range(len(GROUP))]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            ends = [0, *new.tolist(), batch.num_rows]
            for begin, end in zip(ends, ends[1:]):
                part = batch.slice(begin, end - begin)
                if held and any(held[0].column(k)[0] != part.column(k)[0] for k in range(len(GROUP))):
                    yield from each(pa.Table.from_batches(held).combine_chunks())
                    held = []
                held.append(part)
        if held:
            yield from each(pa.Table.from_batches(held).combine_chunks())
        give_back()

    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, schema)


def spanning_links(near: Near, first: np.ndarray, second: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect: within ``first``, or between ``first`` and ``second``.

    A row that is reached is compared once, with rows not reached yet, so a group of mutual copies costs one pass.
    """
    out: list[tuple[int, int]] = []
    sides = [first, first if second is None else second]
    while len(sides[0]) and len(sides[1]):
        queue = [(int(sides[0][0]), 0)]
        sides[0] = sides[0][1:]
        if second is None:
            sides[1] = sides[0]
        while queue:
            row, side = queue.pop()
            other = 0 if second is None else 1 - side
            reached = near(row, sides[other])
            if len(reached):
                out.extend((row, int(x)) for x in reached)
                queue.extend((int(x), other) for x in reached)
                sides[other] = np.setdiff1d(sides[other], reached, assume_unique=True)
                if second is None:
                    sides[1] = sides[0]
    return out


def dealt(rows: DataFrame, block: int) -> DataFrame:
    """Rows ``(lane, a, b, cut, ...)`` in groups ``(lane, a, b)`` for ``by_group``, from ``(lane, id, weight, head, ...)``: each two rows of a lane that don't both link with its head meet.

    A lane of at most ``block`` in weight is one group of ``a`` -1. A heavier one is cut by hash into n blocks of all its rows and r chunks of
    those without ``head``; a group is a block (``cut`` 0) with a chunk (``cut`` 1): r copies of each row and n of each row without head. A lane of mutual copies has r = 0 and goes no further.
    """
    held = [c for c in rows.columns if c not in ("lane", "head", "weight")]
    sizes = rows.groupBy("lane").agg(F.count("*").alias("c"), F.sum("weight").alias("all"), F.sum(F.when(F.col("head"), 0).otherwise(F.col("weight"))).alias("rest")).where("c > 1")
    sizes = sizes.select("lane", F.ceil(F.col("all") / block).cast("int").alias("n"), F.ceil(F.col("rest") / block).cast("int").alias("r"))
    placed = rows.join(sizes, "lane")
    part = lambda k: F.pmod(F.xxhash64("id"), F.greatest(F.col(k), F.lit(1))).cast("int")
    each = lambda k: F.sequence(F.lit(0), F.greatest(F.col(k) - 1, F.lit(0)))
    one = F.array(F.struct(F.lit(-1).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("cut")))
    asked = F.transform(each("r"), lambda j: F.struct(part("n").alias("a"), j.alias("b"), F.lit(0).alias("cut")))
    chunk = F.transform(each("n"), lambda i: F.struct(i.alias("a"), part("r").alias("b"), F.lit(1).alias("cut")))
    place = F.when(F.col("n") == 1, one).when(F.col("head"), asked).otherwise(F.concat(asked, chunk))
    needed = placed.where((F.col("n") == 1) | (F.col("r") > 0)).withColumn("g", F.explode(place))
    return needed.select("lane", "g.a", "g.b", "g.cut", *held)


def _sides(group: pa.Table) -> tuple[np.ndarray, np.ndarray | None]:
    cut = np.asarray(group.column("cut"))
    rows = np.arange(group.num_rows)
    return (rows, None) if group.column("a")[0].as_py() < 0 else (rows[cut == 1], rows[cut == 0])


def linked(group: pa.Table, near: Near) -> pa.RecordBatch:
    ids = np.asarray(group.column("id"))
    u, v = np.array(spanning_links(near, *_sides(group)), np.int64).reshape(-1, 2).T
    return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])


def with_heads(rows: DataFrame, value: str, of: Callable[[list, list], np.ndarray], block: int) -> tuple[DataFrame, DataFrame]:
    """``rows(lane, id, weight, ...)`` with ``head``: whether the row links with its lane's head, asked only in lanes heavier than ``block``; and the links ``(u, v)`` found.

    The head is the row of the least id. ``of(values, heads)`` compares each row's ``value`` with its head's.
    """
    large = rows.groupBy("lane").agg(F.sum("weight").alias("c"), F.min("id").alias("u")).where(F.col("c") > block).select("lane", "u")
    large = written(large, "heavy-lanes")
    if large.isEmpty():
        return rows.withColumn("head", F.lit(False)), large.select("u", F.col("u").alias("v")).limit(0)
    heads = written(rows.join(large, (rows["lane"] == large["lane"]) & (rows["id"] == large["u"]), "left_semi").select("lane", F.col("id").alias("u"), F.col(value).alias("own")), "heads")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine = of(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fine, pa.bool_())], names=["lane", "u", "v", "head"])

    asked = rows.join(heads, "lane").select("lane", "u", F.col("id").alias("v"), value, "own").mapInArrow(compared, "lane long, u long, v long, head boolean")
    asked = written(asked, "head-links")
    marked = rows.join(asked.where("head").select("lane", F.col("v").alias("id"), F.lit(True).alias("linked")), ["lane", "id"], "left")
    return marked.withColumn("head", F.coalesce("linked", F.lit(False))).drop("linked"), asked.where("head and u != v").select("u", "v")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0


def similar(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """Whether 100 * intersection >= least * union, in whole numbers."""
    n = shared(a, b) if len(a) <= len(b) else shared(b, a)
    return 100 * n >= least * (len(a) + len(b) - n)
