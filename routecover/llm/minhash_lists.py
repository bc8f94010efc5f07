"""MinHash near-duplicates by inverted lists of signature coordinates.

A signature has one least value for each of its coordinates; two sets agree in a coordinate with the probability of their Jaccard similarity. Sets are posted
under (coordinate, value) pairs. Two sets that agree in at least ``match`` of m coordinates share one of the first m - match + 1 of each one's pairs in
any common order, so only that prefix is posted; the order is rarest first, and pairs that one set alone has take places but make no lists.
In a list collisions are counted, skipping sets that can't reach ``match`` any more. Sets linked in that way form clusters, in which
links are confirmed on the full sets. No pairs are written: a list or cluster yields at most one link for each of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routecover.llm.groups import by_group, dealt, linked, similar, with_heads
from routecover.llm.simhash_tiles import SLICE, _hashes, _shingle_places, shingle_set
from routecover.llm.texts import byte_texts, give_back
from routecover.operators.components import connected_components
from routecover.runtime import written


def orders(coordinates: int) -> np.ndarray:
    """A random order of hashes for every coordinate: exclusive-or, then an odd factor."""
    return np.random.default_rng(13).integers(0, 1 << 63, (2, coordinates, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value under every order."""
    least = np.full(order.shape[1], ~np.uint64(0))
    step = max(1, SLICE // order.shape[1])
    for i in range(0, len(hashes), step):
        least = np.minimum(least, ((hashes[None, i : i + step] ^ order[0]) * order[1]).min(1))
    return (least >> np.uint64(32)).astype(np.uint32)


def collide(signatures: np.ndarray, row: int, others: np.ndarray, match: int) -> np.ndarray:
    """Those of ``others`` that agree with ``row`` in ``match`` coordinates or more; a quarter at a time, skipping those that can't reach it."""
    own, m = signatures[row], signatures.shape[1]
    found = np.zeros(len(others), np.int64)
    for i in range(0, m, -(-m // 4)):
        j = min(m, i + -(-m // 4))
        found = found + (signatures[others, i:j] == own[i:j]).sum(1)
        able = found + (m - j) >= match
        others, found = others[able], found[able]
    return others


def _matrix(group: pa.Table, name: str, kind) -> np.ndarray:
    return np.stack([np.frombuffer(x, kind) for x in group.column(name).to_pylist()])


def list_links(nodes: DataFrame, match: int, block: int) -> DataFrame:
    """``(u, v)``: ids of ``nodes(id, sig, values)`` that agree in ``match`` coordinates or more, as many as connect what all of these connect."""
    posted = nodes.select("id", F.posexplode("values").alias("j", "x"))
    posted = posted.select("id", (F.shiftleft(F.col("j").cast("long"), 32) + F.col("x") + (1 << 31)).alias("lane"))
    counts = posted.groupBy("lane").agg(F.count("*").alias("c")).where("c > 1")
    own = posted.join(counts, "lane").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "lane"))).alias("p"))
    # Pairs of this set alone would come first: of its s other pairs, s - match + 1 are left of the prefix.
    prefix = own.where(F.size("p") >= match).select("id", F.explode(F.expr(f"slice(p, 1, size(p) - {match} + 1)")).alias("p")).select("id", "p.lane")
    prefix = written(prefix, "prefixes")
    lists = written(prefix.join(nodes.select("id", "sig"), "id").withColumn("weight", F.lit(1)), "lists")

    def agree(values: list, heads: list) -> np.ndarray:
        return np.array([(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)).sum() >= match for a, b in zip(values, heads)], bool)

    def links(group: pa.Table) -> Iterator[pa.RecordBatch]:
        signatures = _matrix(group, "sig", np.uint16)
        yield linked(group, lambda row, others: collide(signatures, row, others, match))

    marked, found = with_heads(lists, "sig", agree, block)
    within = by_group(dealt(marked, block), links, "u long, v long")
    return found.unionByName(within).distinct()


def confirmed_links(clusters: DataFrame, least: int, match: int, block: int) -> DataFrame:
    """``(u, v)``: ids of ``clusters(lane, id, weight, sig, shingles)`` whose full sets are similar, as many as connect what all of these connect."""

    def agree(values: list, heads: list) -> np.ndarray:
        return np.array([similar(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), least) for a, b in zip(values, heads)], bool)

    def links(group: pa.Table) -> Iterator[pa.RecordBatch]:
        signatures = _matrix(group, "sig", np.uint16)
        sets = [np.frombuffer(x, np.int64) for x in group.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets])

        def near(row: int, others: np.ndarray) -> np.ndarray:
            fit = 100 * np.minimum(sizes[others], sizes[row]) >= least * np.maximum(sizes[others], sizes[row])
            others = collide(signatures, row, others[fit], match)
            return others[[similar(sets[row], sets[x], least) for x in others.tolist()]] if len(others) else others

        yield linked(group, near)

    marked, found = with_heads(clusters, "shingles", agree, block)
    return found.unionByName(by_group(dealt(marked, block), links, "u long, v long"))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, least: int = 80, coordinates: int = 64, match: int = 32, list_block: int = 16_384, set_block: int = 2_000_000, max_broadcast: int = 200_000,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``: one row per row of ``docs``, with the smallest id reachable over links.

    A text's set is its distinct shingles of ``shingle`` words (A-Z lowered; fewer words: all of them as one), as 64-bit hashes. Texts link if 100 times the intersection of
    their sets is at least ``least`` times the union. Lists of over ``list_block`` sets, and clusters of over ``set_block`` shingles, are cut. Links are sought among sets that agree in ``match`` of ``coordinates`` coordinates and confirmed on the full sets: at a similarity of 0.8
    fewer than 32 of 64 agree for one pair in 50 million.

    Texts without words, null ones too, link with nothing and are their own component. Equal sets are one node, whatever their number. A row without an id is linked like any other and gets
    its component's smallest id (null if no row there has one), and is not kept. Repeated rows keep their rows. An empty table gives no rows; texts may have any length; other columns are ignored.
    """
    order = orders(coordinates)
    kinds = "doc_id long, text_hash long, id long, n_shingles long, sig binary, values array<int>"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, sigs, values = [], [], [], []
            for text in byte_texts(batch):
                hashes = np.unique(_hashes(*_shingle_places(text, shingle), 42))
                least_values = signature(hashes, order)
                names.append(xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63))
                sizes.append(len(hashes))
                sigs.append(least_values.astype(np.uint16).tobytes())
                values.append((least_values ^ np.uint32(1 << 31)).view(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * coordinates), pa.array(np.concatenate([np.empty(0, np.int32), *values])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), lists], names=["doc_id", "text_hash", "id", "n_shingles", "sig", "values"])
            give_back()

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).astype(np.int64) for t in byte_texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.sort(s).tobytes() for s in sets], pa.binary())], names=["id", "shingles"])
            give_back()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    prints = written(texts.mapInArrow(of, kinds), "signatures")
    nodes = prints.where("n_shingles > 0").groupBy("id").agg(F.min("text_hash").alias("text_hash"), F.first("sig").alias("sig"), F.first("values").alias("values"), F.first("n_shingles").alias("weight"))
    nodes = written(nodes, "signature-nodes")
    candidates = connected_components(written(list_links(nodes, match, list_block), "list-links"))
    clusters = written(candidates.select(F.col("component").alias("lane"), F.col("node").alias("id")).join(nodes.select("id", "weight", "text_hash", "sig"), "id"), "clusters")
    # Each set once: the text of the least hash stands for all texts with it.
    wanted = clusters.select("id", "text_hash")
    wanted = F.broadcast(wanted) if clusters.count() <= max_broadcast else wanted
    sets = texts.select("text_hash", "text").join(wanted, "text_hash").dropDuplicates(["id"]).select("id", "text").mapInArrow(sets_of, "id long, shingles binary")
    full = written(clusters.select("lane", "id", "weight", "sig").join(written(sets, "full-sets"), "id"), "cluster-sets")
    groups = connected_components(written(confirmed_links(full, least, match, set_block), "confirmed-links")).select(F.col("node").alias("id"), "component")
    rows = prints.select("doc_id", "n_shingles", "id").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = F.col("n_shingles") == 0
    first = rows.where(~own).groupBy("component").agg(F.min("doc_id").alias("first"))
    out = rows.join(first, "component", "left").withColumn("component_id", F.when(own, F.col("doc_id")).otherwise(F.col("first")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
