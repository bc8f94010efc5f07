"""Vector codes against plain rounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from routecover.llm.cover_lloyd import CoverTree, compress_vectors, cover_tree, nearest_entries, squared

SCHEMA = "vec_id long, embedding array<float>, label int, code string, id int, x string"


def plain(rows, parts, entries, rounds, scale=1024):
    kept = [(r[0], tuple(math.floor(float(x) * scale) for x in r[1]), r[2]) for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == width]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in kept if r[0] is not None][:entries] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (apart(v, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [(nearest(cut(r[1], p), books[p]), cut(r[1], p)) for r in kept]
            for e in range(len(books[p])):
                mine = [v for k, v in own if k == e]
                if mine:
                    books[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine))
    out, labels = [], {}
    for i, v, label in kept:
        codes = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(apart(cut(v, p), books[p][c]) for p, c in enumerate(codes))
        out.append((i, label, "".join(f"{c:02x}" for c in codes), error))
        labels[label] = labels.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, code, error, labels[label], digest) for i, label, code, error in out), key=repr)


def awkward(n: int) -> list[tuple]:
    r = np.random.default_rng(3)
    vectors = np.concatenate([r.normal(0, 0.3, (n, 8)), np.repeat(r.normal(0, 0.3, (3, 8)), n // 6, 0), np.zeros((n // 8, 8))]).astype(np.float32)
    rows = [(i, [float(x) for x in v], [None, 1, 2][i % 3], "z", 4, "y") for i, v in enumerate(vectors)]
    nan, more = float("nan"), [0.25] * 8
    odd = [(900, None), (901, [0.5] * 7 + [None]), (902, [nan] + [0.5] * 7), (903, [float("inf")] * 8), (904, []), (905, [1.0] * 4), (906, [1.0] * 3), (None, more), (2, more)]
    return [*rows, rows[5], *((i, v, 1, None, None, None) for i, v in odd)]


@pytest.mark.parametrize("entries,block", [(5, 16), (256, 2048)])
def test_codes_are_those_of_plain_rounds(spark, entries, block):
    rows = awkward(60)
    found, books = compress_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries, rounds=3, parts=2, block=block)
    got = sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in found.collect()), key=repr)
    assert got == plain(rows, 2, entries, 3)
    assert books.shape[0] == 2


def test_no_vectors_and_no_labels(spark):
    empty, books = compress_vectors(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and books.size == 0
    one = spark.createDataFrame([(7, [0.5, -0.0001, 0.1, 0.2])], "vec_id long, embedding array<double>")
    (row,) = compress_vectors(one)[0].collect()
    assert (row["vec_id"], row["code"], row["error"], row["label_error"]) == (7, "00000000", 0, 0)


def test_components_beyond_exact_distances_are_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        compress_vectors(spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0], 1)], "vec_id long, embedding array<double>, label int"))


@pytest.mark.parametrize("seed,size,scale", [(0, 700, 40), (1, 700, 3), (2, 200, 1 << 25), (3, 1, 5)])
def test_trees_cover_and_assign_exactly(seed, size, scale):
    r = np.random.default_rng(seed)
    middles = r.integers(-20 * scale, 20 * scale + 1, (8, 6))
    points = middles[r.integers(0, 8, size)] + r.integers(-scale, scale + 1, (size, 6))
    tree = CoverTree.from_bytes(cover_tree(points).to_bytes())
    assert np.array_equal(tree.points, points[tree.order]) and sorted(tree.order.tolist()) == list(range(size))
    for k in range(len(tree.center)):
        inside = tree.points[tree.lo[k] : tree.hi[k]]
        assert np.sqrt(squared(inside, tree.points[tree.center[k]][None])).max() <= tree.radius[k] + 1e-6
    entries = np.concatenate([middles, middles[:2], points[:3]])
    labels, sums, counts, compared = nearest_entries(tree, entries)
    assert np.array_equal(labels, squared(tree.points, entries).argmin(1))
    assert np.array_equal(counts, np.bincount(labels, minlength=len(entries)))
    assert np.array_equal(sums, np.stack([tree.points[labels == e].sum(0) for e in range(len(entries))]))
    assert seed != 0 or compared < size


def test_groups_of_equal_points_are_assigned_whole():
    labels, _, counts, compared = nearest_entries(cover_tree(np.full((5000, 4), 7)), np.array([[9, 9, 9, 9], [7, 7, 7, 8], [7, 7, 7, 8]]))
    assert set(labels.tolist()) == {1} and counts.tolist() == [0, 5000, 0] and compared == 0
