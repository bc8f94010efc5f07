"""The pipeline's near-copy stage against exact similarity of five-word shingles."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from routecover.llm import simhash_tiles


def shingles(text: str) -> frozenset:
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def plain_near_copies(rows: list) -> set:
    """The (doc_id, text) kept: the least doc_id of each group linked at a similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 10 >= len(sets[i] | sets[j]) * 8 and label[i] != label[j]:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return {min(r for r, k in zip(rows, label) if k == x) for x in set(label)}


def changed(r: random.Random, words: list, n: int) -> str:
    out = list(words)
    for k in r.sample(range(len(words) // 6), n):
        out[6 * k + 2] = "new" + str(r.random())
    return " ".join(out)


@pytest.fixture(scope="module")
def pairs() -> list:
    r = random.Random(11)
    rows = []
    for size in (120, 240):
        for n in range(0, size // 20 + 1):  # similarities from 1.0 down to 0.5 and less
            for _ in range(4):
                words = [str(r.random()) for _ in range(size)]
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, changed(r, words, n))]
    base = [str(r.random()) for _ in range(120)]
    return rows + [(len(rows) + k, changed(r, base, 1)) for k in range(30)]  # one large group


def test_near_copies_are_those_at_exact_similarity(spark, pairs):
    near = lambda a, b: len(a & b) / len(a | b)
    planted = [near(shingles(a[1]), shingles(b[1])) for a, b in zip(pairs[:-30:2], pairs[1:-30:2])]
    assert min(planted) < 0.6 and sum(0.8 <= x < 0.9 for x in planted) >= 8 and sum(0.6 < x < 0.8 for x in planted) >= 8
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in pairs], "doc_id long, text string, n_chars long").repartition(3)
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((x.doc_id, x.text) for x in kept.collect()) == sorted(plain_near_copies(pairs))


def test_texts_with_one_id_are_told_apart(spark, pairs):
    rows = [(1, pairs[0][1]), (1, pairs[20][1]), (2, pairs[20][1]), (3, "few words"), (3, "few words"), (4, "Few  words"), (5, "other")]
    kept = corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept)) == sorted({(1, pairs[0][1]), (1, pairs[20][1]), (3, "few words"), (5, "other")})
    assert corpus_pipeline.near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_near_pairs_are_all_pairs():
    g = np.random.default_rng(3)
    prints, sides, sizes = g.integers(0, 1 << 8, (300, 2), dtype=np.uint64), g.random(300) < 0.3, g.integers(50, 100, 300)
    far = lambda x, y: int(np.bitwise_count(prints[x] ^ prints[y]).sum())
    for alone in (True, False):
        got = sorted((min(i, j), max(i, j), d) for part in simhash_tiles.near_pairs(prints, sides, sizes, 3, 0.8, alone) for i, j, d in zip(*(x.tolist() for x in part)))
        want = [(x, y, far(x, y)) for x in range(300) for y in range(x + 1, 300) if far(x, y) <= 3 and (alone or sides[x] != sides[y]) and min(sizes[x], sizes[y]) * 10 >= max(sizes[x], sizes[y]) * 8]
        assert got == want


def test_lanes_of_any_block_size(spark, pairs):
    docs = spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)
    found = [{(x.doc_id, x.component_id) for x in simhash_tiles.near_copy_groups(docs, block=n).collect()} for n in (4, 1024)]
    assert found[0] == found[1] and len({c for _, c in found[0]}) == len(plain_near_copies(pairs))


def test_columns_of_any_name_keep_their_values(spark, pairs, tmp_path):
    """Helper names that the table has already, in every stage; and only the contaminated one of two texts with one id goes."""
    names = ["__id", "__hash", "__removed", "__lines", "__language", "__score", "__labels"]
    rows = [(5, pairs[0][1] + " tail", *names), (5, pairs[20][1], *names), (6, pairs[40][1], *names), (None, pairs[0][1], *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    spark.createDataFrame([(1, pairs[0][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for stage, left in ((corpus_pipeline.near_copies, [rows[2], rows[1], rows[3]]), (corpus_pipeline.benchmark_passages, rows[1:])):
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns and all(tuple(x)[2:] == tuple(names) for x in got.collect())
        if stage is corpus_pipeline.benchmark_passages:
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(left, key=repr)
    kept = corpus_pipeline.lines(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and all(tuple(x)[2:] == tuple(names) for x in kept.collect())


def test_rows_written_do_not_grow_with_pairs(spark):
    """Families of texts that are near but not near enough: as many links are proposed as there are rows, at most."""
    from routecover.llm.groups import dealt

    for n in (100, 400):
        rows = spark.range(n).selectExpr("1L as lane", "id", "1 as weight", "false as head")
        assert dealt(rows, 16_384).count() == n
        mutual = spark.range(n).selectExpr("1L as lane", "id", "1 as weight", "id > 2 as head")
        assert dealt(mutual, 50).count() == n + 3 * (n // 50)
        assert dealt(spark.range(n).selectExpr("1L as lane", "id", "1 as weight", "true as head"), 50).count() == 0
