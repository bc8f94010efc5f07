"""Near duplicates from lists of signature coordinates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from routecover.llm.groups import spanning_links
from routecover.llm.minhash_lists import collide, near_duplicates, orders, signature


def sets_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def plain(rows):
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    component = [i if not s else least.get(find(k)) for k, ((i, _), s) in enumerate(zip(rows, sets))]
    return sorted(((i, len(s), c, i is not None and i == c) for (i, _), s, c in zip(rows, sets, component)), key=repr)


def found_in(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


def families(n_families, copies, seed):
    """Texts of 40 to 120 words, and copies with up to a fifth of their shingles changed, chained or not."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 8)))
    out = []
    for _ in range(n_families):
        base = [word() for _ in range(r.randint(40, 120))]
        for _ in range(copies):
            text = list(base)
            for _ in range(r.randint(0, 4)):
                text[r.randrange(len(text))] = word()
            out.append(" ".join(text))
            if r.random() < 0.4:
                base = text
    r.shuffle(out)
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


def test_awkward_documents(docs, rows, no_docs):
    assert found_in(near_duplicates(docs)) == plain([r[:2] for r in rows])
    assert near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("list_block,set_block,broadcast", [(16_384, 2_000_000, 200_000), (4, 300, 0), (1, 1, 0)])
def test_families_at_any_block_size(spark, list_block, set_block, broadcast):
    rows = families(12, 9, 4)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_in(near_duplicates(df, list_block=list_block, set_block=set_block, max_broadcast=broadcast)) == plain(rows)


def test_exactly_the_bound_counts(spark):
    words = [f"w{i}" for i in range(100)]
    # Four-word shingles: 10 against 8 shared of 10 is 0.8; one fewer is below.
    rows = [(1, " ".join(words[:13])), (2, " ".join(words[:11])), (3, " ".join(words[:10])), (4, " ".join(words[50:63])), (5, " ".join(words[50:60]))]
    got = {i: c for i, _, c, _ in found_in(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_coordinates_agree_as_often_as_sets_are_similar():
    r = np.random.default_rng(0)
    hashes = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    order = orders(512)
    agree = (signature(hashes[:800], order) == signature(hashes[100:], order)).mean()
    assert abs(agree - 700 / 900) < 0.08


@pytest.mark.parametrize("seed", range(4))
def test_links_connect_what_all_links_connect(seed):
    r = np.random.default_rng(seed)
    signatures = r.integers(0, 3, (60, 12)).astype(np.uint16)
    signatures[30:] = np.where(r.random((30, 12)) < 0.8, signatures[:30], signatures[30:])
    near = lambda row, others: collide(signatures, row, others, 8)
    assert all(set(near(k, np.arange(60)).tolist()) == set(np.flatnonzero((signatures == signatures[k]).sum(1) >= 8).tolist()) for k in range(60))

    def groups(links):
        root = list(range(60))
        for _ in range(60):
            for u, v in links:
                root[u] = root[v] = min(root[u], root[v])
        return root

    every = [(i, j) for i in range(60) for j in near(i, np.arange(60)).tolist()]
    assert groups(spanning_links(near, np.arange(60))) == groups(every)
    a, b = np.arange(40), np.arange(20, 60)
    across = [(i, j) for i in a.tolist() for j in near(i, b).tolist()]
    assert groups(spanning_links(near, a, b)) == groups(across)
