"""Substring and line dedup, decontamination, and the pipeline against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from routecover.llm import decontam, fm_dedup, line_dedup


def plain_repeats(rows: list, window: int) -> dict:
    """{(doc_id, text): kept words} with windows judged by smallest (doc_id, start)."""
    first = {}
    cut = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in cut:
        for i in range(len(w) - window + 1 if d is not None else 0):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, w in cut:
        keep = [True] * len(w)
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < (d, i):
                keep[i : i + window] = [False] * window
        out.append((d, len(w), keep.count(False), b" ".join(x for x, k in zip(w, keep) if k).decode()))
    return sorted(out, key=repr)


def test_substring_dedup(docs, rows, no_docs):
    got = sorted(map(tuple, fm_dedup.remove_repeats(docs).collect()), key=repr)
    assert got == plain_repeats([(r[0], r[1]) for r in rows], 20)
    assert fm_dedup.remove_repeats(no_docs).count() == 0


def test_substring_dedup_of_hot_and_random_passages(spark):
    r = random.Random(4)
    part = [" ".join(r.choice("abcd") for _ in range(9)) for _ in range(6)]
    rows = [(i, " ".join(r.choice(part) for _ in range(r.randint(0, 9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 1000):
        ranges = fm_dedup.repeated_windows(df, window=20, hot=hot, shard_words=300).collect()
        gone = {d: set() for d, _ in rows}
        for x in ranges:
            gone[x.doc_id] |= set(range(x.begin, x.end))
        assert {d: len(g) for d, g in gone.items()} == {d: n for d, _, n, _ in plain_repeats(rows, 20)}


@pytest.mark.parametrize("stream_rows", [3, 50_000])
def test_copies_are_streamed_past_the_index(spark, stream_rows):
    """Large groups of copies, in one part or many: every range comes from the index's search, and each copy loses its windows."""
    r = random.Random(8)
    passage = [" ".join(str(r.randrange(10**6)) for _ in range(n)) for n in (20, 45, 130)]
    own = lambda: " ".join(str(r.randrange(10**6)) for _ in range(r.randrange(30)))
    rows = [(i, f"{own()} {passage[i % 3]} {own()} {passage[0] if i % 5 == 0 else own()}") for i in range(70)] + [(100 + i, passage[2]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {d: set() for d, _ in rows}
    for x in fm_dedup.repeated_windows(df, window=20, shard_words=150, stream_rows=stream_rows).collect():
        gone[x.doc_id] |= set(range(x.begin, x.end))
    assert {d: len(g) for d, g in gone.items()} == {d: n for d, _, n, _ in plain_repeats(rows, 20)}


def test_streamed_ranges_by_place():
    words = "abcdefgh"
    indexed = pd.DataFrame({"doc_id": [5, 2], "start": [7, 0], "digest": [b"y", b"x"], "words": ["b c d h", " ".join(words[:5])]})
    stream = pd.DataFrame({"doc_id": [2, 2, 5, 9], "start": [0, 30, 7, 1], "digest": [b"x", b"x", b"y", b"y"]})
    got = sorted(fm_dedup.streamed_ranges(indexed, stream, 3, at_once=2).itertuples(index=False, name=None))
    assert got == [(2, 30, 35), (5, 7, 10), (9, 1, 5)]
    assert len(fm_dedup.streamed_ranges(indexed, stream[:0], 3)) == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), min_size=1, max_size=6), st.integers(2, 5))
def test_index_finds_earlier_windows(pieces, window):
    seen, want = set(), []
    for p in pieces:
        hits = []
        for i in range(len(p) - window + 1):
            k = tuple(p[i : i + window])
            if k in seen:
                hits.append(i)
            seen.add(k)
        want.append(hits)
    assert [h.tolist() for h in fm_dedup.earlier_windows(pieces, window)] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=80), st.integers(0, 9))
def test_wavelet_ranks(text, symbol):
    index = fm_dedup.FMIndex(np.array([*text, 0]), 4)
    last = np.array([*text, 0])[index.suffixes - 1]
    if symbol <= max(text):
        i = np.arange(len(last) + 1)
        assert index.ranks(np.full(len(i), symbol), i).tolist() == [int((last[:k] == symbol).sum()) for k in i]


def edit_distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_lines(rows: list, least: int, near: int) -> list:
    at = [((d, i), line.split()) for d, t in rows if d is not None and t is not None for i, line in enumerate(t.split("\n"))]
    at = [x for x in at if len(x[1]) >= least]
    alike = lambda a, b: a == b or (len(a) >= near and len(b) >= near and abs(len(a) - len(b)) < 2 and edit_distance(a, b) <= 1)
    gone = {p for p, w in at if any(q < p and alike(v, w) for q, v in at)}
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for i, x in enumerate(lines) if (d, i) not in gone]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept) if t is not None else None))
    return sorted(out, key=repr)


def test_line_dedup(spark, docs, rows, no_docs):
    found = line_dedup.drop_repeated_lines(docs)
    assert found.columns[: len(docs.columns)] == docs.columns
    assert sorted(map(tuple, found.select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr) == plain_lines([(r[0], r[1]) for r in rows], 1, 4)
    assert line_dedup.drop_repeated_lines(no_docs).count() == 0
    r = random.Random(9)
    base = [[r.choice("abcdefgh") for _ in range(12)] for _ in range(4)]
    texts = []
    for i in range(40):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], ["x"], [w[k], "y"]])
        texts.append((i, " ".join(w) + "\n" + " ".join(r.choice(base)[:3])))
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect()), key=repr) == plain_lines(texts, 1, 4)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=7), st.lists(st.sampled_from([b"a", b"b"]), max_size=7))
def test_within_one_edit(a, b):
    assert line_dedup.within_one(a, b) == (edit_distance(a, b) <= 1)


def plain_contaminated(rows: list, items: list, similarity: float = 0.8) -> dict:
    """{(doc_id, item_id): (start, similarity)} over every window of every document."""
    bare = lambda t: "".join(c for c in (t or "").lower() if c not in decontam.MARKS).split()
    count = lambda w, k: Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    best: dict = {}
    for d, text in rows:
        words = bare(text)
        for i, item in items:
            want = bare(item)
            if d is None or i is None or not words or not want:
                continue
            k = min(5, len(want))
            b = count(want, k)
            for start in range(max(1, len(words) - len(want) + 1)):
                a = count(words[start : start + len(want)], k)
                x = sum((a & b).values()) / sum((a | b).values())
                if x >= similarity:
                    best[d, i] = min(best.get((d, i), (0, 0)), (-x, start))
    return {key: (start, round(-x, 6)) for key, (x, start) in best.items()}


def test_decontamination(spark, no_docs):
    r = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    items = [(k, " ".join(r.choice(words) for _ in range(n))) for k, n in enumerate((30, 45, 45, 3, 15, 80))] + [(7, None), (8, ""), (None, "a b c d e f"), (0, ""), (9, "so so so so so so so so so so so")]
    items += [(10, " ".join(r.choice(words) for _ in range(10))), (10, " ".join(r.choice(words) for _ in range(10)))]  # two items of one id
    filler = lambda n: " ".join(r.choice(words) for _ in range(n))
    near = lambda text, *at: " ".join("other" if i in at else w for i, w in enumerate(text.split()))
    halves = items[5][1].split()
    texts = [
        (1, filler(50) + " " + items[0][1].upper() + ". " + filler(20)), (2, near(items[1][1], 20)), (3, filler(10) + " " + near(items[2][1], *range(0, 45, 5))), (4, items[3][1]),
        (5, filler(7) + " " + items[3][1] + ", " + filler(9)), (6, filler(300)), (7, None), (8, ""), (None, items[0][1]), (9, items[4][1][: items[4][1].rfind(" ")]), (1, "twin id"),
        (10, filler(9) + " " + " ".join(halves[40:] + halves[:40]) + " " + filler(9)), (11, filler(3) + " " + items[-2][1] + " " + filler(4)), (12, filler(3) + " " + items[-1][1]),
        (13, "so " * 40), (14, "x " + "so " * 9), (15, filler(5) + " " + items[5][1] + " " + filler(3) + " " + near(items[5][1], 79)), (16, near(items[5][1], 40) + " " + items[5][1]), (17, near(items[5][1], 0, 79)),
        (18, " ".join(items[5][1].split()[:-4])), (19, " ".join(items[5][1].split()[9:])), (1, filler(50)), (15, "nothing"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(texts + texts[:1], "doc_id long, text string").withColumn("item_id", F.lit("clash")).repartition(3)
    want = plain_contaminated(texts, items)
    assert {(1, 0), (4, 3), (5, 3), (9, 4), (10, 5), (11, 10), (12, 10), (13, 9), (15, 5), (17, 5)} <= set(want) and (3, 2) not in want and want[15, 5] == (5, 1.0) and want[16, 5] == (80, 1.0)
    assert {(x.doc_id, x.item_id): (x.start, round(x.similarity, 6)) for x in decontam.contaminated(df, benchmark).collect()} == want
    assert decontam.contaminated(no_docs, benchmark).count() == 0 and decontam.contaminated(df, benchmark.limit(0)).count() == 0


def test_radius_of_windows(spark):
    """Of windows at a similarity of 0.8 to 0.85, the share within the radius of the item's fingerprint."""
    r = random.Random(8)
    rows = []
    for i in range(400):
        item = [f"t{i}x{j}" for j in range(r.choice((30, 60, 120)))]
        near = list(item)
        for _ in range(100):
            trial = list(near)
            trial[r.randrange(len(trial))] = "new"
            runs = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (item, trial)]
            if len(runs[0] & runs[1]) / len(runs[0] | runs[1]) < 0.8:
                break
            near = trial
        rows.append((i, item, near))
    df = spark.createDataFrame(rows, "i long, item array<string>, near array<string>")
    prints = [{x.i: x.fingerprint for x in decontam.simhash(df.withColumn("h", decontam.shingle_hashes(F.col(c), F.lit(5))), ["i"], "h").collect()} for c in ("item", "near")]
    inside = sum(((prints[0][i] ^ prints[1][i]) % 2**64).bit_count() <= 19 for i in prints[0])
    assert inside >= 0.98 * len(rows)


def test_simhash_is_a_majority(spark):
    hashes = [-1, 5, 1 << 62, -(1 << 63), 7, 5]
    df = spark.createDataFrame([(1, hashes)], "k int, h array<long>")
    got = decontam.simhash(df, ["k"], "h").first()["fingerprint"] % 2**64
    assert got == sum(1 << b for b in range(64) if 2 * sum((h % 2**64) >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(2)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    prose = lambda letters, n: " ".join(word(letters) for _ in range(n))
    item = prose("abcdefgh", 30)
    rows = [(i, prose("abcdefgh" if i % 2 else "qrstuvwz", 160), "aa" if i % 2 else "qq", "s", 0) for i in range(60)]
    copy = rows[5][1].split()
    copy[40] = copy[120] = "zzzzz"
    line = prose("abcdefgh", 12)
    rows += [(60, rows[7][1], "aa", "s", 0), (61, " ".join(copy) + "\n" + line, "aa", "s", 0), (62, prose("abcdefgh", 40) + "\n" + item, "aa", "s", 0), (63, "...", None, "s", 0), (64, None, None, "s", 0), (65, prose("abcdefgh", 60) + "\n" + line, "aa", "s", 0), (66, "", "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {x.doc_id for x in now.select("doc_id").collect()}
        assert name == "packed" or now.columns == docs.columns
    everyone = {x[0] for x in rows}
    assert everyone - kept["language"] == {63, 64, 66}
    assert kept["language"] - kept["lines"] == {60}
    assert kept["lines"] - kept["near_copies"] == {61}
    assert kept["near_copies"] - kept["benchmark_passages"] == {62}
    assert kept["packed"] == kept["benchmark_passages"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark_passages", "packed"] and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == len(kept["packed"])
