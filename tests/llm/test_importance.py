"""Importance resampling against counting every feature."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from routecover.llm.importance import Hasher, Vocabulary, importance_sample, words_of


def features(text, run=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def plain(rows, target, buckets, least, percent, seed=42):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [Counter(map(bucket, features(t)[1])) for _, t in rows]
    s, t = sum(own, Counter()), sum((Counter(map(bucket, features(x)[1])) for x in target), Counter())
    of_s, of_t = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * of_s / ((s[b] + 1) * of_t))) for b in range(buckets)]
    out = []
    for (i, text), counts in zip(rows, own):
        weight = sum(gain[b] * n for b, n in counts.items())
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        out.append([i, counts.total(), weight, score, None, len(features(text)[0])])
    fit = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for n, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("n_words,n_pairs", [(0, 0), (7, 3), (1000, 1000)])
def test_any_vocabulary_gives_the_same_sample(spark, docs, rows, n_words, n_pairs):
    target = ["same one two", None, "", "ABC é中 0x1f", rows[0][1][:200]]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    found = importance_sample(docs, held, buckets=97, least_words=2, percent=40, n_words=n_words, n_pairs=n_pairs)
    got = sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in found.collect()), key=repr)
    assert got == plain([r[:2] for r in rows], target, 97, 2, 40)


def test_tables_of_nothing(spark, docs, no_docs, rows):
    assert importance_sample(no_docs, docs).collect() == []
    found = importance_sample(docs, no_docs, buckets=31, percent=100)
    assert sorted((r["rank"] for r in found.collect() if r["rank"]), key=int) == list(range(1, 1 + sum(len(words_of((r[1] or "").encode())) >= 20 and r[0] is not None for r in rows)))


def test_states_of_joined_words_are_those_of_the_library():
    r = random.Random(2)
    head = [bytes(r.choice(b"abcxyz019\xc3\xa9") for _ in range(r.randint(1, 48))) for _ in range(60)]
    head = list(dict.fromkeys(head))
    pairs = [(r.randrange(len(head)), r.randrange(len(head))) for _ in range(50)]
    hasher = Hasher(Vocabulary(head, list(dict.fromkeys(pairs))), 10_000, 3)
    words = [r.choice(head) if r.random() < 0.7 else b"w" * r.randint(1, 300) for _ in range(400)] + [head[k] for ab in pairs for k in ab]
    want = [zlib.crc32(b" ".join(words[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    assert hasher.features(words).tolist() == want
    for few in ([], words[:1], words[:2]):
        assert len(hasher.features(few)) == sum(range(len(few) + 1))
