"""Top-k search, fingerprints and their components, language and personal data."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routecover.llm import boosting, gru_langid, mtree, pii, simhash_tiles
from routecover.operators.components import connected_components


def test_top_k(spark):
    r = np.random.default_rng(3)
    vectors = [(int(i), [float(x) for x in r.normal(0, 1, 6)]) for i in range(0, 900)]
    vectors += [(100, [1.0] * 6), (100, [1.0] * 6), (901, [1.0] * 6), (902, [1.0] * 6), (903, None), (904, [1.0, None]), (905, [math.nan] * 6), (1000, [math.inf]), (906, [2.0]), (1100, []), (None, [3.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = sorted(map(tuple, mtree.top_k(df, F.col("vec_id") % 100 == 0, shard_rows=200, leaf_size=8, fanout=4).collect()))
    fine = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (i, v) in enumerate(fine):
        if i % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j) for b, (j, w) in enumerate(fine) if a != b)
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored[:10])]
    assert got == sorted(want)
    assert mtree.top_k(df.limit(0), F.lit(True)).count() == 0


def test_equal_points_make_a_tree():
    pages = mtree.build_pages(np.ones((500, 3)), np.arange(500), np.zeros(500, int), 16, 4)
    assert sum(len(p.ids) for p in pages if p.leaf) == 500
    found = mtree.search(pages, 3.0, np.ones(3), 10, (0, 0))
    assert sorted(i for _, i, _ in found) == list(range(1, 11))


def plain_print(text: str | None, k: int) -> int:
    words = [w for w in re.split(rb"[ \t-\r]+", (text or "").encode().lower()) if w]
    runs = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs, rows, no_docs):
    got = {(r.doc_id, r.f0 % 2**64, r.component_id) for r in simhash_tiles.simhash_components(docs).collect()}
    prints = {(r[0], plain_print(r[1], 3)) for r in rows}
    reach = {f: min((d for d, g in prints if g == f and d is not None), default=None) for _, f in prints}
    for _ in range(5):
        for f in reach:
            reach[f] = min((reach[g] for g in reach if (f ^ g).bit_count() <= 2 and reach[g] is not None), default=None)
    assert got == {(d, f, reach[f]) for d, f in prints}
    assert simhash_tiles.simhash_components(no_docs).count() == 0


def test_tiles_find_every_link(spark):
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    flips = (np.uint64(1) << r.integers(0, 64, (40, 4), dtype=np.uint64))
    prints = np.unique(np.concatenate([base, base ^ flips[:, 0], base ^ flips[:, 0] ^ flips[:, 1], base ^ flips[:, 2] ^ flips[:, 3] ^ flips[:, 0]]))
    df = spark.createDataFrame([(i, int(p.astype(np.int64))) for i, p in enumerate(prints)], "id long, f0 long")
    for radius in (2, 9):
        links = simhash_tiles.link_fingerprints(df, radius=radius, block=16)
        got = {tuple(x) for x in connected_components(links).collect()}
        label = list(range(len(prints)))
        for _ in range(len(prints)):
            new = [min(label[j] for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= radius) for i in range(len(prints))]
            if new == label:
                break
            label = new
        assert got == {(i, c) for i, c in enumerate(label) if label.count(c) > 1}


def test_components_of_many_shapes(spark):
    edges = [(0, 1), (1, 2), (5, 4), (4, 9), (7, 7), (2, 2), (30, 31), (31, 32), (32, 33), (33, 34), (34, 30), (None, 3)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 9: 4, 7: 7, 30: 30, 31: 30, 32: 30, 33: 30, 34: 30}


def test_gradients_agree_with_differences():
    w = {k: v.astype(np.float64) for k, v in gru_langid.new_weights(3, 4).items()}
    r = np.random.default_rng(0)
    octets, labels = r.integers(97, 103, (6, 5)), r.integers(0, 3, 5)

    def loss():
        p = gru_langid.softmax(gru_langid.label_scores(w, gru_langid.run_states(w, octets)))
        return float(-np.log(np.take_along_axis(p, labels[None, :, None].repeat(6, 0), 2)).mean())

    _, g = gru_langid.gradients(w, octets, labels)
    for name, place in (("x", (0, 99, 2)), ("x", (1, 98, 9)), ("u", (0, 1, 5)), ("u", (1, 2, 10)), ("out", (6, 1)), ("bias", (2,))):
        kept = w[name][place]
        w[name][place] = kept + 1e-3
        up = loss()
        w[name][place] = kept - 1e-3
        down = loss()
        w[name][place] = kept
        assert abs((up - down) / 2e-3 - g[name][place]) < 1e-3


def test_language_learns_and_labels(spark, docs, no_docs):
    r = np.random.default_rng(1)
    text = lambda letters: " ".join("".join(r.choice(list(letters), 5)) for _ in range(60))
    rows = [(i, text("abcdefgh") if i % 2 else text("qrstuvwz"), "aa" if i % 2 else "qq") for i in range(120)]
    known = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, weights = gru_langid.learn_languages(known, F.col("doc_id") < 80, steps=60, hidden=6)
    assert languages == ["aa", "qq"]
    found = gru_langid.predict_languages(known, languages, weights, with_positions=True).collect()
    assert all(x.lang_pred == x.lang and 0 <= x.score <= 1 and len(x.labels) == len(x.text.encode()) for x in found if x.doc_id >= 80)
    odd = {x.doc_id: x for x in gru_langid.predict_languages(docs, languages, weights).collect()}
    assert {i for i, x in odd.items() if x.lang_pred == "und"} == {3, 4, 5} and odd[3].score == 0 and odd[1].source is None
    assert gru_langid.predict_languages(no_docs, *gru_langid.learn_languages(no_docs, F.lit(True))).count() == 0


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list:
    def fine(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(p) <= 255 for p in s.split("."))
        if kind == "card":
            return 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if fine(k, m.group())]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789 -.@a+()%_٣é", "192.168.1.1", "a@b.c", "+1 (555) 123-4567", "4111111111111111"]), max_size=40))
def test_base_spans_follow_the_patterns(parts):
    text = "".join(parts)
    assert sorted((k, b, e) for k, b, e, ok in pii.base_matches(text) if ok) == sorted(plain_spans(text))


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice("abdeilmnorstu") for _ in range(r.randint(2, 8))) + r.choice(["", "", "", ".", ","]) for _ in range(n))


def test_personal_data(spark, docs, no_docs, rows):
    texts = [f"word {i} call +1 (826) 555-{4000 + i} or mail u{i}@host.example.com now" for i in range(300)] + ["merged 7536784127813050 4845168114407329 x", "7536784127813051 and no more", "a" * 100_000 + "@", "1" * 50_000, "a@" * 20_000]
    known = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, thresholds = pii.learn_spans(known)
    found = {r.doc_id: r for r in pii.find_spans(known, model, thresholds).collect()}
    for i, t in enumerate(texts):
        assert found[i].base == pii.joined(plain_spans(t)) and set(filter(None, found[i].base.split(","))) <= set(found[i].spans.split(","))
    assert found[300].n_card == 0 and found[300].spans == "card:24:40" and found[301].spans == ""
    assert pii.redact("mail u1@host.example.com now", "email:5:24") == "mail <email> now"
    got = pii.find_spans(docs, model, thresholds).select("doc_id", F.sha2("base", 256)).collect()
    assert sorted(map(str, got)) == sorted(map(str, [type(got[0])(doc_id=r[0], **{"sha2(base, 256)": hashlib.sha256(pii.joined(plain_spans(r[1] or "")).encode()).hexdigest()}) for r in rows]))
    assert pii.find_spans(no_docs, *pii.learn_spans(no_docs)).count() == 0


def test_added_spans_raise_recall(spark):
    """Disguised data in texts that training never saw: what the base patterns find, and what is added, in recall and precision."""
    r = random.Random(21)
    known = spark.createDataFrame([(i, prose(r, r.randint(5, 120))) for i in range(300)], "doc_id long, text string")
    model, thresholds = pii.learn_spans(known)
    planted, base, added = set(), set(), set()
    for i in range(300):
        text, laid, _ = pii.laid_into(prose(r, r.randint(5, 120)), r)
        first, more = pii.chosen(text, model, thresholds)
        planted |= {(i, *x) for x in laid}
        base |= {(i, *x) for x in first}
        added |= {(i, *x) for x in more}
    for kind in pii.KINDS:
        want, before, after = ({x for x in s if x[1] == kind} for s in (planted, base, base | added))
        assert len(before & want) < 0.3 * len(want) and len(after & want) >= 0.85 * len(want), kind
    assert len(added & planted) >= 0.97 * len(added)


def test_shares_of_huge_tables(spark):
    for total in (10**9, 10**11, 7 * 10**8):
        share = 600 / total
        assert abs((gru_langid.hash_limit(share) + 2**63) / 2**64 - share) < share * 1e-6
    assert gru_langid.hash_limit(1.0) == 2**63 - 1
    ids = spark.range(20_000)
    for share in (0.5, 0.01):
        n = ids.where(pii.hash_below(F.col("id"), share)).count()
        assert abs(n - 20_000 * share) < 5 * math.sqrt(20_000 * share)
    assert ids.where(pii.hash_below(F.col("id"), 1.0)).count() == 20_000


def test_more_languages_than_a_byte_counts():
    names = 300
    w = gru_langid.new_weights(names, 4)
    p, marks = gru_langid.pooled(w, [b"some text", b""], 8)
    assert p.shape == (2, names) and marks[0].dtype == np.uint16 and len(marks[0]) == 9 and len(marks[1]) == 0
    assert not gru_langid.LETTER.search("\u00b2 \u00bd 12 _") and gru_langid.LETTER.search("\u00e9")


def test_boosting_learns_a_rule():
    r = np.random.default_rng(2)
    x = r.normal(0, 1, (600, 4))
    y = ((x[:, 0] > 0) & (x[:, 2] < 0.5)).astype(float)
    model = boosting.fit(x[:400], y[:400])
    p = model.probability(x[400:])
    assert ((p > 0.5) == y[400:]).mean() > 0.95
    assert boosting.threshold_for(np.array([0.9, 0.8, 0.2]), np.array([1.0, 0.0, 0.0]), 0.99, 0.5) == 0.9
    assert boosting.threshold_for(np.array([0.9]), np.array([0.0]), 0.99, 0.5) > 1
