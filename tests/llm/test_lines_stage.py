"""The pipeline's stage of lines against brute force, with short lines."""

from __future__ import annotations

import random

import corpus_pipeline
from routecover.llm.line_dedup import half_keys
from tests.llm.test_dedup import plain_lines


def test_short_lines_count(spark):
    r = random.Random(12)
    base = [[r.choice("abcdefgh") + str(r.randrange(40)) for _ in range(n)] for n in range(1, 12) for _ in range(3)]
    rows = []
    for i in range(60):
        lines = [f"only {i} here and nowhere else {r.random()} {r.random()}"]
        for _ in range(6):
            w = list(r.choice(base))
            if r.random() < 0.5:
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [f"x{r.random()}"], [w[k], f"y{r.random()}"]])
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    rows += [(60, "All rights reserved.\n" + str(r.random())), (61, "All  rights reserved.\n" + str(r.random())), (62, "https://x.example/" + "a" * 900 + "\n" + str(r.random())), (63, "https://x.example/" + "a" * 900 + "\n" + str(r.random()))]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    got = {x.doc_id: (x.text, x.n_chars) for x in corpus_pipeline.lines(spark, docs, "").collect()}
    want = {d: t for d, _, _, t in plain_lines(rows, 1, 4)}
    assert got == {d: (t, len(t)) for d, t in want.items()}
    assert "rights" not in got[61][0] and "https" not in got[63][0]


def test_a_document_without_words_left_goes(spark):
    rows = [(1, "the same line of words"), (2, "\n\t\n the same line of words\n\r\n\x0b"), (3, "the same line of words\n\u00a0"), (4, "the same line of words\nmore")]
    docs = spark.createDataFrame([(d, t, len(t)) for d, t in rows], "doc_id long, text string, n_chars long")
    assert {x.doc_id for x in corpus_pipeline.lines(spark, docs, "").collect()} == {1, 3, 4}


def test_lines_one_edit_apart_share_a_half():
    r = random.Random(3)
    for _ in range(2000):
        a = [bytes([r.randrange(97, 100)]) * r.randint(1, 3) for _ in range(r.randint(1, 9))]
        b, k = list(a), r.randrange(len(a))
        b[k : k + 1] = r.choice([[], [b"new"], [a[k], b"new"], [b"new", a[k]]])
        keys = half_keys(a)
        assert len(keys) == len(set(keys)) == (2 if len(a) % 2 else 4)
        assert not b or set(keys) & set(half_keys(b))
    assert not set(half_keys([b"a", b"b c", b"d", b"e"])) & set(half_keys([b"f", b"b", b"c", b"g"]))
