"""Repeated windows: texts are shuffled as frames, and the first table of pieces goes once it has been read."""

from __future__ import annotations

from pathlib import Path

from routecover.llm import fm_dedup


def test_texts_are_shuffled_as_frames(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([(1, passage), (2, f"a {passage} b"), (3, None), (4, ""), (None, passage)], "doc_id long, text string")
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    cleanup = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before = set(folder.glob("pieces-*"))
    left = fm_dedup.remove_repeats(df)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in left.collect()}
    assert got == {1: (25, 0, passage), 2: (27, 25, "a b"), 3: (0, 0, ""), 4: (0, 0, ""), None: (25, 0, passage)}
    assert set(folder.glob("pieces-*")) == before and list(folder.glob("found-pieces-*"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == cleanup
    plan = left._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 2
