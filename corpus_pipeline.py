"""From documents to packed token sequences: language, repeated lines, near copies, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and is written as Parquet and read again.
All but the last return the columns of documents, whatever else they are named; an empty table goes through all stages as one.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routecover.llm import decontam, gru_langid, kk_packing, line_dedup, simhash_tiles
from routecover.llm.texts import free_name
from routecover.runtime import written

#: A text whose bytes are, on average, given less than this probability of its language is rejected.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language; those without a letter, or of no learned language, go, and so do rows without an id.

    Where no document has a language to learn from, only those without a letter go.
    """
    usable = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    languages, weights = gru_langid.learn_languages(docs, usable)
    known = docs.where("doc_id is not null")
    if not languages:
        return known.where(F.col("text").rlike(r"\p{L}"))
    found, score, labels = (free_name(docs, n) for n in ("__language", "__score", "__labels"))
    labelled = gru_langid.predict_languages(known, languages, weights, added=(found, score, labels))
    return labelled.where((F.col(found) != gru_langid.UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that repeat an earlier line; a document that loses all its words goes.

    Equal lines count from one word on, lines one word edit apart from four words on: below that, one edit is a third of a line or more.
    """
    n_lines, removed = (free_name(docs, n) for n in ("__lines", "__removed"))
    left = line_dedup.drop_repeated_lines(docs, min_words=1, near_words=4, counts=(n_lines, removed))
    left = left.where((F.col(removed) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of the smallest id, of each group of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

    Pairs are proposed by fingerprints of 128 bits and then compared exactly. At a similarity of 0.8 about 19 of 128 bits differ, with a
    deviation of 4 (24 for texts of four and five shingles); the radius of 36 is four deviations beyond that (over two and a half). Only sets that share one of twelve keys of least values are compared,
    which pairs at 0.8 miss less than once in 200 000.
    Of several texts with one id each is compared on its own.
    """
    groups = simhash_tiles.near_copy_groups(docs, shingle=5, units=2, radius=36, least=0.8)
    own, text = free_name(docs, "__id"), free_name(docs, "__hash")
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("kept")).select(F.col("kept.doc_id").alias(own), F.col("kept.text_hash").alias(text))
    marked = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(text, F.xxhash64("text"))
    return marked.join(first, [own, text], "left_semi").dropDuplicates([own, text]).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; of several texts with one id only those that hold one go. Rows without an id hold none."""
    text = free_name(docs, "__hash")
    marked = docs.withColumn(text, F.xxhash64("text"))
    place = F.struct(F.col("doc_id").cast("long").alias("id"), F.col(text).alias("text"))
    # Items are sought in each text on its own: a row's place in a written list of (id, text) stands for its id.
    named = written(marked.select(place.alias("p"), "text").dropDuplicates(["p"]).withColumn("n", F.monotonically_increasing_id()), "passages")
    found = decontam.contaminated(named.where("p.id is not null").select(F.col("n").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = named.join(found.select(F.col("doc_id").alias("n")).distinct(), "n", "left_semi").select("p.id", F.col("p.text").alias("hash"))
    return marked.join(gone, F.col("doc_id").cast("long").eqNullSafe(gone["id"]) & F.col(text).eqNullSafe(gone["hash"]), "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    pieces = kk_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, capacity=2048)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("packed", packed),
]

#: A network's predictions are no SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
