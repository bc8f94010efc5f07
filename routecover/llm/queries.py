"""The text operators' registered queries, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from routecover.llm import bitplane, cover_lloyd, decontam, fm_dedup, gru_langid, importance, kk_packing, line_dedup, minhash_lists, mtree, pii, simhash_tiles, trie_counts

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the written planes."""
    return bitplane.read_documents(bitplane.write_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=0))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer products of every row whose id is divisible by 100."""
    return mtree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, scale=1024, k=10)


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base spans of personal data, and all spans with those that the trees add."""
    docs = table(spark, sf_dir, "documents")
    model, thresholds = pii.learn_spans(docs)
    found = pii.find_spans(docs, model, thresholds)
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("long")
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", n_spans.alias("n_spans"))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training; one without an id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op4_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    languages, weights = gru_langid.learn_languages(docs, ~held_out() & F.col("doc_id").isNotNull())
    found = gru_langid.predict_languages(docs.select("doc_id", "text"), languages, weights)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those in repeated windows of 20, and the digest of the rest."""
    left = fm_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pre-tokens and unigram tokens."""
    return trie_counts.count_tokens(table(spark, sf_dir, "documents"), BYTE_RANKS)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and its checksum."""
    pieces = kk_packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=1, capacity=2048)
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds, with its best window."""
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("similarity", F.round("similarity", 6))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, those removed, and the digest of the text that is left."""
    left = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_simhash_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component, at 2 differing bits or fewer."""
    found = simhash_tiles.simhash_components(table(spark, sf_dir, "documents"), shingle=3, units=1, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def op11_cover_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's code and errors, and the digest of the codebooks."""
    coded, _ = cover_lloyd.compress_vectors(table(spark, sf_dir, "embeddings"), scale=1024, parts=4, entries=256, rounds=4)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's features, weight and score against the benchmark, and the rank of those drawn."""
    drawn = importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), buckets=10_000, longest_run=3, least_words=20, percent=5, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_minhash_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of shingles, its component, and whether it is the one kept."""
    return minhash_lists.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, least=80)


OPERATORS = (
    op1_bit_plane_tokens, op2_mtree_topk, op3_pii_boosting, op4_gru_language, op5_fm_substring_dedup,
    op6_trie_token_counts, op7_packing, op8_decontamination, op9_line_dedup, op10_simhash_tiles,
    op11_cover_tree_lloyd, op12_importance_resampling, op13_minhash_lists,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS} | {"pipeline": corpus_pipeline.run}


def lloyd_sql(rounds: int = 4) -> str:
    """DuckDB SQL of op11: each round as two tables, the nearest entries and the moved codebooks."""
    nearest = """
SELECT vec_id, copy, p, v, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
  SELECT vec_id, copy, x.p, v, e, list_sum(list_transform(range(1, len(v) + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d
  FROM x JOIN {book} b ON x.p = b.p) GROUP BY vec_id, copy, p, v"""
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(book=f'b{r}')})")
        steps.append(f"""b{r + 1} AS MATERIALIZED (
SELECT b{r}.p, b{r}.e, coalesce(m.c, b{r}.c) AS c FROM b{r} LEFT JOIN (
  SELECT p, e, list(floor(s / n)::BIGINT ORDER BY i) AS c FROM (
    SELECT p, e, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM x) + 1)) AS i) GROUP BY p, e, i) GROUP BY p, e) m USING (p, e))""")
    return f"""
WITH u AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS copy FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, copy, p, list_transform(embedding[p * len(embedding) // 4 + 1:(p + 1) * len(embedding) // 4], lambda y: floor(y::DOUBLE * 1024)::BIGINT) AS v
  FROM u, (SELECT unnest(range(4)) AS p)
), b0 AS (SELECT p, copy AS e, v AS c FROM x WHERE copy < 256),
{", ".join(steps)}, z AS MATERIALIZED ({nearest.format(book=f"b{rounds}")}),
coded AS (SELECT copy, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM z GROUP BY copy),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM u JOIN coded USING (copy), digest
"""


ORACLES: dict[str, str] = {
    "op11_cover_tree_lloyd": lloyd_sql(),
    "op12_importance_resampling": r"""
WITH bits AS (SELECT n, 8 AS k, n AS c FROM (SELECT unnest(range(256)) AS n)),
crc_table AS (
  SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM bits
), d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), f AS (
  SELECT row, array_to_string(ws[p:p + k - 1], ' ') AS f FROM (SELECT row, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT unnest([1, 2, 3]) AS k))
), g AS (
  SELECT array_to_string(ws[p:p + k - 1], ' ') AS f FROM (SELECT ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM b, (SELECT unnest([1, 2, 3]) AS k))
), named AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
                            lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(f) AS h FROM (SELECT f FROM f UNION SELECT f FROM g)), crc_table
), fb AS (SELECT row, bucket, count(*) AS n FROM f JOIN named USING (f) GROUP BY row, bucket),
s AS (SELECT bucket, sum(n) AS s FROM fb GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM g JOIN named USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), w AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM fb JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AND doc_id IS NOT NULL AS fit,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (row)
), placed AS (SELECT *, row_number() OVER (ORDER BY fit DESC, score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM scored WHERE fit) THEN place END AS rank FROM placed
""",
    "op13_minhash_lists": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                 ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 2), lambda p: array_to_string(ws[p:p + 3], ' ')))) END AS s FROM d
), named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, s FROM sets),
nodes AS (SELECT k, any_value(n) AS n, any_value(s) AS s FROM named WHERE n > 0 GROUP BY k),
post AS (SELECT k, n, unnest(s) AS sh FROM nodes),
near AS (
  SELECT u, v FROM (SELECT a.k AS u, b.k AS v, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM post a JOIN post b ON a.sh = b.sh AND a.k <> b.k GROUP BY a.k, b.k)
  WHERE 100 * c >= 80 * (an + bn - c)
), reach AS (SELECT k, k AS other FROM nodes UNION SELECT reach.k, near.v FROM reach JOIN near ON reach.other = near.u),
least AS (SELECT reach.k, min(doc_id) AS first FROM reach JOIN named ON reach.other = named.k GROUP BY reach.k)
SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE first END AS component_id,
       coalesce(doc_id = CASE WHEN n = 0 THEN doc_id ELSE first END, false) AS kept
FROM named LEFT JOIN least USING (k)
""",
    "op2_mtree_topk": """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (
  SELECT vec_id, v, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS copy FROM usable
), scored AS (
  SELECT q.vec_id AS query_id, q.copy AS query_copy, c.vec_id, c.copy,
         list_inner_product(q.v, c.v)::BIGINT AS score
  FROM numbered q JOIN numbered c ON q.vec_id % 100 = 0 AND (q.vec_id, q.copy) <> (c.vec_id, c.copy)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, query_copy ORDER BY score DESC, vec_id, copy) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 10
""",
    "op5_fm_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS p FROM d WHERE doc_id IS NOT NULL)
), f AS (SELECT k, min((doc_id, p)) AS first FROM win GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p + o AS i FROM (SELECT doc_id, p, unnest(range(20)) AS o FROM win JOIN f USING (k) WHERE first < (doc_id, p))
), words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
""",
    "op8_decontamination": r"""
WITH d AS (
  SELECT DISTINCT doc_id, md5(text) AS row,
         list_filter(string_split_regex(translate(lower(text), '.,;:!?"''()[]', ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, md5(array_to_string(ws, ' ')) AS irow, ws, len(ws) AS size, least(len(ws), 5) AS k FROM (
    SELECT item_id, list_filter(string_split_regex(translate(lower(coalesce(text, '')), '.,;:!?"''()[]', ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
    FROM benchmark WHERE item_id IS NOT NULL) WHERE len(ws) > 0
), ish AS (
  SELECT item_id, irow, size, k, p, ws[p:p + k - 1] AS sh FROM (SELECT *, unnest(range(1, size - k + 2)) AS p FROM i)
), ks AS (SELECT DISTINCT k FROM i), dsh AS (
  SELECT doc_id, row, n, k, p, ws[p:p + k - 1] AS sh
  FROM (SELECT *, len(ws) AS n, unnest(range(1, len(ws) - k + 2)) AS p FROM d, ks)
), near AS (
  SELECT DISTINCT doc_id, row, item_id, irow, size, n, k, dsh.p, least(size, n) - k + 1 AS held FROM dsh JOIN ish USING (k, sh)
), w AS (
  SELECT DISTINCT doc_id, row, item_id, irow, size, k, s - 1 AS start
  FROM (SELECT *, unnest(range(greatest(p - held + 1, 1), least(p, n - k + 2 - held) + 1)) AS s FROM near)
), wsh AS (
  SELECT doc_id, row, item_id, irow, k, start, win[p:p + k - 1] AS sh
  FROM (SELECT *, unnest(range(1, len(win) - k + 2)) AS p
        FROM (SELECT w.*, d.ws[start + 1:start + size] AS win FROM w JOIN d USING (doc_id, row)))
), wc AS (SELECT doc_id, row, item_id, irow, start, sh, count(*) AS a FROM wsh GROUP BY ALL),
ic AS (SELECT item_id, irow, sh, count(*) AS b FROM ish GROUP BY ALL),
wn AS (SELECT doc_id, row, item_id, irow, start, sum(a) AS na FROM wc GROUP BY ALL),
inn AS (SELECT item_id, irow, sum(b) AS nb FROM ic GROUP BY ALL),
common AS (
  SELECT doc_id, row, item_id, irow, start, sum(least(a, b)) AS shared FROM wc JOIN ic USING (item_id, irow, sh) GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, start, shared / (na + nb - shared) AS similarity
  FROM common JOIN wn USING (doc_id, row, item_id, irow, start) JOIN inn USING (item_id, irow)
)
SELECT doc_id, item_id, arg_min(start, (-similarity, start))::INTEGER AS start, round(max(similarity), 6) AS similarity
FROM scored WHERE similarity >= 0.8 GROUP BY doc_id, item_id
""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS t
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), q AS (
  SELECT * FROM (SELECT doc_id, line, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM l) WHERE len(ws) >= 1
), d AS (SELECT ws, min((doc_id, line)) AS pos FROM q GROUP BY ws),
v AS (
  SELECT ws, pos, p, list_concat(ws[1:p - 1], ws[p + 1:]) AS key
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM d WHERE len(ws) >= 4)
), g AS (SELECT key, p, min(pos) AS pos FROM v GROUP BY key, p),
other AS (
  SELECT v.ws, g.pos FROM v JOIN g USING (key, p)
  UNION ALL SELECT v.ws, d.pos FROM v JOIN d ON d.ws = v.key AND len(d.ws) >= 4
  UNION ALL SELECT d.ws, v.pos FROM v JOIN d ON d.ws = v.key AND len(d.ws) >= 4
  UNION ALL SELECT ws, pos FROM d
), first AS (SELECT ws, min(pos) AS pos FROM other GROUP BY ws),
gone AS (SELECT DISTINCT doc_id, line FROM q JOIN first USING (ws) WHERE first.pos < (q.doc_id, q.line)),
kept AS (
  SELECT doc_id, string_agg(t, chr(10) ORDER BY line) AS text, count(*) AS n_kept
  FROM l ANTI JOIN gone USING (doc_id, line) GROUP BY doc_id
), size AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::INTEGER AS n_lines, (coalesce(n, 0) - coalesce(n_kept, 0))::INTEGER AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL WHEN d.doc_id IS NULL THEN sha256(d.text) ELSE sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
}
