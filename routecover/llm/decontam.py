"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows, then exact similarity.

A window of the wanted similarity shares most of its shingles with the item, so an item's windows are laid in a document wherever enough
shared shingles lie within the length of one. Their fingerprints meet the item's through a
multi-index: cut into one block more than the radius, two fingerprints within it agree on a block. The
candidates' shingles are then compared as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routecover.runtime import written

#: Marks that don't tell words apart (fixed values).
MARKS = ".,;:!?\"'()[]"
#: An item table with more shingles than this is not broadcast.
BROADCAST_SHINGLES = 200_000


def words_of(text: Column) -> Column:
    """Lower-case words without marks, between ASCII white space; null has none."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKS, "")
    return F.array_remove(F.split(bare, r"[\x20\x09-\x0D]+"), "")


def with_value(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, not once for each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_count(n_words: Column, size: Column) -> Column:
    return F.greatest(n_words - size + 1, F.lit(0))


def _runs(words: Column, size: Column, of) -> Column:
    n = lambda w: shingle_count(F.size(w), size)
    return with_value(words, lambda w: F.when(n(w) > 0, F.transform(F.sequence(F.lit(1), n(w)), lambda i: of(F.slice(w, i, size)))).otherwise(F.array()))


def shingles(words: Column, size: Column) -> Column:
    """Runs of ``size`` words as arrays, in order, repeats included."""
    return _runs(words, size, lambda run: run)


def shingle_hashes(words: Column, size: Column) -> Column:
    """64-bit hashes of the shingles."""
    return _runs(words, size, lambda run: F.xxhash64(run))


def placed_hashes(rows: DataFrame, keys: list[str], words: str, sizes: list[int]) -> DataFrame:
    """``(*keys, n, k, at, h)``: the hash of every shingle of k words, for each k of ``sizes``, with its place and the number of words.

    The words beside each word are laid out as columns, so that hashing is compiled code.
    """
    most = max(sizes)
    beside = F.arrays_zip(*(F.slice(words, j + 1, F.size(words)).alias(f"w{j}") for j in range(most)))
    each = rows.select(*keys, F.size(words).alias("n"), F.posexplode(beside).alias("at", "w"))
    hashes = [F.struct(F.lit(k).alias("k"), F.when(F.col("at") + k <= F.col("n"), F.xxhash64(*(F.col(f"w.w{j}") for j in range(k)))).alias("h")) for k in sizes]
    each = each.select(*keys, "n", "at", *([hashes[0].alias("x")] if len(hashes) == 1 else [F.explode(F.array(*hashes)).alias("x")]))
    return each.select(*keys, "n", "at", "x.k", "x.h").where("h is not null")


def window_starts(rows: DataFrame, similarity: float) -> DataFrame:
    """``rows`` with ``starts``: places of the windows that can be the best at ``similarity`` or more.

    ``rows`` has ``n, k, m`` (words of the text, words of a shingle, shingles of the item) and ``met``, the places and hashes ``(at, h)`` of the shared
    shingles in order. A window has ``held = min(m, n - k + 1)`` shingles. Of similarity s = c / (m + held - c), c being the shared ones with repeats as often as both have them, it
    holds at least s (m + held) / (1 + s) shared places; every such window is looked at, from its first shared place. c is at most the shared places and
    at least the distinct hashes in a window, so a window with fewer places than another has distinct hashes isn't the best.
    """
    rows = rows.withColumn("held", F.least(F.col("m"), F.col("n") - F.col("k") + 1))
    rows = rows.withColumn("least", F.greatest(F.ceil((F.col("m") + F.col("held")) * similarity / (1 + similarity) - 1e-9).cast("int"), F.lit(1))).where(F.size("met") >= F.col("least"))
    place = lambda i: F.element_at("met", i)["at"]
    before = lambda i: F.when(i > 1, F.element_at("met", F.greatest(i - 1, F.lit(1)))["at"] + 1).otherwise(0)
    low = lambda i: F.greatest(before(i), place(i + F.col("least") - 1) - F.col("held") + 1)
    high = lambda i: F.least(place(i), F.col("n") - F.col("k") + 1 - F.col("held"))
    firsts = F.filter(F.sequence(F.lit(1), F.size("met") - F.col("least") + 1), lambda i: low(i) <= high(i))

    def looked_at(i: Column) -> Column:
        near = F.slice("met", i, F.col("held"))
        inside = lambda start: F.filter(near, lambda x: x["at"] < start + F.col("held"))
        return F.transform(F.sequence(low(i), high(i)), lambda start: with_value(inside(start), lambda x: F.struct(start.alias("start"), F.size(x).alias("most"), F.size(F.array_distinct(F.transform(x, lambda y: y["h"]))).alias("sure"))))

    rows = rows.withColumn("seen", F.flatten(F.transform(firsts, looked_at))).withColumn("sure", F.array_max(F.transform("seen", lambda x: x["sure"])))
    kept = F.transform(F.filter("seen", lambda x: x["most"] >= F.col("sure")), lambda x: x["start"])
    return rows.where(F.size("seen") > 0).withColumn("starts", kept).drop("held", "least", "seen", "sure")


def simhash(rows: DataFrame, keys: list[str], hashes: str) -> DataFrame:
    """``(*keys, fingerprint)`` of 64 bits: the majority over all hashes of the arrays, a repeat counting again.

    Bits j and j + 32 of every hash are summed as two halves of one long, so 32 sums give all 64 counts.
    """
    each = rows.select(*keys, F.explode(hashes).alias("h"))
    two = F.lit(0x0000000100000001).cast("long")
    sums = each.groupBy(*keys).agg(F.count("*").alias("n"), *(F.sum(F.shiftrightunsigned("h", j).bitwiseAND(two)).alias(f"s{j}") for j in range(32)))
    bits = F.lit(0).cast("long")
    for j in range(32):
        low, high = F.col(f"s{j}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{j}", 32)
        for count, place in ((low, j), (high, j + 32)):
            bits = bits.bitwiseOR(F.when(2 * count > F.col("n"), F.shiftleft(F.lit(1).cast("long"), place)).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, bits.alias("fingerprint"))


def blocks(fingerprint: str, radius: int) -> Column:
    """The fingerprint cut into ``radius + 1`` blocks, as (number, value)."""
    n = radius + 1
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return F.array(
        *(
            F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")).alias("value"))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:]))
        )
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 19,
) -> DataFrame:
    """``(doc_id, item_id, start, similarity)``: each document's best window for each item that it holds at ``similarity`` or more.

    A window has as many words as the item (all of a shorter document) and may begin anywhere. The similarity is that of the two shingle multisets: sum of the
    lesser over sum of the greater counts. An item of fewer than ``shingle`` words is one shingle; an item, or a document, without words
    matches nothing, and so do rows with a null id. Items of one id and different words are judged on their own, and the best counts. Repeated rows are judged once;
    of equal windows the first counts; other columns are ignored. A very long text is one row, whose work grows with its shared places. An empty table of either kind
    gives no rows. ``radius`` 19 of 64 bits is over three deviations beyond the bits that differ, on average, at a similarity of 0.8.

    Items' shingles are broadcast only if there are at most ``BROADCAST_SHINGLES``, by count.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), words_of(F.col(item_text_col)).alias("item_words"))
    items = items.where(F.col("item_id").isNotNull() & (F.size("item_words") > 0)).dropDuplicates()
    items = items.withColumn("size", F.size("item_words")).withColumn("k", F.least(F.col("size"), F.lit(shingle)))
    items = written(items.withColumn("item_row", F.xxhash64("item_words")), "items")
    counted = items.groupBy("k").agg(F.sum(F.col("size") - F.col("k") + 1)).collect()  # at most ``shingle`` rows
    if not counted:
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kind(docs, id_col)}, item_id {kind(items, 'item_id')}, start int, similarity double")
    sizes = sorted(r[0] for r in counted)
    item_key = ["item_id", "item_row"]
    shapes = items.select(*item_key, "size", "k", (F.col("size") - F.col("k") + 1).alias("m"))
    marks = placed_hashes(items.select(*item_key, "item_words"), item_key, "item_words", sizes).select(*item_key, "k", "h").distinct().join(shapes, [*item_key, "k"])
    marks = F.broadcast(marks) if sum(r[1] for r in counted) <= BROADCAST_SHINGLES else marks

    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    read = read.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("row", F.xxhash64("text"))
    shared = placed_hashes(read.select("doc_id", "row", words_of(F.col("text")).alias("words")), ["doc_id", "row"], "words", sizes).join(marks, ["k", "h"])
    # The places of one item in one document, no more than the document has.
    met = shared.groupBy("doc_id", "row", *item_key, "size", "k", "m", "n").agg(F.array_sort(F.collect_set(F.struct("at", "h"))).alias("met"))
    laid = written(window_starts(met, similarity).drop("met"), "windows")
    held = laid.join(read, ["doc_id", "row"]).dropDuplicates(["doc_id", "row", *item_key]).withColumn("words", words_of(F.col("text"))).drop("text")
    held = held.select("doc_id", "row", *item_key, "size", "k", "words", F.explode("starts").alias("start"))
    held = written(held.withColumn("window", F.slice("words", F.col("start") + 1, F.col("size"))).drop("words"), "window-words")

    pair = ["doc_id", "row", *item_key, "start"]
    window_prints = simhash(held.withColumn("hashes", shingle_hashes(F.col("window"), F.col("k"))), pair, "hashes")
    item_prints = simhash(items.withColumn("hashes", shingle_hashes(F.col("item_words"), F.col("k"))), item_key, "hashes")
    cut = lambda rows, keys: rows.select(*keys, "fingerprint", F.inline(blocks("fingerprint", radius)))
    candidates = (
        cut(window_prints, pair)
        .join(cut(item_prints, item_key).withColumnRenamed("fingerprint", "item_print"), [*item_key, "block", "value"])
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= radius)
        .select(*pair)
        .distinct()
    )
    runs = candidates.join(held, pair).select(*pair, F.explode(shingles(F.col("window"), F.col("k"))).alias("shingle"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    runs = runs.unionByName(
        candidates.join(items.select(*item_key, "item_words", "k"), item_key).select(*pair, F.explode(shingles(F.col("item_words"), F.col("k"))).alias("shingle"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    counts = runs.groupBy(*pair, "shingle").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    scored = counts.groupBy(*pair).agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("similarity")).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.start").alias("start"), (-F.col("best.s")).alias("similarity"))
