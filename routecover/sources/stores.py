"""Stores kept as Parquet: sampled heights and named selections."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routecover.runtime import settled


def append_heights(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Add samples ``(lng_e7, lat_e7, elev)`` whose place the store does not hold; of equal new places one is kept."""
    fresh = new.dropDuplicates(["lng_e7", "lat_e7"])
    try:
        stored = spark.read.parquet(path)
        fresh = fresh.join(stored.select("lng_e7", "lat_e7"), ["lng_e7", "lat_e7"], "left_anti")
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    fresh.write.mode("append").parquet(path)


#: Side of a tile of the height store, in steps of 1e-7 degrees.
TILE_E7 = 1_000_000


def tile(lng_e7: str = "lng_e7", lat_e7: str = "lat_e7") -> Column:
    """The number of the tenth-of-a-degree tile that holds a place: the store's partition."""
    return (F.floor(F.col(lat_e7) / TILE_E7) * 10_000 + F.floor(F.col(lng_e7) / TILE_E7)).cast("long")


def add_heights(spark: SparkSession, path: str, new: DataFrame, saved_at: int) -> None:
    """Add samples ``(lng_e7, lat_e7, elev)`` of places the tiled store doesn't hold; of equal new places the lowest is kept.

    Only the tiles of ``new`` are read. Two writers at once may both add a place: readers take the earlier save, and :func:`compact_heights` drops the later one.
    Rows without a place or height are left out.
    """
    fresh = new.where("lng_e7 is not null and lat_e7 is not null and elev is not null").groupBy("lng_e7", "lat_e7").agg(F.min("elev").alias("elev"))
    fresh = fresh.select("lng_e7", "lat_e7", "elev", F.lit(saved_at).cast("long").alias("saved_at"), tile().alias("tile"))
    stored = _tiles(spark, path)
    if stored is not None:
        fresh = fresh.join(stored.select("tile", "lng_e7", "lat_e7"), ["tile", "lng_e7", "lat_e7"], "left_anti")
    fresh.hint("rebalance", "tile").write.partitionBy("tile").mode("append").parquet(path)


STORED = "lng_e7 bigint, lat_e7 bigint, elev double, saved_at bigint, tile bigint"


def _tiles(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of the store, or None where there is none yet."""
    try:
        return spark.read.schema(STORED).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_heights(spark: SparkSession, path: str, near: DataFrame | None = None) -> DataFrame:
    """``(lng_e7, lat_e7, elev)``, one row a place: its earliest save, the lowest of equally early ones. With ``near(lng_e7, lat_e7)`` only tiles of these places are read."""
    rows = _tiles(spark, path)
    if rows is None:
        return spark.createDataFrame([], "lng_e7 bigint, lat_e7 bigint, elev double")
    if near is not None:
        rows = rows.join(near.select(tile().alias("tile")).distinct(), "tile", "left_semi")
    first = rows.groupBy("tile", "lng_e7", "lat_e7").agg(F.min(F.struct("saved_at", "elev")).alias("first"))
    return first.select("lng_e7", "lat_e7", "first.elev")


def compact_heights(spark: SparkSession, path: str) -> None:
    """Rewrite the tiles that hold a place twice, with each place's earliest save; other tiles stay. Not to be run beside a writer of the same tiles."""
    rows = _tiles(spark, path)
    if rows is None:
        return
    twice = rows.groupBy("tile", "lng_e7", "lat_e7").agg(F.count("*").alias("n")).where("n > 1").select("tile").distinct()
    first = rows.join(twice, "tile", "left_semi").groupBy("tile", "lng_e7", "lat_e7").agg(F.min(F.struct("saved_at", "elev")).alias("first"))
    # A path can't be overwritten while it is read.
    kept = settled(first.select("lng_e7", "lat_e7", "first.elev", "first.saved_at", "tile"))
    kept.hint("rebalance", "tile").write.partitionBy("tile").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


SELECTION = ("kind", "saved_at", "feature", "batch_no", "edge_id")


def replace_selections(features: DataFrame, removals: DataFrame, saved: DataFrame, path: str) -> None:
    """Save selections ``saved(name, saved_at)`` with their ``features(name, ...)`` and ``removals(name, batch_no, edge_id)``; a name saved before is replaced whole, other names stay.

    A selection is one partition with a row that tells of the save, so an empty one replaces too. Names are trimmed; rows without a name, or of a name
    that isn't saved, are left out.
    """
    named = lambda df: df.withColumn("name", F.trim("name")).where("name != ''")
    names = named(saved).select("name", "saved_at")
    held = named(features).join(names.select("name").distinct(), "name", "left_semi")
    kept = held.select("name", F.lit("feature").alias("kind"), F.struct(*(c for c in held.columns if c != "name")).alias("feature"))
    gone = named(removals).join(names.select("name").distinct(), "name", "left_semi").select("name", F.lit("removal").alias("kind"), "batch_no", "edge_id")
    rows = names.select("name", F.lit("saved").alias("kind"), "saved_at").unionByName(kept, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)
    _replaced(rows, path)


def _replaced(rows: DataFrame, path: str) -> None:
    """Overwrite the partitions of the names in ``rows``. Rows are gathered by name first: else each task would write a file for each name that it meets, tasks times names in all."""
    rows.select("name", *SELECTION).hint("rebalance", "name").write.partitionBy("name").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def delete_selections(names: DataFrame, path: str) -> None:
    """Replace the selections ``names(name)`` by a row that tells of their deletion."""
    spark = names.sparkSession
    gone = names.select(F.trim("name").alias("name"), F.lit("deleted").alias("kind")).where("name != ''").distinct()
    like = spark.read.parquet(path).limit(0)
    _replaced(like.unionByName(gone, allowMissingColumns=True), path)


def load_selections(spark: SparkSession, path: str, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(name, ...features)`` and ``(name, batch_no, edge_id)`` of the saved selections, of ``names`` alone if given: only their partitions are read. Connectors are not part of a selection."""
    rows = spark.read.parquet(path).withColumn("name", F.col("name").cast("string"))
    rows = rows if names is None else rows.where(F.col("name").isin(*(n.strip() for n in names)))
    return rows.where("kind = 'feature'").select("name", "feature.*"), rows.where("kind = 'removal'").select("name", "batch_no", "edge_id")


def save_selections(new: DataFrame, path: str) -> None:
    """Append ``(name, saved_at, ...)`` under trimmed names; rows without a name are left out."""
    new.withColumn("name", F.trim("name")).where("name != ''").write.mode("append").parquet(path)


def latest_selections(saved: DataFrame) -> DataFrame:
    """The last save of every name; a save with ``deleted`` true removes it."""
    order = Window.partitionBy("name").orderBy(F.desc("saved_at"))
    return saved.withColumn("name", F.trim("name")).where("name != ''").withColumn("n", F.row_number().over(order)).where("n = 1 and not deleted").drop("n", "deleted")
