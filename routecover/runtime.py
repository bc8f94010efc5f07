"""Session helpers: the shared folder, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a task takes at once where it works on its rows as arrays.
CHUNK = 500_000

#: Rows that a task sorts or gathers by key, where a key's own rows allow it.
TASK_ROWS = 500_000

#: Areas of at most so many rows are worked off whole in a task, several at once; larger ones by joins over all tasks.
AREA_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is the cluster's ``spark.checkpoint.dir``. Only where that is unset and the session is local, as in tests, a
    temporary folder is made and set; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-routecover-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again.

    The result has no lineage before the files, so a lost executor costs no recomputation of ``df``.
    """
    return settled_at(df, name, **options)[0]


def settled_at(df: DataFrame, name: str, **options: str) -> tuple[DataFrame, str]:
    """:func:`written`, and the folder, for :func:`deleted` once nothing reads it any more."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun within delete their shuffle files at their end; else they stay until the driver happens to collect garbage. For tables that are written and read again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def deleted(spark: SparkSession, folder: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint; its files go when the result is garbage-collected."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def settled(df: DataFrame) -> DataFrame:
    """One round's state of a loop, written as Parquet and read again.

    A checkpoint keeps the size estimated for its plan, and a join multiplies its inputs' estimates: over the rounds of a loop these numbers get so
    many digits that planning takes longer than the work. Files give their real size. What was shuffled for them goes with the write.
    """
    with shuffles_dropped(df.sparkSession):
        return written(df, "round", compression="zstd")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about ``rows`` rows dealt by ``keys`` to as many tasks as they need, if those are more than the session has cores or partitions."""
    spark, tasks = df.sparkSession, -(-rows // TASK_ROWS)
    usual = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys) if tasks > usual else df


class Rounds:
    """State tables of a loop by name; a table's last round is deleted once its next one is written.

    Only for tables that nothing reads later but the next round's plan.
    """

    def __init__(self) -> None:
        self._folders: dict[str, str] = {}

    def settle(self, name: str, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        with shuffles_dropped(spark):
            df.write.parquet(folder, compression="zstd")
        self.drop(spark, name)
        self._folders[name] = folder
        return spark.read.schema(df.schema).parquet(folder)

    def drop(self, spark: SparkSession, *names: str) -> None:
        """Delete the last round of the named tables; nothing may read them any more."""
        for folder in (self._folders.pop(name) for name in names if name in self._folders):
            deleted(spark, folder)

    def drop_all(self, spark: SparkSession, but: Sequence[str] = ()) -> None:
        self.drop(spark, *(set(self._folders) - set(but)))


def once(df: DataFrame, name: str, **values: Column) -> DataFrame:
    """``df`` with a struct ``name`` of values that are computed once for each row: behind a generator, conditions on them don't repeat their expressions."""
    return df.withColumn(name, F.explode(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))


def chunks(batches: Iterable[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.Table]:
    """A task's Arrow batches as tables of about ``most`` rows."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch] if batch.num_rows else held, n + batch.num_rows
        if n >= most:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def codes(columns: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """The rank of each row among the distinct rows of whole-number columns, and where each distinct row is first."""
    out, first = np.zeros(len(columns[0]), dtype=np.int64), None
    for column in columns:
        _, own = np.unique(np.asarray(column), return_inverse=True)
        out = out * (own.max(initial=0) + 1) + own
        _, first, out = np.unique(out, return_index=True, return_inverse=True)
    return out, first


def large_areas(rows: DataFrame) -> tuple[int, DataFrame | None]:
    """How many rows there are, and ``(area_id)`` of areas with over ``AREA_ROWS`` of them; None if there are no such areas."""
    n = rows.groupBy("area_id").agg(F.count("*").alias("n"))
    total, most = n.agg(F.sum("n"), F.max("n")).first()
    return total or 0, settled(n.where(F.col("n") > AREA_ROWS).select("area_id")) if (most or 0) > AREA_ROWS else None


def split_areas(large: DataFrame, *tables: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Of each table the rows of the other areas, and those of the large ones."""
    return [(t.join(large, "area_id", "left_anti"), t.join(large, "area_id", "left_semi")) for t in tables]


def bundles(batches: Iterable[pa.RecordBatch], most: int = AREA_ROWS) -> Iterator[pa.Table]:
    """Batches sorted by area as tables of whole areas, of about ``most`` rows or one area."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held, n = [*held, batch], n + batch.num_rows
        if n >= most:
            rows = pa.Table.from_batches(held)
            own = pc.sum(pc.equal(rows.column("area_id"), rows.column("area_id")[-1])).as_py()
            if own < n:
                yield rows.slice(0, n - own)
                held, n = rows.slice(n - own).to_batches(), own
    if held:
        yield pa.Table.from_batches(held)


def in_areas(rows: DataFrame, total: int, work: Callable[[pa.Table], pa.Table], schema: str | StructType) -> DataFrame:
    """``work`` on tables of whole areas, sorted by area. ``total`` is about how many rows there are."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for table in bundles(batches):
            yield from work(table).to_batches(max_chunksize=100_000)

    # Some tasks more than cores: areas differ in size.
    tasks = max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS))
    return rows.where("area_id is not null").repartition(tasks, "area_id").sortWithinPartitions("area_id").mapInArrow(each, schema)


def starts_of(column: pa.ChunkedArray) -> np.ndarray:
    """Where each area of a sorted column begins, and the end."""
    code, _ = codes([column])
    return np.concatenate([[0], np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]]).astype(np.int64)
