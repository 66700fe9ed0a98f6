"""Shared helpers: tables, intermediate results in the shared folder, bounded hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: a run without space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot when it holds more than one in HOT_SHARE of the rows, so at most HOT_SHARE keys are.
HOT_SHARE = 1000

#: Rows in a batch that Python gets at once.
ARROW_ROWS = 1000


def settle(spark: SparkSession) -> None:
    """Settings that the operators rely on. Arrow batches hold whole texts, so they get few rows. Spark 4.1 may take a
    union of differently merged partitions as partitioned by their key, and group wrongly."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    settle(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders made since the innermost ``conclude`` that is under way began. Each thread has its own, so queries don't meet.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a session of one
    machine gets one of its own; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="earshot-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/earshot-{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    settle(spark)
    path = new_folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def conclude(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Materialise what ``make`` gives, then delete the folders that were made on the way."""
    result, own = new_folder(spark, label), []
    outer = _made.set(own)
    try:
        out = make()
        settle(spark)
        out.write.parquet(result)
    finally:
        _made.reset(outer)
        delete(spark, own)
    return spark.read.schema(out.schema).parquet(result)


def delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str, tasks: int | None = None) -> DataFrame:
    """Deal few rows that stand for much work over ``tasks`` tasks, or as many as shuffles have. A number that is
    given keeps Spark from merging tasks by the size of their input."""
    return df.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(column: Column) -> Column:
    return F.regexp_count(column, F.lit(WORD)).cast("long")


def split_join(left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame, how: str = "left") -> DataFrame:
    """Equi-join on non-null ``keys`` where ``right`` has one row a key, safe for hot keys of ``left``.

    ``hot`` lists at most HOT_SHARE keys (see ``hot_keys``). Their rows of ``right`` are broadcast, the others
    are shuffled, so that no task gets more than one in HOT_SHARE of the rows of ``left`` for one key.
    """
    settle(left.sparkSession)
    hot = F.broadcast(hot.select(*keys))
    few = F.broadcast(right.join(hot, keys, "left_semi"))
    return (
        left.join(hot, keys, "left_semi").join(few, keys, how)
        .unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))
    )


def hot_keys(counted: DataFrame, n_rows: int, count: str = "n") -> DataFrame:
    """Of a table with one row a key and its count, the keys over n_rows / HOT_SHARE: at most HOT_SHARE."""
    return counted.where(F.col(count) > max(1, n_rows // HOT_SHARE)) if n_rows else counted.limit(0)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``df``, materialised, with sums (long) over all rows before each in ``order``, which has to be total. Rows are
    sorted by range over tasks; of each task one row of sums comes to the driver."""
    spark = df.sparkSession
    parted = df.withColumns({f"__{k}": v.cast("long") for k, v in sums.items()}).repartitionByRange(*order)
    parted = materialise(parted.withColumn("__task", F.spark_partition_id()), label)
    totals = parted.groupBy("__task").agg(*[F.sum(f"__{k}").alias(k) for k in sums]).orderBy("__task").collect()
    rows, so_far = [], [0] * len(sums)
    for r in totals:
        rows.append((r["__task"], *so_far))
        so_far = [a + (b or 0) for a, b in zip(so_far, r[1:], strict=True)]
    firsts = spark.createDataFrame(rows, ", ".join(["__task int", *(f"__first_{k} long" for k in sums)]))
    before = Window.partitionBy("__task").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = parted.join(F.broadcast(firsts), "__task")
    out = out.withColumns({k: F.col(f"__first_{k}") + F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)) for k in sums})
    return out.select(*df.columns, *sums)
