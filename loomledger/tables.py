"""Reading the tables and settling repeated deliveries."""

from __future__ import annotations

import atexit
import shutil
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomledger.shipping import ship


def table(spark: SparkSession, root: str, name: str, spread: bool = True) -> DataFrame:
    """The table ``name`` of the folder ``root``; filters and columns reach the Parquet scan."""
    ship(spark)
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return _spread(df) if spread else df


#: A table from this size on, in fewer files than there are cores, is spread over them after the scan, unless its files are larger than a row group: those are read in parts.
SPREAD_BYTES = 1 << 20
ROW_GROUP = 1 << 27


def _spread(df: DataFrame) -> DataFrame:
    """A small table often is one row group, which one task would read and work on alone; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    files, size = len(df.inputFiles()), size_of(df)
    if files >= cores or size < SPREAD_BYTES or size > files * ROW_GROUP:
        return df
    return df.repartition(cores)


#: Bytes of files up to which all rows go through one aggregate, and most bytes of keys that came again which are broadcast.
ONE_PASS = 1 << 26
AGAIN = 1 << 24


def latest(df: DataFrame, key: str | Sequence[str], order: str = "ingested_at", keep: Sequence[str] | None = None) -> DataFrame:
    """One row a key: the delivery with the greatest ``order``.

    Null orders lose against any other; rows that tie on ``order`` are settled by the greatest
    remaining columns, so the result does not depend on file order. Rows whose key is null form one group.
    An aggregate with map-side combine, so that a key that holds a third of all rows is reduced before the shuffle. From ``ONE_PASS`` bytes on keys come first: they alone are
    shuffled to find those that came more than once, and while those are few enough to be broadcast, the rows of all other keys stay where they are. The rows are the same either way.
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in (keep or df.columns) if c not in keys]
    rows = df.select(*keys, *rest)

    def settled(some: DataFrame) -> DataFrame:
        best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in rest])).alias("_b")
        return some.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])

    if size_of(df) < ONE_PASS:
        return settled(rows)
    again = settle(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]), "again")
    if size_of(again) > AGAIN:
        return settled(rows)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    few = F.broadcast(again)  # within ``AGAIN`` bytes
    return rows.join(few, same, "left_anti").unionByName(settled(rows.join(few, same, "left_semi")))


def size_of(df: DataFrame) -> int:
    """What Spark takes the size of ``df`` to be, in bytes: that of its files, for a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared folder (``spark.checkpoint.dir``); a local one only where none is named."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomledger-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of settled tables, by application.
_SETTLED: dict[str, list[str]] = {}


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and survives the loss of executors. ``sweep`` takes the folder away."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.mode("overwrite").parquet(path)
    _SETTLED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> int:
    """Deletes what this application has settled, on whatever file system; call it when results are written. Gives the number of folders."""
    jvm = spark._jvm
    paths = _SETTLED.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))
