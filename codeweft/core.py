"""Session, table and lineage helpers shared by every operator."""

from __future__ import annotations

import atexit
import itertools
import os
import tempfile

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cores: str = "*", partitions: int = 8, app: str = "codeweft") -> SparkSession:
    """A local session for tests and the command line; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CODEWEFT_DRIVER_MEMORY", "4g"))
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and the master is local."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if sc.getCheckpointDir():
        return sc.getCheckpointDir().rstrip("/")
    if sc.master.startswith("local[") or sc.master == "local":
        return "file://" + os.path.join(tempfile.gettempdir(), "codeweft-shared")
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session is gone, or another one removed it
        pass


_tables = itertools.count()
_folders: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    The lineage is short, a lost executor loses nothing, and the planner knows the true size (a chain of checkpoint()
    in an iteration multiplies its size estimates). The folder goes when the application ends.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/codeweft-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    path = f"{folder}/{os.getpid()}-{next(_tables)}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def cut_counted(df: DataFrame, which: Column | None = None) -> tuple[DataFrame, int]:
    """A table as by `cut` and the number of its rows (of those that fulfil `which`), counted while they are written."""
    seen = Observation()
    table = cut(df.observe(seen, (F.count(F.lit(1)) if which is None else F.count_if(which)).alias("n")))
    return table, seen.get["n"]


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and nothing will read again (an iteration's past rounds)."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path:
            _remove(t.sparkSession, path)


BROADCAST_ROWS = 100_000  # of rows of a few numbers and short strings, some ten megabytes


def bounded(table: DataFrame, rows: int) -> DataFrame:
    """A counted table for a join: broadcast if it is small, else left to the planner."""
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def first_of(df: DataFrame, key: str, ts: str) -> DataFrame:
    """The earliest of a key's repeats (they carry the same content later), whole rows left where they are.

    Only keys and times are shuffled; what is left out is few rows as a rule and then broadcast. Null keys are kept.
    """
    again, n = cut_counted(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(ts).alias("__first"), F.count("*").alias("__n")).where("__n > 1").select(F.col(key).alias("__k"), "__first"))
    return df.join(bounded(again, n), (F.col(key) == F.col("__k")) & (F.col(ts) > F.col("__first")), "left_anti")


SPREAD = 4096  # rows of a key that one task may hold


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, spread: int = SPREAD) -> DataFrame:
    """left joined to right on a key that may hold many rows of either.

    Keys with more than `spread` rows of right have them spread over buckets by a hash of the column `by`, and left's rows meet
    each of the buckets, so that what a key yields is made in many tasks.
    """
    hot, n = cut_counted(right.groupBy(key).agg(F.ceil(F.count("*") / spread).cast("int").alias("__n")).where("__n > 1"))
    if not n:
        return left.join(right, key)
    many = bounded(hot, n)
    spreaded = right.join(many, key, "left").withColumn("__b", F.pmod(F.xxhash64(by), F.coalesce("__n", F.lit(1)))).drop("__n")
    met = left.join(many, key, "left").withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("__n", F.lit(1)).cast("bigint") - 1))).drop("__n")
    return met.join(spreaded.withColumn("__b", F.col("__b").cast("bigint")), [key, "__b"]).drop("__b")


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def numbered(df: DataFrame, order: list[str], name: str, within: str | None = None) -> DataFrame:
    """df with `name`: its rows' numbers from 0 in the order of unique columns, within each value of `within` if given.

    No task holds a group: rows are range-partitioned and numbered within their part, and the parts' offsets are added.
    """
    keys = ([within] if within else []) + order
    placed = df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    local = cut(placed.withColumn("__n", F.row_number().over(Window.partitionBy("__part", *([within] if within else [])).orderBy(*order))))
    group = ["__part", within] if within else ["__part"]
    sizes = local.groupBy(*group).agg(F.count("*").alias("__size"))  # one row for each part and group
    upto = (Window.partitionBy(within) if within else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("__part").alias("__p"), *([F.col(within).alias("__g")] if within else []), F.sum("__size").over(upto).alias("__before"))
    cond = F.col("__part") == F.col("__p")
    if within:
        cond = cond & F.col(within).eqNullSafe(F.col("__g"))
    return local.join(before, cond, "left").select(*df.columns, (F.col("__n") - 1 + F.coalesce("__before", F.lit(0))).cast("bigint").alias(name))


def latest(df: DataFrame, key: str, ts: str) -> DataFrame:
    """One row for each key: the earliest of its repeats (they carry the same content later).

    Null keys are kept as one group. Aggregated map-side, so a key that holds a third of all rows is folded
    before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(ts)).alias("__r")
    return df.groupBy(key).agg(best).select(key, "__r.*")
