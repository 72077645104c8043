"""Keeping rows between jobs: in the folder that the cluster names, or in tables that are added to bit by bit."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bars import latest

#: Rows of chosen runs, or touched folders, up to which they are broadcast (some 100 bytes each).
FEW = 200_000
#: Folders of stored curves for each candidate: symbols by hash.
SHARDS = 64


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Only a local master, whose tasks share the driver's disk, may leave it unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[[^-]*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tidemill-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once where several steps begin from them; how they are dealt out is remembered."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, not there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """Kept rows with a hint to broadcast them if they are few, else to sort and merge."""
    return df.hint("broadcast" if df.count() <= most else "merge")


# --- bars that are added to --------------------------------------------------------------------------------------------


def merge_latest(new: DataFrame, path: str, keys: list[str], order: str, by: list[str]) -> int:
    """Adds rows to a table of one folder for each value of by; of equal keys the last by order stays.  Returns the folders written.

    Only folders that new rows fall into are read, and only those that come out different are written, by a dynamic partition overwrite: a rerun
    with the same rows writes nothing.  A later row of equal order as a stored one doesn't replace it.  keys must hold the columns
    of by, or tell them, so that equal keys lie in one folder.
    """
    spark = new.sparkSession
    new = kept(new)
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = new.limit(0)
    touched = kept(new.select(*[F.col(c).alias(f"_t_{c}") for c in by]).distinct())
    same = [F.col(c).eqNullSafe(F.col(f"_t_{c}")) for c in by]
    old = old.join(small(touched), same, "left_semi")
    first = "_stored"
    both = old.withColumn(first, F.lit(1)).unionByName(new.withColumn(first, F.lit(0)))
    merged = kept(latest(both.withColumn("_at", F.struct(order, first)), keys, "_at").drop("_at", first))
    changed = kept(_marks(merged, by, "m").join(_marks(old, by, "o").hint("merge"), by, "left").filter("not (m <=> o)").select(*[F.col(c).alias(f"_t_{c}") for c in by]))
    n = changed.count()
    if n:
        out = merged.join(small(changed), same, "left_semi").repartition(*by)
        out.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return n


def _marks(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows and the sum of their hashes for each folder."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.groupBy(*by).agg(F.struct(F.count("*"), F.sum(row)).alias(name))


# --- tables that lie as they are used ----------------------------------------------------------------------------------


def write_bucketed(df: DataFrame, name: str, path: str | None = None, buckets: int = 200, by: str = "symbol", order: str = "ts") -> DataFrame:
    """Writes a table in buckets of by, sorted by it and order in each, and returns it as it is read from then on.

    Windows over by, and over by and more, need no shuffle then.  Nor do joins on by and time of two tables with as many buckets, where the session
    has spark.sql.requireAllClusterKeysForCoPartition off: symbols lie together, so rows of one symbol and time do.  path: where the
    files go, if not to the warehouse.
    """
    out = df.repartition(buckets, by).sortWithinPartitions(by, order).write.bucketBy(buckets, by).sortBy(by, order).mode("overwrite").format("parquet")
    (out.option("path", path) if path else out).saveAsTable(name)
    return df.sparkSession.table(name)


# --- curves that are read again ----------------------------------------------------------------------------------------


def _folder() -> Column:
    return F.concat_ws("|", "cand_id", F.pmod(F.xxhash64("symbol"), F.lit(SHARDS)).cast("string"))


def write_curves(curves: DataFrame, path: str) -> None:
    """Curves of all candidates, one folder for each candidate and share of the symbols, sorted by symbol and time in it."""
    df = curves.withColumn("folder", _folder())
    df.repartition("folder").sortWithinPartitions("folder", "symbol", "cand_id", "ts").write.partitionBy("folder").mode("overwrite").parquet(path)


def read_curves(spark: SparkSession, path: str, chosen: DataFrame) -> DataFrame:
    """Stored curves of chosen runs (symbol, cand_id, ..), with the other columns of chosen; other candidates' folders aren't read.

    chosen must come with a filter on kept rows, as a ranking does: its folders are then looked up before the scan begins.
    """
    right = small(chosen.withColumn("folder", _folder()).withColumnsRenamed({"symbol": "_symbol", "cand_id": "_cand_id", "folder": "_folder"}))
    same = (F.col("folder") == F.col("_folder")) & (F.col("symbol") == F.col("_symbol")) & (F.col("cand_id") == F.col("_cand_id"))
    return spark.read.parquet(path).join(right, same).drop("folder", "_folder", "_symbol", "_cand_id")
