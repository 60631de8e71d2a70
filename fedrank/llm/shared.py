"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000
SALTS = 64
#: At most so many rows of a few dozen bytes are broadcast, after they have been counted.
BROADCAST_ROWS = 200_000
_LEAVING: set[str] = set()
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that the session names for checkpoints; it goes when the application ends.

    Where none is named, as in tests, a local one is made, unless executors run elsewhere: they could not see it.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(where)
    path = f"{where.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    if path not in _LEAVING:
        files(spark, path)[0].deleteOnExit(files(spark, path)[1])
        _LEAVING.add(path)
    return path


def files(spark: SparkSession, path: str):
    """The file system of a path, and the path, as the JVM has them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: For tables of large binary values: a dictionary of them, or many rows to a group, would fill an executor's heap.
PLAIN = {"parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "4"}
#: Texts reach Python in batches of this size at most.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(PLAIN if options is None else options)).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of stored() that nothing will read again, and the shuffle files that no plan refers to any more."""
    spark = SparkSession.active()
    for t in tables:
        held, path = _PATHS.pop(id(t), (None, None))
        if held is not None and held() is t:
            fs, where = files(spark, path)
            fs.delete(where, True)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def hot_keys(counts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The keys that hold at least HOT_SHARE of ``total`` rows: a thousand at most, so they can be broadcast."""
    return counts.where(F.col(n) >= F.lit(max(1000, int(total * HOT_SHARE)))).select(F.col(key).alias(key), F.lit(True).alias("hot"))


def join_salted(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salt: Column, how: str = "left") -> DataFrame:
    """Joins rows to a table with one row a key.  Hot keys' rows are dealt over SALTS tasks, for which their row is copied."""
    hot = F.broadcast(hot)
    dealt = left.join(hot, key, "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(salt), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))).drop("hot")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    copied = right.join(hot, key, "left").withColumn("salt", F.explode(copies)).drop("hot")
    return dealt.join(copied, [key, "salt"], how).drop("salt")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not in ``ids`` (one column ``doc_id``); few are broadcast, more are joined."""
    ids = stored(ids.select("doc_id").distinct(), "ids", {})
    return docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_anti").select(*docs.columns)
