"""What the operators of this subpackage share: words, the shared scratch folder, lineage cuts."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, for Java, RE2 and Python's regular expressions alike.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, below a local temporary folder if all runs in one process (tests), else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='quirefold-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/quirefold-{os.getpid()}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended: the folder's owner clears it
        return


def cut(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lost executors cost no recomputation beyond this point."""
    folder = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out._cut_folder = folder
    return out


def release(*tables: DataFrame) -> None:
    """Remove what ``cut`` wrote for tables that nothing reads any more."""
    for df in tables:
        _remove(df.sparkSession, df._cut_folder)


def sweep(df: DataFrame) -> None:
    """Have the driver collect its garbage: Spark removes the files of a shuffle when nothing refers to it any more, and finds out only then."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_bytes_total(df: DataFrame, text_col: str) -> int:
    """Bytes of all texts: a scan of one column, from which the number of buckets follows."""
    return df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def buckets_for(items: int, each: int, least: int) -> int:
    return max(least, -(-items // each))


#: Residues that stand for keys in ``likely``: a broadcast of at most so many longs, whatever the number of keys.
RESIDUES = 1 << 20


def residue(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(RESIDUES))


def likely(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys may be among the wanted ones, before a join that decides it.

    Keys are reduced to a hash residue, so what is broadcast has a fixed bound; few wanted keys spare
    most of ``df`` the shuffle, very many spare none, and no row that is wanted is ever lost.
    """
    some = wanted.select(residue(*keys).alias("_residue")).distinct()
    return df.withColumn("_residue", residue(*keys)).join(F.broadcast(some), "_residue", "left_semi").drop("_residue")


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys, none of them null, are not in ``gone``.  Only rows that share a residue with one that goes are shuffled."""
    some = F.broadcast(gone.select(residue(*keys).alias("_residue")).distinct())
    marked = df.withColumn("_residue", residue(*keys))
    touched = marked.join(some, "_residue", "left_semi").join(gone, keys, "left_anti")
    return marked.join(some, "_residue", "left_anti").unionByName(touched).drop("_residue")


def slices(batches, rows: int = 1024):
    """Arrow batches in slices of so many rows, so that what a worker makes of them stays small; freed memory goes back after each batch.

    Workers live on from task to task, and two of them share an executor with its JVM.
    """
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        give_back()


def give_back() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        return


def worker_cache(key: tuple, make):
    """An object that a Python worker makes once and keeps over its tasks (a tokenizer with what it remembers)."""
    kept = sys.modules.setdefault("_quirefold_worker", types.ModuleType("_quirefold_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        kept[key] = make()
    return kept[key]
