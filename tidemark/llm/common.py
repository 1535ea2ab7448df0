"""What the operators share: the shared scratch folder, written intermediate
tables, and the columns of ``documents``."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.

    Where it is unset, a local master (tests) gets a scratch folder; on a
    cluster that would be a machine-local folder, so it is an error there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="tidemark-llm-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost
    executors, and keeps partition ids and ranges that were computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough for a local master and for clusters where the path is the same on
    all machines; elsewhere the package is shipped with ``--py-files``."""
    try:
        environment = spark.sparkContext.environment
    except Exception:  # noqa: BLE001 - Spark Connect: the server's environment holds
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


_CACHES: list[Callable[[], None]] = []


def cached(clear: Callable[[], None]) -> None:
    """Register what empties a cache that a Python worker keeps between tasks."""
    _CACHES.append(clear)


def give_back() -> None:
    """Empty the worker's caches and return freed memory to the system.  A Python
    worker outlives its task and shares its executor's memory with whatever runs
    there next, also of another operator."""
    for clear in _CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)     # glibc has it
    if trim is not None:
        trim(0)


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id's text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def join_spread(left: DataFrame, right: DataFrame, key: str, share: int = 2000) -> DataFrame:
    """``left`` left join ``right`` (one row a key) on a non-null key; both are
    written tables.  Keys that hold more than 1/share of the rows of ``left``, at
    most ``share`` keys, are joined by broadcast, so that none of them fills a
    task; the others are shuffled."""
    total = left.count()
    hot = F.broadcast(written(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
                              .filter(F.col("_n") * share > total).select(key), "hot-keys"))
    few = F.broadcast(right.join(hot, key, "left_semi"))
    return (left.join(hot, key, "left_semi").join(few, key, "left")
            .unionByName(left.join(hot, key, "left_anti").join(right, key, "left")))
