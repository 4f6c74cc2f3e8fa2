"""Shared pieces of the training-data operators: lineage cuts, text columns, small-table checks."""

from __future__ import annotations

import atexit
import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratal.shuffles import passing

WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\x0c\r"

# A table of at most this many narrow rows may be broadcast; it is counted first.
BROADCAST_ROWS = 20_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir, or an own one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is unset; on a cluster it must name a shared folder")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="stratal-"))
    return _own_dir[0]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch space
        pass


def cut(df: DataFrame, row_group: int | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Lineage ends here: a lost executor costs a re-read, not a recomputation, and the shuffle files go. The files written go at
    exit. Rows of long arrays are better written in small row groups (bytes), which writers and readers hold in memory.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stratal-{uuid.uuid4().hex}"
    with passing(spark):
        (df.write if row_group is None else df.write.option("parquet.block.size", row_group)).parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Remove the files of a cut() that no later plan reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if "/stratal-" in path:
            _remove(df.sparkSession, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has few rows (counted now), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def trimmed(text: Column) -> Column:
    """text without leading and trailing separators; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(WS_CHARS))


def words(text: Column) -> Column:
    """Array of the runs of [^\\x20\\x09-\\x0D]; empty for null or blank texts."""
    body = trimmed(text)
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WS + "+"))


def unspaced(text: Column) -> Column:
    """text without any separator; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for ch in WS_CHARS:
        out = F.replace(out, F.lit(ch), F.lit(""))
    return out


def worker_state(name: str, make):
    """State kept in a Python worker from task to task (functions sent by value lose their globals)."""
    home = sys.modules.setdefault("_stratal_worker_state", types.ModuleType("_stratal_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo parts."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
