"""Reading of the test tables, size checks for broadcasts, and the shared scratch folder."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest size, in bytes, of a side that may carry a broadcast hint, once it is decoded.
BROADCAST_LIMIT = 16 << 20
#: Times that decoded rows may be larger than Catalyst's estimate, which for files is their compressed size.
EXPANSION = 4
#: Rows of a partition of ``dealt``, about.
DEALT_ROWS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables under ``sf_dir`` (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small(df: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """``df`` with a broadcast hint only where Catalyst's size estimate, times EXPANSION, is at most ``limit``; otherwise
    unchanged, so the join falls back to a shuffled one."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size * EXPANSION <= limit else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with the hint that its join is a shuffled one: for sides that grow with the input. Catalyst takes what is exploded or found in texts for as small as its compressed source, and
    adaptive execution keeps a broadcast that was planned so where the other plan has more exchanges."""
    return df.hint("merge")


def parts_of(df: DataFrame, rows: int = DEALT_ROWS) -> int:
    """The partitions that leave about ``rows`` rows to each."""
    return max(1, -(-df.count() // rows))


def dealt(df: DataFrame, key: str, rows: int = DEALT_ROWS) -> DataFrame:
    """Narrow rows dealt out by a key, about ``rows`` to a partition: for rows that grow in the next step, as a few megabytes of Parquet are a task or two however much is made of them."""
    return df.repartition(parts_of(df, rows), key)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: what ``spark.checkpoint.dir`` names. Where the setting is empty, a local
    session takes a temporary folder and any other raises."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lodestone-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """The session's own folder below the shared one; it is deleted when the driver's JVM ends."""
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/lodestone-{sc.applicationId}"
    if own not in _OWN:
        path = sc._jvm.org.apache.hadoop.fs.Path(own)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWN.add(own)
    return own


def kept_dir(spark: SparkSession, label: str) -> str:
    """The name of a new folder below the shared one that stays when the session ends; nothing is made yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_OWN: set[str] = set()


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage is cut, and a lost executor costs a
    re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of a file, or of the files of a folder: what was derived from them is good while it stays."""
    sc = spark.sparkContext
    found = sc._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(sc._jsc.hadoopConfiguration())
    seen = sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in files.listStatus(found))
    return hashlib.sha256(repr(seen).encode()).hexdigest()


def cleared(spark: SparkSession) -> None:
    """Deletes what ``written`` has left for this session; frames read from it must not be used any more."""
    sc, own = spark.sparkContext, scratch_dir(spark)
    path = sc._jvm.org.apache.hadoop.fs.Path(own)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
