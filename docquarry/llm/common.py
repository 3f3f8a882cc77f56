"""What the operators of this subpackage share: table reading, shared-folder tables, word rules."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java/RE2 form of the separator of words: the complement of [^\x20\x09-\x0D]+.
WORD_GAP = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of the words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a small number: the folds that the contracts fix."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(modulus)


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local tests a new temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="docquarry-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get()
    return root.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back, which cuts its lineage.

    A lost executor costs nothing that was written. Shuffle files of the write are released as soon as it
    ends, because nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that materialize() wrote, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_shared_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def send_file(spark: SparkSession, label: str, data: bytes) -> str:
    """Gives every executor one copy of a file, and returns its name: SparkFiles.get(name) is its path there."""
    name = f"{label}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_root(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        out.write(data)
    finally:
        out.close()
    spark.sparkContext.addFile(path.toString())
    return name


def send_parts(written: DataFrame) -> tuple[str, ...]:
    """Gives every executor the files of a table that materialize() wrote, and returns their names: SparkFiles.get(name) is a file's path there."""
    spark = written.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(written._shared_path)
    found = [s.getPath() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    files = [p for p in found if p.getName().endswith(".parquet")]
    for p in files:
        spark.sparkContext.addFile(p.toString())
    return tuple(sorted(p.getName() for p in files))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files below a frame by the optimizer's statistics: used only to choose partition counts."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def partitions_for(df: DataFrame, target_bytes: int, least: int = 8, most: int = 100_000) -> int:
    return max(least, min(most, -(-input_bytes(df) // target_bytes)))
