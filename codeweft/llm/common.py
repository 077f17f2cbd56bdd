"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII case folding, which leaves all other characters alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: a word is a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; a temporary one only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="codeweft-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_WRITTEN: list[str] = []


def cut(frame: DataFrame, **options: str) -> DataFrame:
    """The frame as a table written to the shared folder and read back: its lineage ends there."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/codeweft-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def written() -> int:
    """How many tables this process has cut so far."""
    return len(_WRITTEN)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes the tables cut after the first `since`, but for the last `keep`. Only for results that are written elsewhere."""
    gone = _WRITTEN[since : len(_WRITTEN) - keep]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[since : since + len(gone)]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
