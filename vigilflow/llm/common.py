"""What the corpus operators share: the shared work folder, Arrow limits, text normalisation."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch: what a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20

_own_folder: str | None = None


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where that is unset, a local session (tests) gets a temporary folder of this process; any other is an error, as
    its executors would not see that folder.
    """
    global _own_folder
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="vigilflow-")
    return f"file://{_own_folder}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: lineage ends here."""
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def limit_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by rows and bytes, so that long texts can't fill a worker's memory.

    The settings stay in the session, as frames are evaluated later. Also tells Python workers where this package
    lies, for sessions that weren't started beside it.
    """
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, environment.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def normalized(text: Column) -> Column:
    """Lower-cased letters and digits, each other run one space, none at the ends; null reads as empty.

    This is the word rule of every shingle operator here: words are maximal runs of letters, marks and digits.
    """
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}\p{N}]+", " "))
