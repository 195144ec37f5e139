"""Session defaults: UTC, adaptive execution, bounded Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch of news: what a Python worker holds at a time, whatever the size of its task.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A local session for tests and the benchmark; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("vigilflow")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


def show_workers(spark: SparkSession) -> None:
    """Tell Python workers where this package lies, for sessions that weren't started beside it (a cluster has it by --py-files), and bound
    the batches that they get. The bounds stay in the session, as frames are evaluated later."""
    root, environment = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables of a data folder."""
    show_workers(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


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


def written(df, name: str):
    """The rows of df, written once to the shared folder and read back: lineage ends here."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_text(lines, name: str) -> str:
    """The folder of text files to which the one column of lines was written."""
    path = f"{work_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


def _state(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of a folder's files: another tuple after any change of them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def once(build: Callable) -> Callable:
    """A builder of (spark, folder) whose plan, not its rows, is made once for a state of the folder's documents: planning takes as long as a small query."""
    made: WeakKeyDictionary = WeakKeyDictionary()

    @wraps(build)
    def get(spark: SparkSession, sf_dir: str):
        show_workers(spark)
        own, state = made.setdefault(spark, {}), _state(spark, f"{sf_dir.rstrip('/')}/documents.parquet")
        if own.get(sf_dir, (None,))[0] != state:
            own[sf_dir] = state, build(spark, sf_dir)
        return own[sf_dir][1]

    return get


def spread(df):
    """Rows over all cores where a small input comes as fewer partitions (a file of one row group is one task).

    Text functions cost far more than moving such an input; an input of as many splits as cores stays as it is,
    so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
