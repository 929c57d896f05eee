"""Session defaults and the one place that decides where checkpoints go."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on; cluster sizing stays with the submitter.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


#: Folders that `new_folder` named, by application.
_WRITTEN: dict[str, list[str]] = {}


def get_session(app: str = "paperloom", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the library defaults; dots in conf names are written `__`."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a temporary one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="paperloom-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, *name: str) -> str:
    """A path below the shared checkpoint folder that nothing else uses; `clean_up` deletes what is written there."""
    path = f"{checkpoint_dir(spark)}/{'-'.join(['paperloom', *name, uuid.uuid4().hex])}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cut(df: DataFrame, *by: str) -> DataFrame:
    """Write `df` as a table into the shared checkpoint folder and go on from there.

    The result no longer depends on executors or on the plan before it, and, unlike a raw checkpoint,
    later steps read only the columns they use. With `by` (columns of few values) they also read only the folders
    that a filter on these leaves.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete a table that `cut` wrote, once no later step reads it."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[-1].startswith("paperloom-"):
            raise ValueError(f"not a table written by cut: {folder}")
        delete_folder(df.sparkSession, folder)


def clean_up(spark: SparkSession) -> int:
    """Delete all folders that `cut` and `new_folder` made in this application; call it once no result of it is read any
    more. Returns how many there were."""
    written = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for folder in written:
        delete_folder(spark, folder)
    return len(written)


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the library's own, wherever it is stored."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    with contextlib.suppress(Exception):  # left to the clean-up of the shared folder
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
