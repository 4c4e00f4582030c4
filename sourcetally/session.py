"""Session helpers: local sessions, the shared scratch folder, small-input spreading."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "12g") -> SparkSession:
    """A session for tests and the local bench.  On a cluster use the cluster's own session."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("sourcetally")
             .config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", memory)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or that the session's checkpoints go to.  It must
    be shared by all executors; without one there is an error, but for a local session, whose
    executors are this process: that gets a temporary folder until the process ends."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="sourcetally-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


#: Folder of the run that this thread is in, see ``run_scope``.
_run: ContextVar[str | None] = ContextVar("run", default=None)


def _application_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def stored_folder(spark: SparkSession) -> str:
    """Where intermediate tables lie: those of this run, if there is one, else of this application."""
    return "/".join(filter(None, [_application_folder(spark), _run.get()]))


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """A run: tables that ``stored`` writes inside, in this thread, are removed when it ends, also by an
    error, and no others are.  Results must be written or collected before; a run inside a run ends
    by itself."""
    token = _run.set(f"run-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        folder = stored_folder(spark)
        _run.reset(token)
        _remove(spark, folder)


def release(spark: SparkSession) -> None:
    """Remove all of the application's intermediate tables: also those behind lazy results and in other
    runs of this application, which then can't be read any more; ``run_scope`` ends one run alone."""
    _remove(spark, _application_folder(spark))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the scratch folder and read it back: cuts the lineage, survives the
    loss of executors and, unlike a checkpoint, keeps column pruning for its readers.  It goes when
    its ``run_scope`` ends, or by ``release``."""
    path = f"{stored_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition an input that arrives in fewer partitions than there are cores (a small
    file is one split).  A large input has more splits than that and is left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
