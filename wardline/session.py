"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: What a Python worker gets at a time, however long the rows are.
BATCH_BYTES = str(8 << 20)
#: Folders of the open scratch scopes, the innermost last.
_SCOPES: ContextVar[tuple[str, ...]] = ContextVar("scratch_scopes", default=())
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def build_session(app: str = "wardline", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings every job here relies on."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
        # a repeated key of an object: the last value counts
        .config("spark.sql.variant.allowDuplicateKeys", "true")
        # workers import this package wherever the driver was started
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a temporary folder, since there every task runs on one machine.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that every executor can reach")
    path = tempfile.mkdtemp(prefix="wardline-")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the work folder; a call never reuses an earlier one."""
    return f"{work_dir(spark)}/wardline/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch_scope(spark: SparkSession, name: str = "scope") -> Iterator[None]:
    """Tables that ``cut_lineage`` writes inside are removed at the end, save those that outlive the scope."""
    folder = scratch_path(spark, name)
    token = _SCOPES.set((*_SCOPES.get(), folder))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        remove(spark, folder)


def cut_lineage(df: DataFrame, name: str = "cut", outlives: bool = False, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The rows are computed once, a lost executor costs no recomputation, and the
    optimizer knows the size of what it reads. Inside a scratch scope the table goes
    with the scope; one that ``outlives`` it belongs to the scope around it. ``codec``
    is Spark's setting unless one is named.
    """
    spark = df.sparkSession
    scopes = _SCOPES.get()[:-1] if outlives else _SCOPES.get()
    path = f"{scopes[-1]}/{name}-{uuid.uuid4().hex}" if scopes else scratch_path(spark, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
