"""Session helpers: builder defaults, table access and the shared work folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

#: A table whose files take at most this many bytes may be broadcast after its size was measured.
BROADCAST_BYTES = 2 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str = "local[*]", app: str = "rosterlake", **conf: str) -> SparkSession:
    """A session with the defaults this library is tested with (UTC, AQE on, ANSI left on)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the session's Python workers once, so they need neither the driver's working
    directory nor its path. Spark serves the archive to the executors itself."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # already imported from an archive
        return
    folder = tempfile.mkdtemp(prefix="rosterlake-src-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = f"{folder}/rosterlake-src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for root, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(root, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_local_root: str | None = None


def work_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session, and only where that
    is unset (as in tests) a temporary folder of this machine."""
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="rosterlake-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return "file://" + _local_root


def _remove(path: str, spark: SparkSession | None = None) -> None:
    """Delete a work folder: through the file system it lies in where a session is given."""
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        shutil.rmtree(parsed.path, ignore_errors=True)
    elif spark is not None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class _Cleanup:
    """Spark's deletion of a finished query's shuffle files, on while any thread writes a work table and then
    as it was before."""

    def __init__(self) -> None:
        self.lock, self.users, self.before = threading.Lock(), 0, None

    @contextmanager
    def on(self, spark: SparkSession):
        with self.lock:
            if not self.users:
                self.before = spark.conf.get(_CLEANUP, None)
                spark.conf.set(_CLEANUP, "true")
            self.users += 1
        try:
            yield
        finally:
            with self.lock:
                self.users -= 1
                if not self.users:
                    spark.conf.set(_CLEANUP, self.before) if self.before is not None else spark.conf.unset(_CLEANUP)


_cleanup = _Cleanup()


def materialise(df: DataFrame, label: str = "t", codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives the loss of executors,
    and gives the planner a measured size. The files go with ``drop_work`` or, in local and shared POSIX
    folders, at the end of the process."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{label}-{uuid.uuid4().hex}"
    # shuffle files of the finished write serve nobody: let Spark delete them at once
    with _cleanup.on(spark):
        df.write.option("compression", codec).mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._work_path = path
    parsed = urlparse(path)
    if parsed.scheme in ("", "file"):
        atexit.register(_remove, path)
    return out


def drop_work(*frames: DataFrame) -> None:
    """Delete the files of materialised frames that no later step reads."""
    for f in frames:
        path = getattr(f, "_work_path", None)
        if path:
            _remove(path, f.sparkSession)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a materialised frame, from the file system."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._work_path)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return fs.getContentSummary(path).getLength()


def small_enough(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised frame may be broadcast: its files are measured, never assumed."""
    return stored_bytes(df) <= limit


__all__ = ["BROADCAST_BYTES", "build_session", "drop_work", "materialise", "ship_package", "small_enough", "stored_bytes", "table", "work_root"]
