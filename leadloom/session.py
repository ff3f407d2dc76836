"""Session helpers: the shared folder, written stages, and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_own_dir: list[str] = []
_releasing: list[list[tuple[DataFrame, str]]] = []

#: Shuffle files of a finished write go at once, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent and the session is local, a folder of our own is set.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="leadloom-"))
    return f"file://{_own_dir[0]}"


def written(df: DataFrame, name: str, *more: DataFrame) -> DataFrame:
    """Write a stage to the shared folder and read it back; the parts ``more`` are added one after another, and all are read as one.

    The rows survive lost executors and nothing upstream runs twice.  What the
    write's own plan has shuffled goes when it is done.  Files go away at the
    end of ``releasing`` or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/leadloom-{uuid.uuid4().hex[:12]}-{name}"
    schema = df.schema
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        for part in (df, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    stage = spark.read.schema(schema).parquet(path)
    if _releasing:
        _releasing[-1].append((stage, path))
    return stage


@contextmanager
def releasing():
    """Stages written inside go at the end, but for those that the block appends to the list it gets: nothing else is read later."""
    kept: list[DataFrame] = []
    _releasing.append([])
    try:
        yield kept
    finally:
        inside = _releasing.pop()
        stay = [x for x in inside if any(x[0] is k for k in kept)]
        if _releasing:
            _releasing[-1] += stay
        for stage, path in inside:
            if all(stage is not k for k in kept):
                _remove(stage.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: whoever owns the folder clears it
        pass


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python once per application, and keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="leadloom-zip-")) / "leadloom_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, os.path.join(root.name, path.relative_to(root)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
