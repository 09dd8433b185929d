"""Table access and the shared folder for intermediate results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str, schema: str | None = None) -> DataFrame:
    """One of the parquet tables of a data directory; with *schema* a missing one is empty."""
    path = f"{sf_dir}/{name}.parquet"
    if schema is not None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    A session that names none is refused, unless it runs on one machine: on a cluster a temporary folder of each
    executor's own would lose rows without an error.
    """
    at = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='postmere-')}"
        spark.conf.set(CHECKPOINT_KEY, at)
    return at.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write *df* to the shared folder and read it back: cuts lineage, survives the loss of executors.

    The files stay until :func:`release`, :func:`sweep` or the end of the Python process.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    if len(_WRITTEN) == 1 and not _ENDING:
        _ENDING.append(atexit.register(_end))
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: dict[str, list[str]] = {}
_ENDING: list = []


def _end() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        sweep(spark)


def sweep(spark: SparkSession) -> int:
    """Delete what :func:`materialize` wrote in this application, once its results are no longer needed; how many."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        drop_path(spark, path)
    return len(paths)


def release(*frames: DataFrame) -> None:
    """Delete the files of frames of :func:`materialize` that nothing reads any more, and the shuffle files of finished plans."""
    for df in frames:
        spark, gone = df.sparkSession, {f.rsplit("/", 2)[-2] for f in df.inputFiles()}
        for paths in _WRITTEN.values():
            for p in [p for p in paths if p.rsplit("/", 1)[-1] in gone]:
                paths.remove(p)
                drop_path(spark, p)
    if frames:
        frames[0].sparkSession.sparkContext._jvm.java.lang.System.gc()


def stored_bytes(spark: SparkSession, path: str) -> int:
    """The size of a file or folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, if there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def canonical(col) -> "F.Column":
    """A source name in its one spelling: outer white space off, lower case."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def with_columns(df: DataFrame, **types: str) -> DataFrame:
    """*df* with each named column, as a typed NULL where the table lacks it."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in have}) if set(types) - have else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, for functions that run in their Python."""
    import pathlib
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_postmere_sent", False):
        return
    package = pathlib.Path(__file__).resolve().parents[1]
    at = pathlib.Path(tempfile.mkdtemp(prefix="postmere-")) / "postmere.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(at))
    context._postmere_sent = True
