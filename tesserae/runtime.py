"""Session, shared folder and lineage cuts.

Iterative operators cut their lineage by writing a table into the folder the cluster shares
(``spark.checkpoint.dir``) and reading it back.  Such a table survives the loss of any executor,
and its rows are fixed once written, so a recomputed task can never see another version of them.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_cleaned: set[str] = set()


def session(app: str = "tesserae", cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the engine expects; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TESSERAE_DRIVER_MEMORY", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset a folder of our own, and only where all tasks
    run on this machine: executors elsewhere could not read it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(discard_all, spark)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if app not in _own_dir:
            _own_dir[app] = tempfile.mkdtemp(prefix="tesserae-")
            atexit.register(_remove_local, _own_dir[app])
        base = "file://" + _own_dir[app]
    return f"{base.rstrip('/')}/tesserae-{app}"


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def hadoop_path(spark: SparkSession, path: str):
    """(Hadoop path, its file system): looks at any storage Spark can read, not only at local files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop_path(spark, path)
    return bool(fs.exists(p))


def remove(spark: SparkSession, path: str) -> None:
    p, fs = hadoop_path(spark, path)
    fs.delete(p, True)


def discard_all(spark: SparkSession) -> None:
    """Delete every table that :func:`cut` wrote for this application; at the latest when Python ends.  Results of
    queries are lazy and may read them until then."""
    try:
        remove(spark, shared_dir(spark))
    except Exception:  # the session has ended: there is nothing left to ask
        pass


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table; see :func:`discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._tesserae_path = path
    return back


def discard(*dfs: DataFrame) -> None:
    """Delete tables written by :func:`cut` that no later plan reads."""
    for df in dfs:
        path = getattr(df, "_tesserae_path", None)
        if path:
            remove(df.sparkSession, path)


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{table}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """A scanned table over all cores where its files give fewer tasks (a small table in one file); a table of
    many files stays as it is.  Only for plain scans: the number of their partitions is known without a job."""
    n, want = df.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism
    return df if n >= want else df.repartition(want)


def utc_month(ms):
    """``YYYY-MM`` of an epoch-millisecond column, whatever the session's time zone."""
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days), "yyyy-MM")


def vault_of(path):
    """First segment of a note's path."""
    return F.substring_index(path, "/", 1)
