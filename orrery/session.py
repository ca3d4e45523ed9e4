"""Session helpers: tables of a data folder, and tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The table ``name`` of a data folder, reduced to ``columns`` where given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns is not None else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its files give fewer partitions than there are (a small table); otherwise as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session gets a temporary folder of its
    own and any other session is refused, because its executors would not share such a folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(where)
        atexit.register(_remove, spark, where)
    return where


def _remove(spark: SparkSession, where: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the cluster's own cleaning of that folder removes the rest
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts lineage, survives the loss of executors,
    and lets several consumers share one computation. The files are removed when the session's process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/orrery/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)


_SHIPPED: set[str] = set()


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``f``, with this package sent to the session's executors first, once a session."""

    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sc = spark.sparkContext
        if sc.applicationId not in _SHIPPED:
            root = Path(__file__).parent
            folder = tempfile.mkdtemp(prefix="orrery-code-")  # the driver's own; it serves the file to the executors
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            sc.addPyFile(shutil.make_archive(f"{folder}/orrery", "zip", root.parent, root.name))
            _SHIPPED.add(sc.applicationId)
        return f(spark, sf_dir)

    return run


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if a count finds at most ``rows`` rows in it; otherwise ``df`` as it is, so that the
    join is a shuffled one. ``df`` should be cheap to count, such as a written table."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
