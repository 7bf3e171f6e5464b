"""Session set-up and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the local bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("loomgraph")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the session names it.

    Where ``spark.checkpoint.dir`` is unset a local master gets a temporary folder,
    kept in the setting; any other master is refused, as executors on other
    machines could not read what one of them wrote.
    """
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        got = f"file://{tempfile.mkdtemp(prefix='loomgraph-')}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The result has no lineage before the files, so that the loss of an executor
    costs no more than reading them again.  ``release`` removes the files;
    what is left goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def materialise_all(parts: Iterable[DataFrame], split_by: str) -> DataFrame:
    """``materialise`` for tables of one schema, written one after the other into one table laid out by ``split_by``."""
    path = schema = None
    for df in parts:
        if path is None:
            spark, schema = df.sparkSession, df.schema
            path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
            _written.append((spark, path))
        df.write.mode("append").partitionBy(split_by).parquet(path)
    return spark.read.schema(schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/loomgraph-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def release(df: DataFrame) -> None:
    """Remove the files under a result of ``materialise`` that is done with."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        for entry in [x for x in _written if name.endswith(x[1].rpartition("/")[2])]:
            _remove(*entry)
            _written.remove(entry)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for entry in _written:
        try:
            _remove(*entry)
        except Exception:  # noqa: BLE001  the JVM may have gone first
            return
