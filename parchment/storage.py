"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[tuple[SparkSession, str]] = []
_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder on one
    machine (local mode, as in tests), and an error on a cluster, whose executors do not see the driver's folders."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="parchment-")
    return _FALLBACK[app]


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parchment-{tag}-{uuid.uuid4().hex}"
    if not _OWN:
        atexit.register(_clean)
    _OWN.append((spark, path))
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def _clean() -> None:
    for spark, path in _OWN:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may be gone, or the folder
        pass


def release(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing will read again."""
    _OWN.remove((df.sparkSession, df._shared_path))
    _delete(df.sparkSession, df._shared_path)
