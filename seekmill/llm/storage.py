"""Intermediate tables in the shared folder that the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode, where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="seekmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    _made.append((spark, made))
    return made


def new_path(spark: SparkSession) -> str:
    path = f"{shared_dir(spark)}/seekmill-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: its lineage ends in
    replicated storage, so a lost executor costs no recomputation of what went before."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each after as many underscores as it takes for ``df`` to have no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(table: DataFrame) -> None:
    """Deletes a table that ``materialize`` made and nothing reads any more."""
    folders = {f.rpartition("/")[0].rpartition("/")[2] for f in table.inputFiles()}
    for spark, path in [x for x in _made if x[1].rpartition("/")[2] in folders]:
        _delete(spark, path)
        _made.remove((spark, path))


def release() -> None:
    """Deletes every intermediate table of this process; results that still read them break."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except (ConnectionError, AttributeError):  # the JVM is gone when the process ends
            return
        except Py4JError:  # this folder stays
            continue


atexit.register(release)
