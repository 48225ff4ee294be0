"""The folder that all executors share, and cutting lineage in it."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in local mode, where it is unset, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="seekmill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/seekmill-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for rounds that replace one another: ``discard`` deletes it."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more; others stay."""
    for table in tables:
        session = table.sparkSession
        jvm, folder = session.sparkContext._jvm, shared_folder(session)
        for name in {f.rpartition("/")[0].rpartition("/")[2] for f in table.inputFiles()}:
            if name.startswith("seekmill-"):
                path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
                path.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over all cores where it has fewer splits than there are cores, as one row group has. Rows are dealt by
    their number in a split: dealt without a key they would all be sorted first, and a task would hold its split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    dealt = (F.monotonically_increasing_id() % cores).cast("int")
    return df.repartitionById(cores, dealt) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's source to the Python workers, once an application: they may start elsewhere."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="seekmill-")) / "seekmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "seekmill").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(target))
