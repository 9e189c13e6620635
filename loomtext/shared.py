"""What every operator needs: tables, shipping of this package to executors, durable cuts of lineage, text schemas."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegralType

_SHIPPED: set[str] = set()
#: Nodes of a printed plan that may shuffle.
_SHUFFLES = re.compile(r"^[\s:+-]*(?:Join|Aggregate|Window|Deduplicate|Distinct)\b", re.M)


def ship(spark: SparkSession | None = None) -> None:
    """Make this package importable in Python workers on other machines; once for each application."""
    spark = spark or SparkSession.active()
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    where = Path(tempfile.mkdtemp(prefix="loomtext-")) / "loomtext.zip"  # the driver serves it to executors
    with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(where))
    _SHIPPED.add(app)


def vectorised(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """A function of pandas series as a function of columns, wherever its workers run."""

    def made(f: Callable) -> Callable[..., Column]:
        ship()
        return F.pandas_udf(kind)(f)

    return made


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.  Where that is unset: on one machine a folder of
    our own, on a cluster one in the default file system, if that is shared; else an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if where is None:
        if sc.master.startswith("local"):
            where = "file://" + os.path.join(tempfile.gettempdir(), "loomtext-checkpoints")
        elif (root := sc._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).startswith("file:"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        else:
            where = f"{root.rstrip('/')}/tmp/loomtext-checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def durable(df: DataFrame) -> DataFrame:
    """The rows written once as a Parquet table in the shared folder: cuts lineage, survives lost executors, and later
    reads prune columns.  The table is removed when the driver ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/loomtext-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return spark.read.parquet(path)


def unit_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with their text; duplicate rows of one key are still in it."""
    u = table(spark, sf_dir, "units")
    return u.select("doc_id", "unit_id", F.array_join("segments", "").alias("text"))


def size_limit(spark: SparkSession, sf_dir: str, kind: str) -> dict:
    """The row of size_limits for a kind of item; a fixed table of two rows."""
    row = table(spark, sf_dir, "size_limits").where(F.col("item_kind") == kind).first()
    if row is None:
        raise ValueError(f"size_limits has no row for {kind!r}")
    return row.asDict()


def _as_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, (IntegralType, DecimalType))


def sent(df: DataFrame, column: str, name: str) -> Column:
    """A key on its way to Python: whole numbers go as text, since pandas would turn them to floats where one is null."""
    c = F.col(column)
    return (c.cast("string") if _as_text(df, column) else c).alias(name)


def sent_type(df: DataFrame, column: str) -> str:
    return "string" if _as_text(df, column) else df.schema[column].dataType.simpleString()


def returned(df: DataFrame, column: str, name: str) -> Column:
    """The key ``name`` back from Python, in the type and by the name that it has in ``df``."""
    return (F.col(name).cast(df.schema[column].dataType) if _as_text(df, column) else F.col(name)).alias(column)


def spread(scan: DataFrame) -> DataFrame:
    """Rows on their way to Python or other costly functions, over all cores where they come in fewer tasks: from a few
    small files, or from a small shuffle, whose partitions are merged; else as they are.  Judged by the plan and the bytes
    of the files it reads: nothing is run."""
    spark = scan.sparkSession
    cores = spark.sparkContext.defaultParallelism
    plan = scan._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    read = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    if read >= cores * spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes():
        return scan
    shuffled = _SHUFFLES.search(plan.toString()) is not None
    return scan.repartition(cores) if shuffled or len(scan.inputFiles()) < cores else scan
