"""Session settings and shared scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

APP_NAME = "telewarden"
_LOCAL_SCRATCH = "spark.telewarden.localScratch"


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(APP_NAME)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the only session setting results depend on: event times are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def small_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A few rows of the driver's as a table of the plan's own, for which no Python worker is started, as it is for rows in a list."""
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    cells = {f.name: pa.array([r[i] for r in rows]) for i, f in enumerate(fields)}
    return spark.createDataFrame(pa.table(cells)).select(*[F.col(f.name).cast(f.dataType) for f in fields])


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Only where a session in a single JVM names none (unit tests) is a local folder made; on a cluster that is an error, as executors
    would write to their own disks.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or spark.conf.get(_LOCAL_SCRATCH, None)
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="telewarden-")
        spark.conf.set(_LOCAL_SCRATCH, named)
    return named


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    _made.append(f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables that this process has made, and say how many. Call it once no result that reads them is needed."""
    deleted = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        deleted += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return deleted


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` below the shared folder and go on from the table.

    What follows reads only the columns it needs, sees true sizes, and
    a lost executor costs no recomputation of what came before.
    """
    location = scratch_path(df.sparkSession, label)
    df.write.parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)
