"""Session settings and the shared work folder.

The library never calls ``broadcast()`` on something it has not counted, never
checkpoints to executor-local disk, and keeps every written table below one
shared folder, so a lost executor costs a task retry and nothing else.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

CHECKPOINT_DIR = "spark.checkpoint.dir"
BROADCAST_ROWS = "spark.cohortry.broadcastRows"
HOT_KEY_ROWS = "spark.cohortry.hotKeyRows"
SEGMENTS_PER_PASS = "spark.cohortry.segmentsPerPass"
TASK_ROWS = "spark.cohortry.taskRows"
DRIVER_RULES = "spark.cohortry.driverRules"

_DEFAULTS = {
    BROADCAST_ROWS: 1_000_000,
    HOT_KEY_ROWS: 5_000_000,
    SEGMENTS_PER_PASS: 50,
    TASK_ROWS: 500_000,
    DRIVER_RULES: 1_000,
}


def session(app: str = "cohortry", **conf: object) -> SparkSession:
    """A session with the settings the plans were designed for.

    Shuffle sizing is left to AQE: it coalesces small shuffle partitions and splits
    skewed ones, so no partition count is baked in here.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def int_setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


@cache
def _local_base(application: str) -> str:
    return tempfile.mkdtemp(prefix="cohortry-")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only a local-mode session may fall back to a temporary folder of this machine.
    """
    base = spark.conf.get(CHECKPOINT_DIR, None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
        base = _local_base(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/cohortry/{purpose}-{uuid.uuid4().hex}"


def written(table: DataFrame, purpose: str) -> DataFrame:
    """The same rows, stored once in the shared folder.

    Cuts the lineage of something several jobs read: a lost executor costs a re-read of
    files instead of a recomputation, and the row count comes from the footers.
    """
    spark = table.sparkSession
    path = work_dir(spark, purpose)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def dealt(table: DataFrame, rows: int, *keys: str) -> DataFrame:
    """The table dealt by ``keys`` to so many tasks that each gets a bounded share of ``rows``, those that it is to meet included.

    What one task sorts and merges then does not grow with them. Few rows are left to AQE; of many, the tasks are not
    fewer than Spark's own, as a join takes the larger number of its two sides.
    """
    spark = table.sparkSession
    bound = int_setting(spark, TASK_ROWS)
    if rows <= 4 * bound:
        return table
    return table.repartition(max(-(-rows // bound), int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def small_table(spark: SparkSession, rows: Iterable[tuple], schema: str | StructType) -> DataFrame:
    """Metadata rows (definitions, commits) as a local relation, read without a job."""
    struct = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = [dict(zip(struct.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(records, schema=to_arrow_schema(struct)), struct)


@cache
def ship(context: SparkContext) -> None:
    """Send this package to the workers where they would not find it by themselves."""
    root = Path(__file__).parents[1]
    known = [Path(p).resolve() for p in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if p]
    if root.resolve() in known or root.suffix == ".zip":
        return
    packed = f"{tempfile.mkdtemp(prefix='cohortry-')}/cohortry.zip"
    with zipfile.ZipFile(packed, "w") as archive:
        for path in [root / "cohortry", *(root / "cohortry").rglob("*")]:
            if path.suffix == ".py" or path.is_dir() and path.name != "__pycache__":
                archive.write(path, path.relative_to(root))
    context.addPyFile(packed)
