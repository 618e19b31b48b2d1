"""Session settings and the staging helper that iterative jobs use to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings the jobs rely on. Shuffle width is left to the caller and to adaptive coalescing.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Arrow batches carry whole files, so keep them short in rows and bytes.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    # Lets filters reach the walk of the tree source.
    "spark.sql.python.filterPushdown.enabled": "true",
}

_local_roots: dict[str, str] = {}


def build_session(app: str = "treeloom", master: str | None = None, **conf: str) -> SparkSession:
    """Create or reuse a session with the settings above; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """Shared folder for staged tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder; on a cluster a machine-local path
    would be lost with its executor, so an unset folder is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app_id = spark.sparkContext.applicationId
    if app_id not in _local_roots:
        _local_roots[app_id] = tempfile.mkdtemp(prefix="treeloom-stage-")
    return _local_roots[app_id]


class Stages:
    """Tables of one schema written round by round and read back together with a single scan."""

    def __init__(self, spark: SparkSession, folders: list[str] | None = None):
        """``folders`` names columns whose values get a folder each, so that a reader can leave others out."""
        self.spark = spark
        self.folders = folders or []
        self.paths: list[str] = []
        self.schema = None

    def write(self, df: DataFrame, measure: Column | None = None) -> int:
        """Write a round as Parquet under the shared folder.

        Returns its row count, or another aggregate, taken while writing.
        """
        path = f"{stage_root(self.spark)}/treeloom/{self.spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
        rows = Observation()
        count = F.count(F.lit(1)) if measure is None else measure
        df.observe(rows, count.alias("n")).write.partitionBy(*self.folders).parquet(path)
        self.paths.append(path)
        self.schema = df.schema
        return rows.get["n"]

    def last(self) -> DataFrame:
        """The latest round."""
        return self.spark.read.schema(self.schema).parquet(self.paths[-1])

    def all(self) -> DataFrame:
        """All rounds."""
        if self.folders:  # each round is a table of its own with these folders
            return reduce(DataFrame.unionByName, (self.spark.read.schema(self.schema).parquet(p) for p in self.paths))
        return self.spark.read.schema(self.schema).parquet(*self.paths)

    def compact(self) -> None:
        """Rewrite all rounds as one, so that a long loop does not read ever more folders."""
        whole = Stages(self.spark, self.folders)
        whole.write(self.all())
        self.paths = whole.paths


def stage_counted(df: DataFrame, measure: Column | None = None) -> tuple[DataFrame, int]:
    """Write ``df`` under the shared folder; return it read back, and its row count.

    The result has no lineage, survives executor loss and carries true file sizes, which lets
    the planner choose broadcast or sort-merge from facts.
    """
    stages = Stages(df.sparkSession)
    size = stages.write(df, measure)
    return stages.last(), size


def stage(df: DataFrame) -> DataFrame:
    """``stage_counted`` without the count."""
    return stage_counted(df)[0]
