"""Saved results: snapshots, reports, stores and manifests as partitioned Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "number long, generation string"


def write_snapshot(tables: dict[str, DataFrame], path: str, analysis_id: str) -> None:
    """Write named tables under one analysis id; an existing id is replaced, others stay."""
    for name, df in tables.items():
        (
            df.withColumn("analysis_id", F.lit(analysis_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("analysis_id")
            .parquet(f"{path}/{name}")
        )


def read_snapshot(spark: SparkSession, path: str, name: str, analysis_id: str) -> DataFrame:
    """One table of an analysis; only its partition is listed and read."""
    return spark.read.parquet(f"{path}/{name}").filter(F.col("analysis_id") == analysis_id)


def add_originals(store_path: str, texts: DataFrame) -> None:
    """Append texts the store does not hold yet, by digest prefix."""
    texts.write.mode("append").partitionBy("prefix").parquet(store_path)


class Generations:
    """A table kept as whole generations, one of them current.

    A generation is written in full before a row naming it is appended to the pointers, which is one
    commit; readers take the generation that the newest pointer names. So they see the old or the new
    one, also when a job ends between the steps. What an unfinished job left is dropped by the next sweep.
    One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def current(self) -> str | None:
        """Name of the current generation; none before the first."""
        newest = self._pointers(1)
        return newest[0][1] if newest else None

    def read(self) -> DataFrame:
        """The current generation."""
        name = self.current()
        if name is None:
            raise ValueError(f"no generation at {self.path}")
        return self.spark.read.parquet(self._folder(name))

    def write(self, df: DataFrame) -> str:
        """Write a generation without making it current; return its name."""
        name = uuid.uuid4().hex
        df.write.parquet(self._folder(name))
        return name

    def switch(self, name: str) -> None:
        """Make a written generation the current one."""
        newest = self._pointers(1)
        number = newest[0][0] + 1 if newest else 1
        self.spark.createDataFrame([(number, name)], POINTER).coalesce(1).write.mode("append").parquet(self._pointer_path())

    def replace(self, df: DataFrame) -> str:
        """Write ``df`` as the new current generation; it may be read from the old one."""
        name = self.write(df)
        self.switch(name)
        return name

    def sweep(self, keep: int = 2) -> list[str]:
        """Drop all but the latest ``keep`` generations, those never made current included; return their names.

        Keeping the one before the current lets readers that began on it finish.
        """
        held = {name for _, name in self._pointers(max(1, keep))}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/generations")
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        dropped = []
        for entry in system.listStatus(root) if system.exists(root) else []:
            name = entry.getPath().getName()
            if name not in held:
                system.delete(entry.getPath(), True)
                dropped.append(name)
        return sorted(dropped)

    def _folder(self, name: str) -> str:
        return f"{self.path}/generations/{name}"

    def _pointer_path(self) -> str:
        return f"{self.path}/pointers"

    def _pointers(self, n: int) -> list[tuple[int, str]]:
        """Numbers and names of the ``n`` latest generations, the newest first."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._pointer_path())
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema(POINTER).parquet(self._pointer_path()).orderBy(F.desc("number")).limit(n)
        return [(r["number"], r["generation"]) for r in rows.collect()]
