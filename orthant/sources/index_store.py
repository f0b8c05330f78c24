"""Where an index lives: a folder of Parquet tables, with a table that says which version counts."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names (spark.checkpoint.dir); a local one only where it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not given.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = given.get() if given.isDefined() else os.path.join(tempfile.gettempdir(), "orthant-indexes")
    return f"{base}/index-{uuid.uuid4().hex}"


class Store:
    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or shared_folder(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def write(self, df: DataFrame, name: str, mode: str = "error") -> None:
        df.write.mode(mode).parquet(f"{self.path}/{name}")

    def changes(self, name: str, last: int) -> DataFrame:
        """The rows of a table of numbered changes, up to the last that counts, with their number as `change`."""
        return self.table(name).where(F.col("change") <= last)

    def delete(self, keys: DataFrame, meta: dict, commit: bool) -> None:
        """Change meta["changes"] + 1: these keys go."""
        meta["changes"] += 1
        self.write(keys, f"deleted-{meta['version']}/change={meta['changes']}", "overwrite")
        meta["deletes"] = [*self.deletes(meta), [meta["version"], meta["changes"]]]
        if commit:
            self.save_meta(meta)

    def deletes(self, meta: dict) -> list[list[int]]:
        """(version, change) of the deletions from the version that counts."""
        return [d for d in meta.get("deletes", []) if d[0] == meta["version"]]

    def live(self, rows: DataFrame, meta: dict) -> DataFrame:
        """rows (key, change, ...) without those that a later change deleted."""
        if not self.deletes(meta):
            return rows
        gone = self.changes(f"deleted-{meta['version']}", meta["changes"]).groupBy("key").agg(F.max("change").alias("until")).alias("g")
        return rows.alias("r").join(gone, (F.col("r.key") == F.col("g.key")) & (F.col("r.change") < F.col("g.until")), "left_anti")

    def _folder(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save_meta(self, meta: dict) -> None:
        """Writes a new file beside the old ones and then gives it its name, so a failure leaves the state before."""
        place, files = self._folder()
        files.mkdirs(place)
        number = max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(place) if f.getPath().getName().endswith(".json")), default=0) + 1
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        new = path(f"{self.path}/meta/{number:012d}.new")
        out = files.create(new, True)
        out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        out.close()
        if not files.rename(new, path(f"{self.path}/meta/{number:012d}.json")):
            raise OSError(f"the state of the index in {self.path} can't be saved")

    def load_meta(self) -> dict:
        place, files = self._folder()
        last = max((f.getPath() for f in files.listStatus(place) if f.getPath().getName().endswith(".json")), key=lambda p: p.getName())
        opened = files.open(last)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8"))
        finally:
            opened.close()

    def drop(self) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
