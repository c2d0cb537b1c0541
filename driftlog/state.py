"""Small tables of the engine's own state, in versions that are written whole."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from driftlog.session import remove_path

#: Seconds for which an old version stays, for results that are read later than they were asked for.
KEEP = 3600.0


class Table:
    """Metadata, a row for each chunk, sidecar or predicate at most. A reader of one version isn't disturbed by the next."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str):
        self.spark, self.path, self.schema = spark, f"{root}/state/{name}", schema
        self.since: dict[int, float] = {}
        self.look()

    def look(self) -> None:
        """Takes notice of versions that others wrote or removed."""
        whole = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v=*/_SUCCESS")
        found = whole.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).globStatus(whole) or []
        numbers = {int(str(f.getPath().getParent().getName())[2:]) for f in found}
        self.since = {n: self.since.get(n, time.time()) for n in sorted(numbers)}

    @property
    def version(self) -> int:
        return max(self.since, default=-1)

    def read(self) -> DataFrame:
        self.look()
        if self.version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={self.version}")

    def write(self, rows: DataFrame) -> None:
        columns = self.spark.createDataFrame([], self.schema).columns
        self.look()
        number = self.version + 1
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.path}/v={number}")
        self.since[number] = time.time()

    def prune(self, keep: float = KEEP) -> None:
        """Removes versions that a newer one replaced so long ago."""
        for number in [n for n, at in self.since.items() if n != self.version and self.since[n + 1 if n + 1 in self.since else self.version] < time.time() - keep]:
            remove_path(self.spark, f"{self.path}/v={number}")
            del self.since[number]
