"""Tables that cut lineage: parquet in the folder that the cluster shares.

``spark.checkpoint.dir`` names that folder and is read from the session. Only
where it is unset and all runs in one process (``local`` masters: tests, a
laptop) a folder is made, and set, here; a cluster must name one. Tables go when
nothing reads them any more (``drop``), all others when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder's URI."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get().rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="docweft-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Scratch:
    """Named tables of one run of an operator, under a folder of its own."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/docweft/{label}-{uuid.uuid4().hex}"
        self._n, self._bound = 0, False

    def place(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n:04d}-{name}"

    def keep(self, df: DataFrame, name: str, at: str | None = None) -> DataFrame:
        """Write ``df`` (to ``at``, which then stays) and read it back: its lineage ends here, and losing an executor loses nothing."""
        at = at or self.place(name)
        df.write.option("compression", "zstd").parquet(at)
        if not self._bound and at.startswith(self.path):
            self._bound = self._system(self.path).deleteOnExit(self._path(self.path))
        return self.open(at, df.schema)

    def open(self, at: str, schema) -> DataFrame:
        """A table that was kept at ``at``."""
        back = self.spark.read.schema(schema).parquet(at)
        back._docweft_place = at
        return back

    def finished(self, pattern: str) -> list[str]:
        """Places of whole tables that match a pattern, in order."""
        found = self._system(pattern).globStatus(self._path(f"{pattern}/_SUCCESS"))
        return sorted(str(x.getPath().getParent()) for x in found or [])

    def drop(self, df: DataFrame) -> None:
        """Delete a table made by keep() that nothing reads any more."""
        at = getattr(df, "_docweft_place", None)
        if at:
            self.delete(at)

    def delete(self, at: str) -> None:
        self._system(at).delete(self._path(at), True)

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _system(self, at: str):
        return self._path(at).getFileSystem(self.spark._jsc.hadoopConfiguration())
