"""Tables between the steps of an operator, in the folder that all machines share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from webloom.session import shared_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: For the jobs inside an operator: shuffle files go when a job ends, not when the driver happens to collect
#: garbage, and Python gets few whole texts at once.
INSIDE = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}


@contextmanager
def _inside(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in INSIDE}
    for k, v in INSIDE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Workspaces opened inside tidied().
OPENED: ContextVar[list | None] = ContextVar("opened", default=None)


@contextmanager
def tidied():
    """Deletes at its end what operators called inside it have written, but for what the caller's own workspace holds."""
    token = OPENED.set([])
    try:
        yield
    finally:
        for ws in OPENED.get():
            ws.close()
        OPENED.reset(token)


class Workspace:
    """Written tables of one operator call. A table cuts the lineage: a lost executor costs a reread, not a rerun.

    ``save`` writes and rereads; ``drop`` deletes early. What is left goes when the application ends,
    since the returned frame still reads it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/webloom-{uuid.uuid4().hex}"
        self.at: dict[int, str] = {}
        path, fs = self._fs(self.root)
        fs.deleteOnExit(path)
        if (opened := OPENED.get()) is not None:
            opened.append(self)

    def _fs(self, at: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        with _inside(self.spark):
            df.write.option("compression", "zstd").parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self.at[id(out)] = at
        return out

    def collect(self, df: DataFrame) -> list:
        """Rows of a frame whose size the caller has bounded."""
        with _inside(self.spark):
            return df.collect()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if at := self.at.pop(id(t), None):
                path, fs = self._fs(at)
                fs.delete(path, True)

    def close(self) -> None:
        path, fs = self._fs(self.root)
        fs.delete(path, True)
        self.at.clear()
