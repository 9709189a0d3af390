"""Views that are refreshed on a schedule, and the versions of a streamed result."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RefreshableView:
    """REFRESH EVERY n SECONDS [OFFSET m] [APPEND] [DEPENDS ON ...]: each refresh is a written version; readers see the last, or all with append.

    Times are seconds; a refresh falls due at each multiple of `every`, plus `offset`, and after those that it depends on. `versions`: those written before.
    """

    def __init__(self, spark: SparkSession, path: str, query: Callable[[], DataFrame], every: int, offset: int = 0, append: bool = False, depends: Sequence[RefreshableView] = (), versions: Sequence[int] = ()) -> None:
        self.spark, self.path, self.query = spark, path, query
        self.every, self.offset, self.append, self.depends = every, offset, append, depends
        self.versions = list(versions)

    def refresh(self, now: int) -> bool:
        """Writes the version due at `now`; False where it is there already, or another that it depends on is behind."""
        due = (now - self.offset) // self.every * self.every + self.offset
        if self.versions and self.versions[-1] >= due:
            return False
        if any(not d.versions or d.versions[-1] < (now - d.offset) // d.every * d.every + d.offset for d in self.depends):
            return False
        self.query().write.mode("overwrite").parquet(f"{self.path}/version={due}")  # a retried refresh counts once
        self.versions.append(due)
        return True

    def read(self) -> DataFrame:
        """The rows of the versions that are seen; an error before the first refresh."""
        seen = self.versions if self.append else self.versions[-1:]
        if not seen:
            raise ValueError("the view hasn't been refreshed yet")
        return self.spark.read.parquet(*(f"{self.path}/version={v}" for v in seen))


def watched(result: DataFrame, out: str) -> DataFrame:
    """WATCH: every version, from 1, of a streamed aggregate's whole result, with its number in `_version`."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/data/_number={number + 1}")

    query = result.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = result.sparkSession.read.parquet(f"{out}/data")
    return rows.select(F.col("_number").cast("long").alias("_version"), *(c for c in rows.columns if c != "_number"))
