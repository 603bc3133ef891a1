"""Row leases: who works on which rows, for how long.

Leases are rows of a snapshot table (key, owner, expires), so any Spark session can check a whole
batch with a join. Taking a lease isn't re-entrant, not even for the same owner. A lost race for
a version (``Conflict``) is tried again on the newest version.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colstate.sources.snapshots import Conflict, SnapshotTable

TTL_SECONDS = 300


class Leases:
    def __init__(self, spark: SparkSession, path: str, ttl: float = TTL_SECONDS, clock=time.time):
        self.spark, self.ttl, self.clock = spark, ttl, clock
        self.table = SnapshotTable(spark, path, "key")

    @staticmethod
    def _key(workflow: str):
        return F.concat(F.lit(f"lock:{workflow}:"), F.col("id").cast("string"))

    def _live(self) -> DataFrame:
        if not self.table.exists():
            return self.spark.createDataFrame([], "key string, owner string, expires double")
        return self.table.read(where=F.col("expires") > self.clock())

    def ping(self) -> bool:
        """Whether the folder of leases can be read and written."""
        try:
            self.table.probe()
        except Exception:  # noqa: BLE001  whatever the file system says, leases aren't to be had
            return False
        return True

    def locked(self, workflow: str, ids: DataFrame) -> DataFrame:
        """Those of ``ids (id)`` that anyone holds, with the owner."""
        return ids.withColumn("key", self._key(workflow)).join(self._live(), "key").select("id", "owner")

    def _retry(self, change) -> None:
        for attempt in range(20):
            try:
                return change()
            except Conflict:
                time.sleep(0.05 * (attempt + 1))
        raise Conflict(f"no commit on {self.table.path} after 20 attempts")

    def acquire(self, workflow: str, ids: DataFrame, owner: str, ttl: float | None = None) -> tuple[DataFrame, DataFrame]:
        """Take what is free; (taken, already held), both ``id``."""
        out: list[DataFrame] = []

        def change() -> None:
            now = self.clock()
            asked = ids.select(F.col("id").cast("string").alias("id")).distinct().withColumn("key", self._key(workflow))
            live = self._live()
            free = asked.join(live, "key", "left_anti")
            new = free.select("key", F.lit(owner).alias("owner"), F.lit(now + (self.ttl if ttl is None else ttl)).alias("expires"))
            base = self.table.version()
            if base is None:
                self.table.append(new)
            else:
                kept = self.table.read_version(base).where(F.col("expires") > now)
                fresh = self.table._numbered(new, base, None)
                self.table.replace_all(base, kept.unionByName(fresh), base.schema)
            stamp = F.lit(now + (self.ttl if ttl is None else ttl))
            mine = self.table.read(where=(F.col("owner") == owner) & (F.col("expires") == stamp)).select("key")
            # what the committed version has as ours is taken, the rest was held
            out[:] = [asked.join(mine, "key", "left_semi").select("id"), asked.join(mine, "key", "left_anti").select("id")]

        self._retry(change)
        return out[0], out[1]

    def _of(self, workflow: str, ids: DataFrame, owner: str):
        keys = ids.select(self._key(workflow).alias("key")).distinct().withColumn("_asked", F.lit(True))
        base = self.table.version()
        rows = self.table.read_version(base).join(keys, "key", "left") if base else None
        mine = F.coalesce(F.col("_asked") & (F.col("owner") == owner) & (F.col("expires") > self.clock()), F.lit(False))
        return base, rows, mine

    def release(self, workflow: str, ids: DataFrame, owner: str) -> int:
        """Give back what ``owner`` holds; how many."""
        found = 0

        def change() -> None:
            nonlocal found
            base, rows, mine = self._of(workflow, ids, owner)
            if base is not None:
                found = rows.where(mine).count()
                self.table.replace_all(base, rows.where(~mine).drop("_asked"), base.schema)

        self._retry(change)
        return found

    def extend(self, workflow: str, ids: DataFrame, owner: str, ttl: float | None = None) -> int:
        """Prolong what ``owner`` still holds; how many."""
        found = 0

        def change() -> None:
            nonlocal found
            base, rows, mine = self._of(workflow, ids, owner)
            if base is not None:
                found = rows.where(mine).count()
                until = F.lit(self.clock() + (self.ttl if ttl is None else ttl))
                self.table.replace_all(base, rows.withColumn("expires", F.when(mine, until).otherwise(F.col("expires"))).drop("_asked"), base.schema)

        self._retry(change)
        return found
