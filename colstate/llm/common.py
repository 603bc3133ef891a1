"""What the training-data operators share: the shared folder, written tables, stable hashes.

Intermediate results go to the folder that the session names in ``spark.checkpoint.dir``; every
driver and executor sees it. A folder of the own machine is used only with ``local[...]`` masters.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import sys
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that all machines of the cluster share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="colstate-"))


def _drop(path: str) -> None:
    fs, p = filesystem(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder of a run under the shared folder; it goes when this Python process ends."""
    path = f"{shared_dir(spark)}/colstate/{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(_quiet, path)
    return path


def _quiet(path: str) -> None:
    try:
        _drop(path)
    except OSError:
        pass


def written(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    if partitions:
        df = df.coalesce(partitions)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Schemes that Hadoop and Arrow call by different names.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "webhdfs": "hdfs"}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, on the driver or an executor."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")


def commit_bytes(uri: str, *parts: bytes) -> None:
    """Write under a temporary name, then rename: readers see the whole file or none."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(temp, compression=None) as out:
        for part in parts:
            out.write(part)
    fs.move(temp, path)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def tune(spark: SparkSession) -> None:
    """Arrow batches of 128 whole texts, so that a Python worker's memory stays bounded."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "128")


_TRIM_THRESHOLD, _MMAP_THRESHOLD = -1, -3  # of glibc's mallopt


def give_back() -> None:
    """What this process has freed goes back to the system, and from now on blocks of 8 MB or more as soon as they are
    freed: glibc raises that size up to 32 MB by itself, and a worker keeps what its largest arrays took. With blocks of
    1 MB, getting those of each batch anew took a seventh more CPU seconds."""
    libc = ctypes.CDLL(None) if sys.platform == "linux" else None
    if hasattr(libc, "malloc_trim"):
        for which in (_TRIM_THRESHOLD, _MMAP_THRESHOLD):
            libc.mallopt(which, 8 << 20)
        libc.malloc_trim(0)


def text_of(column: str = "text"):
    """The column as text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ranges of an id -----------------------------------------------------------------------------

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
#: Points that a range's bytes are measured by.
_POINTS = 16


def beginning(text: Column) -> Column:
    """The first 7 bytes of a text as a number, in the order of texts."""
    return F.conv(F.hex(F.rpad(F.substring(F.encode(F.substring(text, 1, 7), "UTF-8"), 1, 7), 7, b"\0")), 16, 10).cast("long")


def place(id_: Column, tie: Column) -> Column:
    """A row's place in the order of ids, as two numbers: null ids come first, rows of equal ids in the order of ``tie``."""
    first = F.coalesce(id_, F.lit(_LEAST))
    # a null id shares its number with the least id there is; that one's rows come after it
    return F.struct(first.alias("id"), F.when(id_ == _LEAST, _MOST).otherwise(tie).alias("tie"))


class Ranges:
    """Ranges of places of about equal bytes. ``ends`` are the last places of all ranges but the last one; each is that of a row."""

    def __init__(self, spark: SparkSession, ends: list[tuple[int, int]]):
        self.ends = ends
        self._shared = spark.sparkContext.broadcast(np.array(ends, np.int64).reshape(-1, 2).T)  # 16 bytes a range

    def __len__(self) -> int:
        return len(self.ends) + 1

    def of(self, where: Column) -> Column:
        """``struct(part, last)``: the number of a place's range, and whether the place is that range's end."""
        if not self.ends:
            return F.struct(F.lit(0).alias("part"), F.lit(False).alias("last"))
        shared = self._shared

        @F.pandas_udf("part int, last boolean")
        def find(ids: pd.Series, ties: pd.Series) -> pd.DataFrame:
            at, among = shared.value
            x, y = ids.to_numpy(), ties.to_numpy()
            part, until = np.searchsorted(at, x), np.searchsorted(at, x, "right")
            last = np.zeros(len(x), bool)
            for v in np.unique(x[until > part]):  # ids in which ranges end
                i = np.nonzero(x == v)[0]
                a, b = part[i[0]], until[i[0]]
                part[i] = a + np.searchsorted(among[a:b], y[i])
                last[i] = np.isin(y[i], among[a:b])
            return pd.DataFrame({"part": part.astype(np.int32), "last": last})

        return find(where["id"], where["tie"])


def ranges_of(rows: DataFrame, range_bytes: int) -> Ranges:
    """Cut the rows ``(at, nbytes)`` into ranges of about ``range_bytes``; ``at`` is a place().

    Each row counts as so many points as its bytes have a 16th of a range, a part of a point by a hash; what has points is
    sorted and summed in parallel, and a range ends at every 16th point. The ends depend on the rows
    alone, not on how they were dealt out; the driver gets a row for each range.
    """
    spark = rows.sparkSession
    luck = F.shiftrightunsigned(F.xxhash64("at", F.lit(23)), 11) * F.lit(2.0**-53)
    points = F.floor(F.col("nbytes") / max(1.0, range_bytes / _POINTS) + luck)
    drawn = rows.select("at", points.alias("points")).where("points > 0")
    drawn = drawn.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "at")
    drawn = written(drawn.withColumn("task", F.spark_partition_id()), work_dir(spark, "ranges") + "/points")
    sums = sorted((r["task"], r["n"]) for r in drawn.groupBy("task").agg(F.sum("points").alias("n")).collect())
    before, have = [], 0  # a row a task
    for task, n in sums:
        before.append((task, have))
        have += n
    if have <= _POINTS:
        return Ranges(spark, [])
    drawn = drawn.join(F.broadcast(spark.createDataFrame(before, "task int, have bigint")), "task")
    until = F.col("have") + F.sum("points").over(Window.partitionBy("task").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    step = lambda c: F.floor(c / _POINTS)
    ends = drawn.withColumn("until", until).where((step(F.col("until")) > step(F.col("until") - F.col("points"))) & (F.col("until") < have))
    return Ranges(spark, sorted({(r["at"]["id"], r["at"]["tie"]) for r in ends.select("at").collect()}))


# 64-bit mixing -------------------------------------------------------------------------------

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers that scatters their bits."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + np.uint64((salt * int(_GOLD)) & 0xFFFFFFFFFFFFFFFF))
