"""Versioned snapshot tables: Parquet fragments and a manifest for each version.

A version is a JSON file that lists the fragments and the schema; it is written to a temporary file
and renamed to its number if that is free, so a commit is atomic and of two writers at a time one
gets ``Conflict``. Fragments are never changed: a mutation finds those that hold rows it is about, by a scan of the columns
that it needs for that, writes these anew and commits a list in which the others stay as they are.
A column that the schema has and a fragment lacks reads as NULL.

Rows carry ``_seq``, their order of arrival; it identifies rows inside the engine (appends don't make
primary keys unique) and isn't shown to users.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "_seq"
#: Fixed value: bytes of a partition that is to be collected. The driver gets partitions in chunks of 1 MB at most, and a heap under
#: 2 GB gives two regions of 1 MB to each full chunk; chunks below half a region share regions.
COLLECTED = 384 << 10


class Conflict(RuntimeError):
    """Another writer has committed this version."""


@dataclass(frozen=True)
class Version:
    number: int
    schema: T.StructType
    fragments: tuple[dict, ...]
    next_seq: int

    @property
    def rows(self) -> int:
        return sum(f["rows"] for f in self.fragments)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, primary_key: str = "member_id"):
        self.spark, self.path, self.primary_key = spark, path.rstrip("/"), primary_key
        self._jvm_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jvm_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # versions ---------------------------------------------------------------------------------

    def _versions(self) -> list[int]:
        folder = self._jvm_path(f"{self.path}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def exists(self) -> bool:
        return bool(self._versions())

    def version(self, number: int | None = None) -> Version | None:
        """The newest version, or one by its number; None if there is none."""
        found = self._versions()
        if not found or (number is not None and number not in found):
            return None
        number = found[-1] if number is None else number
        stream = self._fs.open(self._jvm_path(f"{self.path}/_versions/{number:012d}.json"))
        try:
            d = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return Version(number, T.StructType.fromJson(d["schema"]), tuple(d["fragments"]), d["next_seq"])

    def _commit(self, base: Version | None, schema: T.StructType, fragments: list[dict], free: int = 0) -> Version:
        next_seq = max(free, base.next_seq if base else 0)
        number = base.number + 1 if base else 0
        new = Version(number, schema, tuple(f for f in fragments if f["rows"]), next_seq)
        body = {"version": number, "schema": schema.jsonValue(), "fragments": list(new.fragments), "next_seq": next_seq}
        folder = f"{self.path}/_versions"
        target, temp = self._jvm_path(f"{folder}/{number:012d}.json"), self._jvm_path(f"{folder}/.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm.org.apache.hadoop.fs
        how = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        how[0] = jvm.Options.Rename.NONE  # fails if the target is there: one writer wins
        try:
            jvm.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf()).rename(temp, target, how)
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            raise Conflict(f"version {number} of {self.path} exists") from e
        return new

    # reading ----------------------------------------------------------------------------------

    def read_version(self, v: Version, fragments: list[dict] | None = None) -> DataFrame:
        """All rows of a version (or of some fragments of it) with ``_seq``; the version's schema pads columns that a fragment lacks."""
        full = T.StructType([*v.schema.fields, T.StructField(SEQ, T.LongType())])
        chosen = v.fragments if fragments is None else fragments
        if not chosen:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(*[f"{self.path}/{f['path']}" for f in chosen])

    def holding(self, v: Version, where: Column | None = None, keys: DataFrame | None = None) -> tuple[list[dict], list[dict]]:
        """The fragments that hold rows for which ``where`` is true or whose primary key is among ``keys``, and the others.

        The scan reads the columns that these need; the driver gets names of fragments, which a version lists anyway.
        """
        if not v.fragments:
            return [], []
        rows = self.read_version(v).withColumn("_file", F.col("_metadata.file_path"))
        if where is not None:
            rows = rows.where(where)
        if keys is not None:
            rows = rows.select(self.primary_key, "_file").join(keys.select(self.primary_key), self.primary_key, "left_semi")
        found = {"/".join(r["_file"].split("/")[-3:]) for r in rows.select("_file").distinct().collect()}
        return [f for f in v.fragments if f["path"] in found], [f for f in v.fragments if f["path"] not in found]

    def read(self, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
        """Rows of the newest version; projection and predicate reach the Parquet scan."""
        df = self.read_version(self._need())
        if where is not None:
            df = df.filter(F.expr(where) if isinstance(where, str) else where)
        return df.select(*columns) if columns else df.drop(SEQ)

    def read_to_collect(self, columns: list[str], row_bytes: int) -> DataFrame:
        """``read`` in partitions so small that a driver with a small heap can collect all of them. ``row_bytes``: of a row in
        Spark's format. What exceeds ``spark.driver.maxResultSize`` can't be collected, and stays in the partitions of its files."""
        v = self._need()
        df, size = self.read_version(v), v.rows * row_bytes
        limit = self.spark.sparkContext._jsc.sc().conf().getSizeAsBytes("spark.driver.maxResultSize", "1g") or 1 << 30
        if COLLECTED < size <= limit:
            df = df.repartition(-(-size // COLLECTED), SEQ)
        return df.select(*columns)

    def read_null_rows(self, column: str, extra: list[str] = ()) -> DataFrame:
        return self.read([column, *[c for c in extra if c != column]], F.col(column).isNull())

    def read_keys(self, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """Rows whose primary key is among ``keys``: a semi-join, not a list of literals."""
        df = self.read_version(self._need()).join(keys.select(self.primary_key), self.primary_key, "left_semi")
        return df.select(*columns) if columns else df.drop(SEQ)

    def sample(self, n: int = 5) -> DataFrame:
        """The first rows in the order of arrival."""
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], T.StructType([]))
        return self.read_version(v).orderBy(SEQ).limit(n).drop(SEQ)

    def _need(self) -> Version:
        if (v := self.version()) is None:
            raise FileNotFoundError(f"dataset {self.path} doesn't exist")
        return v

    # statistics -------------------------------------------------------------------------------

    def columns(self) -> list[str]:
        v = self.version()
        return v.schema.names if v else []

    def column_exists(self, name: str) -> bool:
        return name in self.columns()

    def count_rows(self) -> int:
        v = self.version()
        return v.rows if v else 0

    def null_counts(self, names: list[str]) -> dict[str, int]:
        """NULLs of all columns in one scan."""
        if not names:
            return {}
        row = self.read(names).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]).first()
        return row.asDict()

    def null_count(self, name: str) -> int:
        return self.null_counts([name])[name]

    def fragmentation(self) -> int:
        v = self.version()
        return len(v.fragments) if v else 0

    def stats(self) -> dict:
        v = self.version()
        if v is None:
            return {"exists": False, "row_count": 0, "columns": [], "fragmentation": 0}
        return {"exists": True, "row_count": v.rows, "columns": v.schema.names, "fragmentation": len(v.fragments)}

    # writing ----------------------------------------------------------------------------------

    def _write(self, df: DataFrame) -> tuple[list[dict], int]:
        """Write rows (with ``_seq``) as new fragments, a fragment for each file; these, and the first
        number above all of ``_seq``: both are found while writing."""
        folder = f"data/{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.max(SEQ).alias("top")).write.parquet(f"{self.path}/{folder}")
        files = [s.getPath().getName() for s in self._fs.listStatus(self._jvm_path(f"{self.path}/{folder}"))]
        files = sorted(n for n in files if n.endswith(".parquet"))
        free = (seen.get["top"] if seen.get["top"] is not None else -1) + 1
        if len(files) <= 1:
            return [{"path": f"{folder}/{n}", "rows": seen.get["n"]} for n in files], free
        # of several files the footers tell the rows
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        rows = {r["f"]: r["count"] for r in self.spark.read.parquet(f"{self.path}/{folder}").groupBy(name.alias("f")).count().collect()}
        return [{"path": f"{folder}/{n}", "rows": rows.get(n, 0)} for n in files], free

    def _numbered(self, df: DataFrame, base: Version | None, order_by: list | None) -> DataFrame:
        """``df`` with ``_seq`` above all that the table has, in the given order."""
        if order_by:
            df = df.orderBy(*order_by)
        return df.withColumn(SEQ, F.lit(base.next_seq if base else 0).cast("long") + F.monotonically_increasing_id())

    def _aligned(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        """The schema's columns in its order: missing ones as typed NULLs, unknown ones dropped."""
        have = set(df.columns)
        return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

    def append(self, df: DataFrame, order_by: list | None = None, rows_per_fragment: int | None = None) -> Version:
        """Add rows, without looking for duplicates; creates the dataset if absent."""
        base = self.version()
        schema = base.schema if base else T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        rows = self._numbered(self._aligned(df, schema), base, order_by)
        if rows_per_fragment:
            n = rows.count()
            rows = rows.repartitionByRange(max(1, -(-n // rows_per_fragment)), SEQ)
        new, free = self._write(rows)
        return self._commit(base, schema, [*(base.fragments if base else ()), *new], free)

    def _rewrite(self, base: Version | None, df: DataFrame | None, schema: T.StructType | None = None, beside: list[dict] = ()) -> Version:
        """Commit ``df`` (with ``_seq``; None: no rows) and the fragments ``beside`` it as the next version."""
        new, free = self._write(df) if df is not None else ([], 0)
        return self._commit(base, schema or base.schema, [*beside, *new], free)

    def upsert(self, df: DataFrame, on_update: str = "invalidate", order_by: list | None = None) -> Version:
        """Replace rows by primary key; of equal keys in ``df`` the last counts.

        ``invalidate``: old rows of the keys go, columns that ``df`` lacks become NULL and are derived again.
        ``preserve``: columns that ``df`` lacks keep their values.
        """
        if on_update not in ("invalidate", "preserve"):
            raise ValueError(f"unknown on_update: {on_update}")
        base, pk = self.version(), self.primary_key
        schema = base.schema if base else T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])
        given = [f.name for f in schema if f.name in df.columns]
        source = self._numbered(df.select(*given), base, order_by)
        source = source.groupBy(pk).agg(F.max_by(F.struct(*[c for c in given if c != pk], SEQ), SEQ).alias("r")).select(pk, "r.*")
        if base is None:
            return self._rewrite(None, self._with_seq(source, schema), schema)
        touched, rest = self.holding(base, keys=source)
        target = self.read_version(base, touched)
        if on_update == "invalidate":
            kept = target.join(source.select(pk), pk, "left_anti").select(*schema.names, SEQ)
            return self._rewrite(base, kept.unionByName(self._with_seq(source, schema)), beside=rest)
        t, s = target.alias("t"), source.withColumn("_given", F.lit(True)).alias("s")
        both = t.join(s, F.col(f"t.{pk}") == F.col(f"s.{pk}"), "full")
        new = F.col("s._given").isNotNull()
        pick = lambda c: (F.when(new, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")) if c in given else F.col(f"t.{c}")).alias(c)
        out = both.select(*map(pick, schema.names), F.coalesce(f"t.{SEQ}", f"s.{SEQ}").alias(SEQ))
        return self._rewrite(base, out, beside=rest)

    def _with_seq(self, df: DataFrame, schema: T.StructType) -> DataFrame:
        return self._aligned(df, T.StructType([*schema.fields, T.StructField(SEQ, T.LongType())]))

    def merge_column(self, delta: DataFrame, column: str, keep_unmatched: bool = False) -> Version:
        """Attach or replace a column by primary key; of equal keys the largest value counts. Rows without a match get NULL,
        or keep their value: then fragments without a match aren't written."""
        base, pk = self._need(), self.primary_key
        kind = delta.schema[column].dataType
        d = delta.groupBy(pk).agg(F.max(column).alias("_new"), F.lit(True).alias("_hit"))
        had = column in base.schema.names
        same = had and base.schema[column].dataType == kind
        touched, rest = self.holding(base, keys=d) if keep_unmatched and (same or not had) else (list(base.fragments), [])
        rows = self.read_version(base, touched).join(d, pk, "left")
        old = F.col(column).cast(kind) if had and keep_unmatched else F.lit(None).cast(kind)
        rows = rows.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(old))
        fields = [T.StructField(f.name, kind if f.name == column else f.dataType) for f in base.schema]
        schema = T.StructType(fields if had else [*fields, T.StructField(column, kind)])
        return self._rewrite(base, rows.select(*schema.names, SEQ) if touched else None, schema, rest)

    def add_column(self, column: str, kind: T.DataType) -> Version:
        """A column of NULLs: just the schema changes, no file is written."""
        base = self._need()
        if column in base.schema.names:
            return base
        return self._commit(base, T.StructType([*base.schema.fields, T.StructField(column, kind)]), list(base.fragments))

    def delete_rows(self, where: str | Column) -> int:
        """Delete rows for which the predicate is true (not NULL); their number."""
        base = self._need()
        gone = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        touched, rest = self.holding(base, gone)
        new = self._rewrite(base, self.read_version(base, touched).filter(~gone) if touched else None, beside=rest)
        return base.rows - new.rows

    def replace_rows(self, where: str | Column, df: DataFrame, order_by: list | None = None) -> Version:
        """Delete by predicate and add rows, in one commit."""
        base = self._need()
        gone = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        new = self._numbered(self._aligned(df, base.schema), base, order_by)
        touched, rest = self.holding(base, gone)
        return self._rewrite(base, self.read_version(base, touched).filter(~gone).unionByName(new), beside=rest)

    def replace_all(self, base: Version, df: DataFrame, schema: T.StructType, beside: list[dict] = ()) -> Version:
        """Commit rows (with ``_seq``) that were computed from ``base``, and the fragments ``beside`` them that stay;
        Conflict if it isn't the newest any more."""
        return self._rewrite(base, df.select(*schema.names, SEQ), schema, beside)

    def compact(self, threshold: int = 20, target_rows: int = 1_000_000) -> bool:
        """Rewrite into few fragments if there are more than ``threshold``."""
        base = self.version()
        if base is None or len(base.fragments) <= threshold:
            return False
        n = max(1, min(threshold, -(-base.rows // target_rows)))
        self._rewrite(base, self.read_version(base).coalesce(n))
        return True

    def probe(self) -> None:
        """Write, read and delete a file of the table's folder; raises what the file system raises."""
        path = self._jvm_path(f"{self.path}/_probe-{uuid.uuid4().hex}")
        self._fs.create(path, False).close()
        self._fs.open(path).close()
        self._fs.delete(path, False)

    def drop(self) -> None:
        self._fs.delete(self._jvm_path(self.path), True)

    def vacuum(self) -> int:
        """Delete versions but the newest, and files that it doesn't list; the number of files deleted."""
        v = self.version()
        if v is None:
            return 0
        live = {f["path"] for f in v.fragments}
        gone = 0
        for number in self._versions()[:-1]:
            self._fs.delete(self._jvm_path(f"{self.path}/_versions/{number:012d}.json"), False)
        data = self._jvm_path(f"{self.path}/data")
        if self._fs.exists(data):
            for folder in self._fs.listStatus(data):
                name = folder.getPath().getName()
                for f in self._fs.listStatus(folder.getPath()):
                    if f.getPath().getName().endswith(".parquet") and f"data/{name}/{f.getPath().getName()}" not in live:
                        self._fs.delete(f.getPath(), False)
                        gone += 1
        return gone

