"""Datasets in a database: the methods of a snapshot table, over JDBC.

Spark reads the table (projections and predicates reach the database; the scan is split by ``_seq``) and writes rows to a stage
table of their own, in parallel. One transaction then carries them over, so readers see all of a change or none.
Schemas are kept in the table ``colstate_schemas``, since databases have no type for vectors: these are stored as JSON text.

There are no versions to go back to and no fragments; of two writers at a time the later one wins, row by row.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colstate.sources.snapshots import SEQ, Version

SCHEMAS = "colstate_schemas"
#: Drivers by the beginning of the URL; another one can be given.
DRIVERS = {"jdbc:postgresql:": "org.postgresql.Driver", "jdbc:derby:": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
_KINDS = {T.IntegerType: "INTEGER", T.LongType: "BIGINT", T.FloatType: "REAL", T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN"}


def jdbc_url(url: str) -> str:
    return url if url.startswith("jdbc:") else "jdbc:" + url


class JdbcTable:
    def __init__(self, spark: SparkSession, url: str, name: str, primary_key: str = "member_id", *, driver: str | None = None, splits: int = 8):
        self.spark, self.url, self.name, self.primary_key, self.splits = spark, jdbc_url(url), name, primary_key, splits
        self.driver = driver or next((d for start, d in DRIVERS.items() if self.url.startswith(start)), None)
        derby = self.url.startswith("jdbc:derby:")
        self.text = "VARCHAR(32672)" if derby else "TEXT"
        self.stage_text = "CLOB" if derby else "TEXT"  # what Spark writes NULL texts as
        self._cast: dict[str, set[str]] = {}  # by stage, columns that are cast to ``text`` when they are carried over
        self.path = f"{self.url}/{name}"

    # the database -----------------------------------------------------------------------------

    @contextmanager
    def _transaction(self):
        jvm = self.spark._jvm
        loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
        if self.driver:
            jvm.java.lang.Class.forName(self.driver, True, loader)
        con = jvm.java.sql.DriverManager.getConnection(self.url)
        con.setAutoCommit(False)
        try:
            yield con
            con.commit()
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()

    def _do(self, con, sql: str, *values) -> int:
        s = con.prepareStatement(sql)
        try:
            for i, v in enumerate(values, 1):
                s.setString(i, v)
            return s.executeUpdate()
        finally:
            s.close()

    def _ask(self, con, sql: str, *values) -> list[str]:
        """The first column of all rows; for few rows."""
        s, out = con.prepareStatement(sql), []
        try:
            for i, v in enumerate(values, 1):
                s.setString(i, v)
            rows = s.executeQuery()
            while rows.next():
                out.append(rows.getString(1))
        finally:
            s.close()
        return out

    def _has(self, con, table: str) -> bool:
        found = con.getMetaData().getTables(None, None, table, None)
        return found.next()

    @staticmethod
    def _q(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def _columns_sql(self, schema: T.StructType, cast: set[str] = frozenset()) -> str:
        kinds = [f"{self._q(f.name)} {self.stage_text if f.name in cast else _KINDS.get(type(f.dataType), self.text)}" for f in schema]
        return ", ".join([*kinds, f"{self._q(SEQ)} BIGINT"])

    def _keep_schema(self, con, schema: T.StructType) -> None:
        if not self._has(con, SCHEMAS):
            self._do(con, f'CREATE TABLE {self._q(SCHEMAS)} ("name" VARCHAR(200) NOT NULL PRIMARY KEY, "body" {self.text})')
        self._do(con, f'DELETE FROM {self._q(SCHEMAS)} WHERE "name" = ?', self.name)
        self._do(con, f'INSERT INTO {self._q(SCHEMAS)} VALUES (?, ?)', self.name, schema.json())

    def _grown(self, con, old: T.StructType, new: T.StructType) -> None:
        for f in new:
            if f.name not in old.names:
                self._do(con, f"ALTER TABLE {self._q(self.name)} ADD COLUMN {self._q(f.name)} {_KINDS.get(type(f.dataType), self.text)}")
        self._keep_schema(con, new)

    # reading ----------------------------------------------------------------------------------

    def version(self, number: int | None = None) -> Version | None:
        with self._transaction() as con:
            if not self._has(con, self.name):
                return None
            schema = T.StructType.fromJson(json.loads(self._ask(con, f'SELECT "body" FROM {self._q(SCHEMAS)} WHERE "name" = ?', self.name)[0]))
            n = int(self._ask(con, f"SELECT count(*) FROM {self._q(self.name)}")[0])
            top = self._ask(con, f"SELECT max({self._q(SEQ)}) FROM {self._q(self.name)}")[0]
        return Version(0, schema, ({"path": self.name, "rows": n},) if n else (), int(top) + 1 if top is not None else 0)

    def exists(self) -> bool:
        return self.version() is not None

    def read_version(self, v: Version, fragments: list[dict] | None = None) -> DataFrame:
        full = T.StructType([*v.schema.fields, T.StructField(SEQ, T.LongType())])
        if not v.fragments or fragments == []:
            return self.spark.createDataFrame([], full)
        reader = self.spark.read.format("jdbc").option("url", self.url).option("dbtable", self._q(self.name))
        reader = reader.option("partitionColumn", SEQ).option("lowerBound", 0).option("upperBound", max(1, v.next_seq)).option("numPartitions", self.splits)
        df = (reader.option("driver", self.driver) if self.driver else reader).load()
        as_is = lambda f: F.col(f.name).cast(f.dataType) if type(f.dataType) in _KINDS or f.dataType == T.StringType() else F.from_json(f.name, f.dataType)
        return df.select(*[as_is(f).alias(f.name) for f in full])

    def holding(self, v: Version, where: Column | None = None, keys: DataFrame | None = None) -> tuple[list[dict], list[dict]]:
        """All of the table: what a change isn't about is left alone by the database."""
        return list(v.fragments), []

    def _need(self) -> Version:
        if (v := self.version()) is None:
            raise FileNotFoundError(f"dataset {self.path} doesn't exist")
        return v

    def read(self, columns: list[str] | None = None, where: str | Column | None = None) -> DataFrame:
        df = self.read_version(self._need())
        if where is not None:
            df = df.filter(F.expr(where) if isinstance(where, str) else where)
        return df.select(*columns) if columns else df.drop(SEQ)

    def read_null_rows(self, column: str, extra: list[str] = ()) -> DataFrame:
        return self.read([column, *[c for c in extra if c != column]], F.col(column).isNull())

    def read_keys(self, keys: DataFrame, columns: list[str] | None = None) -> DataFrame:
        df = self.read_version(self._need()).join(keys.select(self.primary_key), self.primary_key, "left_semi")
        return df.select(*columns) if columns else df.drop(SEQ)

    def sample(self, n: int = 5) -> DataFrame:
        v = self.version()
        return self.spark.createDataFrame([], T.StructType([])) if v is None else self.read_version(v).orderBy(SEQ).limit(n).drop(SEQ)

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
        """NULLs of all columns in one statement of the database."""
        if not names:
            return {}
        self._need()
        with self._transaction() as con:
            one = lambda c: f"CAST(count(*) - count({self._q(c)}) AS CHAR(20))"
            told = self._ask(con, f"SELECT {' || '.join(map(one, names))} FROM {self._q(self.name)}")[0]
        return {c: int(told[20 * i : 20 * i + 20]) for i, c in enumerate(names)}

    def null_count(self, name: str) -> int:
        return self.null_counts([name])[name]

    def fragmentation(self) -> int:
        """Dead rows, as far as the database tells."""
        if not self.url.startswith("jdbc:postgresql:"):
            return 0
        with self._transaction() as con:
            told = self._ask(con, "SELECT n_dead_tup FROM pg_stat_user_tables WHERE relname = ?", self.name)
        return int(told[0] or 0) if told else 0

    def stats(self) -> dict:
        v = self.version()
        if v is None:
            return {"exists": False, "row_count": 0, "columns": [], "fragmentation": 0}
        return {"exists": True, "row_count": v.rows, "columns": v.schema.names, "fragmentation": self.fragmentation()}

    # writing ----------------------------------------------------------------------------------

    @contextmanager
    def _staged(self, df: DataFrame):
        """The rows in a table of their own, for the time of a change."""
        name = f"stage_{uuid.uuid4().hex[:20]}"
        plain = lambda f: F.col(f.name) if type(f.dataType) in _KINDS or f.dataType == T.StringType() else F.to_json(f.name)
        cast = {f.name for f in df.schema if type(f.dataType) not in _KINDS and f.name != self.primary_key} if self.stage_text != self.text else set()
        with self._transaction() as con:
            self._do(con, f"CREATE TABLE {self._q(name)} ({self._columns_sql(T.StructType([f for f in df.schema if f.name != SEQ]), cast)})")
        self._cast[self._q(name)] = cast
        try:
            writer = df.select(*[plain(f).alias(f.name) for f in df.schema]).write.format("jdbc").option("url", self.url).option("dbtable", self._q(name))
            (writer.option("driver", self.driver) if self.driver else writer).mode("append").save()
            yield self._q(name)
        finally:
            self._cast.pop(self._q(name))
            with self._transaction() as con:
                self._do(con, f"DROP TABLE {self._q(name)}")

    def _numbered(self, df: DataFrame, base: Version | None, order_by: list | None) -> DataFrame:
        if order_by:
            df = df.orderBy(*order_by)
        return df.withColumn(SEQ, F.lit(base.next_seq if base else 0).cast("long") + F.monotonically_increasing_id())

    def _ready(self, df: DataFrame) -> tuple[Version | None, T.StructType, list[str]]:
        """The version, made if the table is new, its schema, and the columns that it and ``df`` share."""
        base = self.version()
        schema = base.schema if base else T.StructType([T.StructField(f.name, f.dataType) for f in df.schema if f.name != SEQ])
        if base is None:
            with self._transaction() as con:
                self._do(con, f"CREATE TABLE {self._q(self.name)} ({self._columns_sql(schema)})")
                self._keep_schema(con, schema)
        return base, schema, [f.name for f in schema if f.name in df.columns]

    def _from(self, stage: str, c: str) -> str:
        return f"CAST(s.{self._q(c)} AS {self.text})" if c in self._cast[stage] else f"s.{self._q(c)}"

    def _insert(self, con, stage: str, names: list[str], more: str = "") -> None:
        given = ", ".join(self._from(stage, c) for c in names)
        self._do(con, f"INSERT INTO {self._q(self.name)} ({', '.join(map(self._q, names))}) SELECT {given} FROM {stage} s {more}")

    def append(self, df: DataFrame, order_by: list | None = None, rows_per_fragment: int | None = None) -> Version:
        base, _, given = self._ready(df)
        with self._staged(self._numbered(df.select(*given), base, order_by)) as stage, self._transaction() as con:
            self._insert(con, stage, [*given, SEQ])
        return self._need()

    def upsert(self, df: DataFrame, on_update: str = "invalidate", order_by: list | None = None) -> Version:
        if on_update not in ("invalidate", "preserve"):
            raise ValueError(f"unknown on_update: {on_update}")
        pk, t = self._q(self.primary_key), self._q(self.name)
        base, _, given = self._ready(df)
        source = self._numbered(df.select(*given), base, order_by)
        source = source.groupBy(self.primary_key).agg(F.max_by(F.struct(*[c for c in given if c != self.primary_key], SEQ), SEQ).alias("r"))
        with self._staged(source.select(self.primary_key, "r.*")) as stage, self._transaction() as con:
            if on_update == "invalidate":
                self._do(con, f"DELETE FROM {t} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE s.{pk} = {t}.{pk})")
                self._insert(con, stage, [*given, SEQ])
            else:
                self._merge(con, stage, self.primary_key, [c for c in given if c != self.primary_key])
                self._insert(con, stage, [*given, SEQ], f"WHERE NOT EXISTS (SELECT 1 FROM {t} t WHERE t.{pk} = s.{pk})")
        return self._need()

    def _merge(self, con, stage: str, key: str, names: list[str]) -> None:
        sets = ", ".join(f"{self._q(c)} = {self._from(stage, c)}" for c in names)
        if sets:
            self._do(con, f"MERGE INTO {self._q(self.name)} t USING {stage} s ON t.{self._q(key)} = s.{self._q(key)} WHEN MATCHED THEN UPDATE SET {sets}")

    def add_column(self, column: str, kind: T.DataType) -> Version:
        base = self._need()
        if column not in base.schema.names:
            with self._transaction() as con:
                self._grown(con, base.schema, T.StructType([*base.schema.fields, T.StructField(column, kind)]))
        return self._need()

    def merge_column(self, delta: DataFrame, column: str, keep_unmatched: bool = False) -> Version:
        """Attach or replace a column by primary key; of equal keys the largest value counts. Rows without a match get NULL,
        or keep their value."""
        base, pk = self.add_column(column, delta.schema[column].dataType), self.primary_key
        d = delta.groupBy(pk).agg(F.max(column).alias(column)).withColumn(SEQ, F.lit(0).cast("long"))
        with self._staged(d) as stage, self._transaction() as con:
            if not keep_unmatched and column in base.schema.names:
                self._do(con, f"UPDATE {self._q(self.name)} SET {self._q(column)} = NULL")
            self._merge(con, stage, pk, [column])
        return self._need()

    def delete_rows(self, where: str | Column) -> int:
        """Rows are found by Spark, so predicates mean the same as elsewhere, and deleted by ``_seq``."""
        base, t = self._need(), self._q(self.name)
        gone = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        with self._staged(self.read_version(base).where(gone).select(SEQ)) as stage, self._transaction() as con:
            return self._do(con, f"DELETE FROM {t} WHERE {self._q(SEQ)} IN (SELECT {self._q(SEQ)} FROM {stage})")

    def replace_rows(self, where: str | Column, df: DataFrame, order_by: list | None = None) -> Version:
        base, schema, given = self._ready(df)
        gone = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
        old = self.read_version(base).where(gone).select(SEQ)
        with self._staged(old) as stage_old, self._staged(self._numbered(df.select(*given), base, order_by)) as stage, self._transaction() as con:
            self._do(con, f"DELETE FROM {self._q(self.name)} WHERE {self._q(SEQ)} IN (SELECT {self._q(SEQ)} FROM {stage_old})")
            self._insert(con, stage, [*given, SEQ])
        return self._need()

    def replace_all(self, base: Version, df: DataFrame, schema: T.StructType, beside: list[dict] = ()) -> Version:
        """Rows that were computed from ``base``: their columns are set where ``_seq`` is the same."""
        names = [c for c in schema.names if c != self.primary_key]
        with self._staged(df.select(*names, SEQ)) as stage, self._transaction() as con:
            self._grown(con, base.schema, schema)
            self._merge(con, stage, SEQ, names)
        return self._need()

    def compact(self, threshold: int = 20, target_rows: int = 1_000_000) -> bool:
        """Let the database clean up if it has more than ``threshold`` dead rows."""
        if self.fragmentation() <= threshold:
            return False
        con = self.spark._jvm.java.sql.DriverManager.getConnection(self.url)
        try:  # not within a transaction
            self._do(con, f"VACUUM ANALYZE {self._q(self.name)}")
        finally:
            con.close()
        return True

    def drop(self) -> None:
        with self._transaction() as con:
            if self._has(con, self.name):
                self._do(con, f"DROP TABLE {self._q(self.name)}")
                self._do(con, f'DELETE FROM {self._q(SCHEMAS)} WHERE "name" = ?', self.name)
