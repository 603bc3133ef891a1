"""Where records come from: synthetic profiles, protobuf batches, ids that are free."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colstate.functions import text
from colstate.sources.snapshots import SnapshotTable

FIRST = ["Ada", "Alan", "Barbara", "Claude", "Donald", "Edsger", "Frances", "Grace", "Hedy", "Ivan", "John", "Katherine", "Leslie", "Mary"]
LAST = ["Allen", "Backus", "Curry", "Dahl", "Engelbart", "Floyd", "Goldberg", "Hopper", "Iverson", "Jackson", "Knuth", "Liskov"]
SKILLS = ["ada", "awk", "bash", "c", "cobol", "docker", "elm", "fortran", "go", "haskell", "java", "kotlin", "lisp", "ml", "perl", "python", "ruby", "rust", "scala", "sql"]
REPOS = ["parser", "compiler", "scheduler", "linker", "shell", "editor", "kernel", "planner", "solver", "tracer", "router", "cache"]


def _pick(words: list[str], seed: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), (F.floor(F.rand(seed) * len(words)) + 1).cast("int"))


def _some(words: list[str], least: int, most: int, seed: int) -> Column:
    """So many distinct words, in random order."""
    mixed = F.transform(
        F.array_sort(F.transform(F.array(*map(F.lit, words)), lambda w: F.struct(F.xxhash64(w, F.col("id"), F.lit(seed)).alias("k"), w.alias("w")))),
        lambda x: x["w"],
    )
    return F.slice(mixed, F.lit(1), (F.floor(F.rand(seed) * (most - least + 1)) + least).cast("int"))


def linkedin(spark: SparkSession, n: int, offset: int = 0, seed: int = 1) -> DataFrame:
    """``member_id, name, skills``: blanks around names, 2 to 6 skills, half of them shouted."""
    joined = F.array_join(_some(SKILLS, 2, 6, seed + 2), ", ")
    return spark.range(offset, offset + n).select(
        F.format_string("member_%06d", "id").alias("member_id"),
        F.concat(F.lit("  "), _pick(FIRST, seed), F.lit(" "), _pick(LAST, seed + 1), F.lit("  ")).alias("name"),
        F.when(F.rand(seed + 3) > 0.5, F.upper(F.regexp_replace(joined, ",", " , "))).otherwise(joined).alias("skills"),
    )


def github(spark: SparkSession, n: int, offset: int = 0, seed: int = 11) -> DataFrame:
    """``github_username, name, repos``: blanks around names, 1 to 5 distinct repositories."""
    first, last = _pick(FIRST, seed), _pick(LAST, seed + 1)
    return spark.range(offset, offset + n).select("id", first.alias("f"), last.alias("l"), _some(REPOS, 1, 5, seed + 2).alias("r")).select(
        F.lower(F.format_string("%s_%s_%d", "f", "l", "id")).alias("github_username"),
        F.concat(F.lit("  "), "f", F.lit(" "), "l", F.lit("  ")).alias("name"),
        F.array_join("r", ", ").alias("repos"),
    )


def github_overlapping(spark: SparkSession, n: int, profiles: DataFrame, overlap: int, seed: int = 11) -> DataFrame:
    """``overlap`` rows with the names of ``profiles``, the rest with names of their own."""
    shared = profiles.orderBy("member_id").limit(overlap).select("name")
    shared = shared.select(F.lower(F.concat(F.lit("gh_"), F.regexp_replace(F.trim("name"), " ", "_"), F.lit("_"), F.monotonically_increasing_id())).alias("github_username"), "name")
    shared = shared.withColumn("id", F.xxhash64("github_username")).withColumn("repos", F.array_join(_some(REPOS, 1, 5, seed + 3), ", ")).drop("id")
    rest = github(spark, max(0, n - overlap), overlap, seed)
    return shared.unionByName(rest.withColumn("github_username", F.concat(F.lit("gh_unique_"), "github_username")))


GENERATORS = {"member_id": linkedin, "github_username": github}


def generate(spark: SparkSession, primary_key: str, n: int, offset: int = 0, seed: int = 1) -> DataFrame:
    """The generator for a primary key; KeyError for others."""
    return GENERATORS[primary_key](spark, n, offset, seed)


def next_id(table: SnapshotTable) -> int:
    """One above the largest number at the end of a primary key; without any, the number of rows; 0 if absent."""
    if not table.exists():
        return 0
    row = table.read([table.primary_key]).agg(F.max(text.number_suffix(F.col(table.primary_key))).alias("m"), F.count(F.lit(1)).alias("n")).first()
    return row["m"] + 1 if row["m"] is not None else row["n"]


def id_range(batch: DataFrame, key: str, order: Column) -> DataFrame:
    """First and last key of a batch in the order of submission."""
    return batch.agg(F.min_by(key, order).alias("first_id"), F.max_by(key, order).alias("last_id"))


# protobuf ---------------------------------------------------------------------------------------

#: Message types and their fields, all strings, numbered from 1.
MESSAGES = {
    "Profile": ["member_id", "name", "skills"],
    "GithubProfile": ["github_username", "name", "repos"],
    "UserData": ["id", "name", "location"],
}
BATCHES = {"ProfileBatch": "Profile", "GithubProfileBatch": "GithubProfile"}
BATCH_OF_KEY = {"member_id": "ProfileBatch", "github_username": "GithubProfileBatch"}


@cache
def message_class(name: str):
    """A message class, from descriptors that are built here."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    proto = descriptor_pb2.FileDescriptorProto(name="colstate.proto", package="colstate", syntax="proto3")
    for message, fields in MESSAGES.items():
        m = proto.message_type.add(name=message)
        for k, f in enumerate(fields, 1):
            m.field.add(name=f, number=k, type=9, label=1)
    for batch, message in BATCHES.items():
        proto.message_type.add(name=batch).field.add(name="profiles", number=1, type=11, label=3, type_name=f".colstate.{message}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(proto)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName(f"colstate.{name}"))


def from_protobuf(bodies: DataFrame, primary_key: str, column: str = "body") -> DataFrame:
    """The records of serialised batches, a batch in each row; unset fields are empty strings."""
    batch = BATCH_OF_KEY[primary_key]
    fields = MESSAGES[BATCHES[batch]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = message_class(batch)
        for b in batches:
            rows = [p for body in b.column(0).to_pylist() if body is not None for p in cls.FromString(body).profiles]
            yield pa.RecordBatch.from_arrays([pa.array([getattr(r, f) for r in rows], pa.string()) for f in fields], names=fields)

    return bodies.select(column).mapInArrow(run, ", ".join(f"{f} string" for f in fields))


def users_from_protobuf(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Single records ``id, name, location``, a message in each row."""
    fields = MESSAGES["UserData"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls = message_class("UserData")
        for b in batches:
            rows = [cls.FromString(body) for body in b.column(0).to_pylist() if body is not None]
            yield pa.RecordBatch.from_arrays([pa.array([getattr(r, f) for r in rows], pa.string()) for f in fields], names=fields)

    return bodies.select(column).mapInArrow(run, "id string, name string, location string")


def enriched(users: DataFrame) -> DataFrame:
    """Records with ``summary``, ``status`` and the time in epoch seconds."""
    return users.select(
        "*", text.enrich(F.col("name"), F.col("location")).alias("summary"), F.lit("processed").alias("status"),
        F.current_timestamp().cast("double").alias("timestamp"),
    )
