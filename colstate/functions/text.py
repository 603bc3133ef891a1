"""Scalar functions as column expressions; Python string semantics where Spark's differ."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VECTOR = T.ArrayType(T.FloatType())
DIMENSIONS = 64


def strip(c: Column) -> Column:
    """White space of all kinds off both ends; ``trim`` takes blanks only."""
    return F.regexp_replace(c, F.lit(r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"), F.lit(""))


def title(c: Column) -> Column:
    """Each stretch of cased letters with a capital first; ``initcap`` looks for blanks only."""
    letters = r"\p{Lu}\p{Ll}\p{Lt}"
    pieces = F.regexp_extract_all(c, F.lit(rf"([{letters}]+|[^{letters}]+)"), F.lit(1))
    capital = lambda x: F.concat(F.initcap(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))
    return F.array_join(F.transform(pieces, capital), "")


def clean_name(c: Column) -> Column:
    return title(strip(c))


@F.pandas_udf(T.StringType())
def clean_name_strict(s: pd.Series) -> pd.Series:
    """For texts with characters that Python and the JVM title differently (circled letters, ordinals, ligatures)."""
    return s.map(lambda x: None if x is None else x.strip().title())


def clean_skills(c: Column) -> Column:
    """Comma-separated tokens: stripped, lower case, distinct, sorted; empty ones are kept."""
    tokens = F.transform(F.split(c, ",", -1), lambda t: F.lower(strip(t)))
    return F.array_join(F.array_sort(F.array_distinct(tokens)), ", ")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def embedding_seed(*columns: Column) -> Column:
    """The first 8 hex digits of the MD5 of the joined texts, as a number."""
    return F.conv(F.substring(F.md5(F.concat(*map(text_or_empty, columns))), 1, 8), 16, 10).cast("long")


@F.pandas_udf(VECTOR)
def vector_of_seed(seed: pd.Series) -> pd.Series:
    """64 normal numbers of numpy's legacy generator, scaled to length 1 in single precision."""

    def one(s: int) -> np.ndarray:
        v = np.random.RandomState(s).randn(DIMENSIONS).astype(np.float32)
        return v / np.linalg.norm(v)

    return seed.map(one)


def mock_embedding(*columns: Column) -> Column:
    return vector_of_seed(embedding_seed(*columns))


def norm(c: Column) -> Column:
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def enrich(name: Column, place: Column) -> Column:
    return F.format_string("Enriched %s from %s", name, place)


def number_suffix(c: Column) -> Column:
    """The digits after the last underscore as a number, NULL if there are none."""
    return F.when(c.rlike(r"_[0-9]+$"), F.regexp_extract(c, r"_([0-9]+)$", 1).cast("long"))


def table_name(name: str) -> str:
    """A dataset's name as a table name."""
    return name.replace("-", "_").replace("/", "_").replace(".", "_")
