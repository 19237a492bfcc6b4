"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The six characters that part words.
SPACES = " \t\n\x0b\x0c\r"
# A word is a longest stretch without them.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf}/{name}.parquet")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to ``value``, which is worked out once however often ``use`` refers to it.

    Inside the lambda of a higher-order function an outer expression would be worked out again for
    each element; the variable of a one-element ``transform`` holds it instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_array(text: Column) -> Column:
    """The words of a text in order; none for null, empty and blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def raw(column: str) -> Column:
    """The bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows apart: rows that agree in id and text are one document, whatever else they hold."""
    return F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), raw(text), F.col(text).isNull())


def chunks(length: int, size: int) -> Iterable[tuple[int, int]]:
    """Consecutive (start, end) ranges that bound the memory spent on one long text."""
    return ((a, min(a + size, length)) for a in range(0, length, size))
