"""Bring raw frames to the snapshot schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..schema import ALIASES, COUNT_COLUMNS, DATE_COLUMNS, EXTRA_ALIASES, SNAPSHOT_SCHEMA


def canonicalize(
    df: DataFrame,
    aliases: Mapping[str, Sequence[str]] = ALIASES,
    extra_aliases: Mapping[str, Sequence[str]] | None = EXTRA_ALIASES,
) -> DataFrame:
    """Rename to canonical columns: of each ladder the first raw name that is present wins.

    The names in ``extra_aliases`` are tried only where the ladder gives nothing; pass None to
    leave them unread.
    """
    df = drop_repeated_columns(df)
    present = set(df.columns)
    chosen: dict[str, str] = {}
    for name, ladder in aliases.items():
        tried = list(ladder) + list((extra_aliases or {}).get(name, ()))
        first = next((raw for raw in tried if raw in present), None)
        if first is not None:
            chosen[name] = first
    kept = [c for c in df.columns if c not in chosen and c not in set(chosen.values())]
    return df.select(
        *[_named(raw).alias(name) for name, raw in chosen.items()], *[_named(c) for c in kept]
    )


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def drop_repeated_columns(df: DataFrame) -> DataFrame:
    """Of columns with the same name keep the first."""
    unique = [f"{c}#{i}" if c in df.columns[:i] else c for i, c in enumerate(df.columns)]
    return df.toDF(*unique).select(*[_named(c) for i, c in enumerate(unique) if c == df.columns[i]])


def conform(df: DataFrame, schema: T.StructType = SNAPSHOT_SCHEMA) -> DataFrame:
    """Project to ``schema``: absent columns become null, others are cast, surplus ones go.

    Text that does not parse as the wanted type becomes null.
    """
    single = drop_repeated_columns(df)
    out = []
    for f in schema.fields:
        if f.name not in single.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        have = single.schema[f.name].dataType
        value = _named(f.name)
        if isinstance(have, T.StringType) and isinstance(f.dataType, T.LongType):
            value = value.try_cast("double").try_cast("bigint")
        elif isinstance(have, T.StringType) and isinstance(f.dataType, T.TimestampType):
            value = F.try_to_timestamp(value)
        elif have != f.dataType:
            value = value.cast(f.dataType)
        out.append(value.alias(f.name))
    return single.select(*out)


def whole_count(value: Column) -> Column:
    """A count as bigint: numbers truncate toward 0; what is no number or does not fit is 0."""
    return F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def coerce_counts(df: DataFrame, cols: Sequence[str] = COUNT_COLUMNS) -> DataFrame:
    """Apply ``whole_count`` to the columns."""
    return df.withColumns({c: whole_count(F.col(c)) for c in cols})


def coerce_timestamps(df: DataFrame, cols: Sequence[str] = DATE_COLUMNS) -> DataFrame:
    """Texts and dates to timestamps (session clock UTC), null where they do not parse."""
    done = {}
    for c in cols:
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        done[c] = F.try_to_timestamp(F.col(c)) if is_text else F.col(c).cast("timestamp")
    return df.withColumns(done)


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows of all frames, matched by column name; columns a frame lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
