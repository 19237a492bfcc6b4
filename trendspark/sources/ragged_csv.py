"""Folders of CSV files whose headers, encodings and row lengths differ.

A first scan looks at the lines of all files as text. It tells, per file, the header, whether the
bytes are valid UTF-8, and whether every line is a complete record. Files that agree in these are
then read together by Spark's CSV source, and files with complete lines only are read in splits.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..operators.normalize import union_sources
from ..schema import NULL_TOKENS, PATH_CATEGORIES

FILE = "_file"
EXTRA = "_extra"

# A quoted field that opens and closes on the line it starts on.
_CLOSED_FIELD = r'(^|,)"[^"]*+(?:""[^"]*+)*+"(?=,|$)'
# A quote inside an unquoted field, where it is an ordinary character.
_INNER_QUOTE = r'(?<=[^,"])"(?=[^,"])'


@dataclass(frozen=True)
class Layout:
    """What files must have in common to be read together."""

    header: str
    utf8: bool
    whole_lines: bool
    quoted: bool


def inspect_files(spark: SparkSession, path: str | Sequence[str], recursive: bool = True) -> DataFrame:
    """One row per non-empty file: header line, valid UTF-8, complete lines, balanced quotes."""
    lines = (
        spark.read.option("recursiveFileLookup", str(recursive).lower())
        .option("pathGlobFilter", "*.{csv,csv.gz}")
        .text(path if isinstance(path, str) else list(path))
        .select("value", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias("at"))
    )
    value = F.col("value")
    rest = F.regexp_replace(value, _CLOSED_FIELD, ",")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    inner = F.regexp_count(value, F.lit(_INNER_QUOTE))
    has_quote = F.contains(value, F.lit('"'))
    marked = lines.select(
        FILE, "at", value,
        F.is_valid_utf8(value).alias("utf8"),
        F.when(has_quote, ~F.contains(rest, F.lit('"'))).otherwise(F.lit(True)).alias("whole"),
        F.when(has_quote, quotes - inner).otherwise(F.lit(0)).alias("quotes"),
    )
    # The header is the first line with text in the block at offset 0, which one task reads in order.
    top = (F.col("at") == 0) & (F.trim(value) != "")
    found = marked.groupBy(FILE).agg(
        F.first(F.when(top, value), ignorenulls=True).alias("header"),
        F.bool_and("utf8").alias("utf8"),
        F.bool_and("whole").alias("whole_lines"),
        (F.sum("quotes") % 2 == 0).alias("quoted"),
    )
    latin = F.decode(F.col("header").cast("binary"), "ISO-8859-1")
    return found.withColumn("header", F.when(F.col("utf8"), F.col("header")).otherwise(latin))


def header_columns(header: str) -> list[str]:
    """Column names of a header line; a repeated name, in whatever case, gets the suffix .1, .2 and so on."""
    names: list[str] = []
    seen: dict[str, int] = {}
    for name in next(csv.reader([header.lstrip("﻿")])):
        count = seen.get(name.lower(), 0)
        seen[name.lower()] = count + 1
        names.append(name if count == 0 else f"{name}.{count}")
    return names


def _name(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _read_group(spark: SparkSession, layout: Layout, files: Sequence[str]) -> DataFrame:
    """Rows of files of one layout, with the surplus field of too long rows in ``_extra``."""
    names = header_columns(layout.header)
    reader = (
        spark.read.option("header", "true")
        .option("enforceSchema", "true")
        .option("mode", "PERMISSIVE")
        .option("encoding", "UTF-8" if layout.utf8 else "ISO-8859-1")
    )
    place = {FILE: F.col("_metadata.file_path"), "_at": F.col("_metadata.file_block_start")}
    if layout.quoted:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, EXTRA]])
        rows = (
            reader.schema(schema).option("escape", '"').option("multiLine", str(not layout.whole_lines).lower())
            .csv(list(files)).withColumns(place)
        )
        fitting = rows.where(F.col(EXTRA).isNull())
    else:
        fitting = _split_lines(
            reader.schema("_line string").option("sep", "\x01").option("quote", "").csv(list(files)).withColumns(place),
            names,
        )
    cleared = [F.when(~_name(n).isin(*NULL_TOKENS), _name(n)).alias(n) for n in names]
    return fitting.select(*cleared, FILE, "_at")


def _split_lines(lines: DataFrame, names: Sequence[str]) -> DataFrame:
    """Fields of unquoted lines, where a backslash takes the meaning from the next character."""
    # Escaped backslashes and commas are set aside while the line is split, as line ends, which a line cannot hold.
    aside = F.replace(F.replace(F.col("_line"), F.lit("\\\\"), F.lit("\n")), F.lit("\\,"), F.lit("\r"))
    fields = F.split(F.replace(aside, F.lit("\\"), F.lit("")), ",")
    split = lines.withColumn("_fields", fields).where(F.size("_fields") <= len(names))
    return split.select(
        *[F.translate(F.get("_fields", F.lit(i)), "\n\r", "\\,").alias(n) for i, n in enumerate(names)],
        FILE, "_at",
    )


def read_ragged_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"),
    quote_fallback: bool = True,
    max_rows_per_file: int | None = None,
    recursive: bool = True,
    keep_file: bool = True,
) -> DataFrame:
    """All rows of all CSV files below ``path``, every column as text, matched by header name.

    Rows with too many fields are skipped, short rows are filled with null, quoted line breaks and
    doubled quotes are kept, and cells that say "missing" become null. A file that is not valid
    UTF-8 is read as ISO-8859-1, if listed in ``encodings``. A file whose quotes do not pair up is
    read without quoting, with backslash escapes. A row whose only surplus field is empty counts as
    fitting. The path of the file is in ``_file``.
    """
    found = inspect_files(spark, path, recursive).where("header is not null").collect()
    if not found:
        raise FileNotFoundError(f"no CSV file with a header below {path}")
    groups: dict[Layout, list[str]] = {}
    for row in found:
        utf8 = row["utf8"] or "ISO-8859-1" not in encodings
        layout = Layout(row["header"], utf8, row["whole_lines"], row["quoted"] or not quote_fallback)
        groups.setdefault(layout, []).append(row[FILE])
    frames = [_read_group(spark, layout, files) for layout, files in groups.items()]
    if max_rows_per_file is not None:
        frames = [_cap_per_file(f, max_rows_per_file) for f in frames]
    merged = union_sources(*[f.drop("_at") for f in frames])
    return merged if keep_file else merged.drop(FILE)


def _cap_per_file(df: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each file.

    Counts per block tell where the limit falls, so rows are numbered within their block only.
    """
    numbered = df.withColumn("_id", F.monotonically_increasing_id())
    blocks = df.groupBy(FILE, "_at").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(FILE).orderBy("_at")) - F.col("_c")
    starts = blocks.select(F.col(FILE).alias("_bf"), F.col("_at").alias("_ba"), before.alias("_before"))
    joined = numbered.join(
        starts.where(F.col("_before") < limit), (F.col(FILE) == F.col("_bf")) & (F.col("_at") == F.col("_ba"))
    )
    within = F.row_number().over(Window.partitionBy(FILE, "_at").orderBy("_id"))
    return joined.withColumn("_n", F.col("_before") + within).where(F.col("_n") <= limit).select(*df.columns)


def _bare(path: Column) -> Column:
    """The path without its scheme, which the sources write differently, and with plain blanks."""
    return F.replace(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), F.lit("%20"), F.lit(" "))


def file_load_report(spark: SparkSession, path: str | Sequence[str], loaded: DataFrame) -> DataFrame:
    """One row per file: bytes, rows in ``loaded``, and "loaded", "empty" or "error".

    A file without even a header is an error, one with a header only is empty.
    """
    reader = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.{csv,csv.gz}")
        .load(path if isinstance(path, str) else list(path))
    )
    # Spark plans no task for a file without a byte, so the names come from the listing itself.
    listing = spark.createDataFrame([(f,) for f in reader.inputFiles()], "file string")
    listing = listing.select(_bare(F.col("file")).alias("file"))
    sizes = reader.select(_bare(F.col("path")).alias("_p"), F.col("length").alias("bytes"))
    counts = loaded.groupBy(_bare(F.col(FILE)).alias("_f")).agg(F.count("*").alias("rows"))
    joined = listing.join(sizes, F.col("file") == F.col("_p"), "left")
    joined = joined.join(counts, F.col("file") == F.col("_f"), "left").fillna({"bytes": 0})
    rows = F.coalesce(F.col("rows"), F.lit(0))
    status = F.when(rows > 0, "loaded").when(F.col("bytes") == 0, "error").otherwise("empty")
    return joined.select("file", "bytes", rows.alias("rows"), status.alias("status"))


def load_totals(report: DataFrame) -> DataFrame:
    """One row: files by status and rows in all."""
    return report.agg(
        F.count("*").alias("n_files"),
        F.count_if(F.col("status") == "loaded").alias("loaded"),
        F.count_if(F.col("status") == "empty").alias("empty"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.sum("rows").alias("rows"),
    )


def relative_path(file: Column, root: str) -> Column:
    """The path below ``root``, whatever the scheme."""
    bare_root = "/" + root.split(":", 1)[-1].strip("/") + "/" if root.strip("/") else "/"
    bare = _bare(file)
    return F.when(F.startswith(bare, F.lit(bare_root)), F.substr(bare, F.lit(len(bare_root) + 1))).otherwise(
        F.element_at(F.split(bare, "/"), -1)
    )


def with_provenance(df: DataFrame, tag: str, root: str, file_col: str = FILE) -> DataFrame:
    """Add ``source`` = tag and ``data_source`` = tag_relative-path."""
    return df.withColumns(
        {
            "source": F.lit(tag),
            "data_source": F.concat(F.lit(f"{tag}_"), relative_path(F.col(file_col), root)),
        }
    )


def with_path_category(
    df: DataFrame, names: Sequence[str] = PATH_CATEGORIES, path_col: str = "data_source"
) -> DataFrame:
    """Add ``category``: the first of ``names`` that occurs in the path, else null."""
    category = F.lit(None).cast("string")
    for name in reversed(names):
        category = F.when(F.contains(F.lower(F.col(path_col)), F.lit(name)), F.lit(name)).otherwise(category)
    return df.withColumn("category", category)
