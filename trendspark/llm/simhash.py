"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from trendspark.llm.common import chunks, raw, row_key
from trendspark.llm.components import components
from trendspark.session import stage

BITS = 64
SEED = 42


def simhash(text: bytes, width: int = 3) -> int:
    """The fingerprint of one text, as an unsigned number.

    Words are parted by ASCII white space after lower-casing A-Z. Each run of ``width`` words joined
    by spaces, repeats included, votes with the bits of its XXH64; a text of fewer words votes once,
    as a whole. A bit is set if more than half of the votes have it. No words: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n], ends[min(width, len(words)) - 1:]
    votes = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_intdigest
    for a, b in chunks(n, 1 << 16):
        parts = zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)
        hashes = np.fromiter((digest(joined[i:j], SEED) for i, j in parts), np.uint64, b - a)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Replace the text column by its fingerprint, a bigint that holds the 64 bits.

    Null, empty and blank texts get zero. All other columns pass through unread.
    """
    rest = [c for c in docs.columns if c != text]
    frame = docs.select(*rest, raw(text).alias(name))
    schema = docs.select(*rest, F.lit(0).cast("bigint").alias(name)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((simhash(t.as_py()) for t in batch.column(name)), np.uint64, batch.num_rows)
            columns = [*batch.columns[:-1], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frame.mapInArrow(work, schema)


def ball(fingerprint: Column) -> Column:
    """The fingerprint and all its variants with one bit flipped."""
    flip = lambda i: F.when(i < 0, fingerprint).otherwise(
        fingerprint.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))
    )
    return F.transform(F.sequence(F.lit(-1), F.lit(BITS - 1)), flip)


def fingerprint_links(prints: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Links (a, b) between different fingerprints that differ in at most 2 bits.

    ``prints`` holds each fingerprint once. Two of them differ in at most two bits exactly if their
    balls of radius one meet. All fingerprints in the ball round a variant, 65 at most, lie within
    two bits of each other, so each is linked to the one before it: every two fingerprints within
    two bits stay connected, while no bucket is expanded into all its pairs.
    """
    spread = prints.select(F.col(name).alias("b"), F.explode(ball(F.col(name))).alias("variant"))
    before = F.lag("b").over(Window.partitionBy("variant").orderBy("b"))
    pairs = spread.withColumn("a", before).where(F.col("a").isNotNull()).select("a", "b").distinct()
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicate_groups(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text") -> DataFrame:
    """Fingerprint each document and name its group: (doc_id, *carry, fingerprint, component_id, root).

    One row per row of ``docs``; ``fingerprint`` is 16 hex digits, ``component_id`` the smallest
    doc_id reachable over links of at most 2 differing bits, ``root`` the smallest fingerprint, which tells
    groups apart also where ids repeat. Texts without words share fingerprint zero and so one group. A null
    doc_id never names a group unless all its ids are null. An empty table gives no rows.
    """
    prints = stage(with_fingerprint(docs.select("doc_id", *carry, F.col(text).alias("_text")), "_text"), "prints")
    classes = stage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "classes")
    rooted = components(fingerprint_links(classes), "a", "b")
    known = stage(
        classes.join(rooted, F.col("fingerprint") == F.col("node"), "left")
        .select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")),
        "rooted",
    )
    groups = stage(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "groups")
    named = stage(known.join(groups, "root").select("fingerprint", "component_id", "root"), "named")
    joined = prints.join(named, "fingerprint")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return joined.select("doc_id", *carry, shown, "component_id", "root")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id (null last); all columns stay.

    Rows that agree in doc_id and text are one document and leave one row.
    """
    key = row_key()
    grouped = near_duplicate_groups(docs.withColumn("__key", key).select("doc_id", "__key", "text"), ("__key",))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__key")
    kept = stage(grouped.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.__key").alias("__key")), "kept")
    return docs.withColumn("__key", key).join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
