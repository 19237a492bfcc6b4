"""Mixing sources to target weights: block quotas split down a hypergeometric tree."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from trendspark.llm.common import WORD
from trendspark.session import stage

MAX_SOURCES = 100_000  # rows of the list of sources, which the driver holds and broadcasts
BLOCK_WORDS = 4_096  # of a source's line, dealt to one shard
MAX_BLOCKS = 500_000_000
BUCKET_ROWS = 4_096  # rows of a source that are put in order together


def word_count(text: Column) -> Column:
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def target_sizes(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Share the sum of all sizes by weight, none above ``most`` times its own size.

    What a source cannot take is shared among the others by weight, until none is above.
    """
    left, rest, targets = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    while rest:
        unit = left / sum(weights[i] for i in rest)
        full = [i for i in sorted(rest) if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in rest:
                targets[i] = unit * weights[i]
            break
        for i in full:
            targets[i] = most * sizes[i]
            left -= targets[i]
            rest.discard(i)
    return targets


@dataclass(frozen=True)
class Source:
    """One source: its place in the list, the words it holds and the words the mix is to take."""

    at: int
    name: str | None
    rows: int
    size: int
    target: float


def list_sources(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> list[Source]:
    """The sources by code point, null last, with targets for weights that repeat along the list.

    One row per source reaches the driver; more than ``MAX_SOURCES`` are refused.
    """
    found = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    own = [weights[i % len(weights)] for i in range(len(found))]
    targets = target_sizes([r["size"] for r in found], own, most)
    return [Source(i, r["source"], r["n"], r["size"], t) for i, (r, t) in enumerate(zip(found, targets, strict=True))]


def _line_up(sized: DataFrame, sources: Sequence[Source], seed: int) -> DataFrame:
    """Give each row its place in the permuted line of its source: (…, at, bucket, nth, start, target, source_size).

    A hash of the row puts it into one of its source's buckets, about ``BUCKET_ROWS`` rows each; only a
    bucket is put in order, so a source with a third of all rows is spread like the others.
    """
    spark = sized.sparkSession
    listed = spark.createDataFrame(
        [(s.at, s.name, -(-s.rows // BUCKET_ROWS), s.size, s.target) for s in sources],
        "at int, _name string, buckets bigint, source_size bigint, target double",
    )
    known = sized.join(F.broadcast(listed), F.col("source").eqNullSafe(F.col("_name"))).drop("_name")
    # Shared key for rows that agree in everything that counts here; their order makes no difference.
    known = known.withColumn("hash", F.xxhash64(F.lit(seed), "key"))
    known = known.withColumn("bucket", F.pmod("hash", "buckets"))
    sums = known.groupBy("at", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("at").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage(sums.select("at", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset")), "offsets")
    inside = Window.partitionBy("at", "bucket").orderBy("hash", "key", "size")
    ordered = known.withColumns({
        "nth": F.row_number().over(inside),
        "within": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"),
    })
    return ordered.join(offsets, ["at", "bucket"]).withColumn("start", F.col("offset") + F.col("within")).drop("within", "hash")


def _fill(rows: pa.Table) -> pa.Table:
    """In the bucket where a source's last round ends: take rows in order as long as they fit the words left."""
    order = np.argsort(rows.column("nth").to_numpy(), kind="stable")
    sizes = rows.column("size").to_numpy()[order]
    left = rows.column("gap")[0].as_py()
    taken = np.zeros(len(order), np.int64)
    for i, size in zip(order.tolist(), sizes.tolist(), strict=True):
        if size <= left:
            taken[i] = 1
            left -= size
    return rows.select(["at", "bucket", "nth"]).append_column("extra", pa.array(taken))


def plan_copies(sized: DataFrame, sources: Sequence[Source], seed: int = 17) -> DataFrame:
    """How often the mix takes each row: ``sized`` with its place and ``copies``.

    A source's target is met by whole rounds through its permuted line and a last, partial one: all
    rows of the buckets the words left reach past, and in the bucket where they end, rows in order as
    long as they fit. So a source misses its target by less than its next fitting row. Rows without
    words are never taken. Needs columns ``key``, ``source`` and ``size``.
    """
    placed = _line_up(sized, sources, seed)
    has = F.col("source_size") > 0
    rounds = F.when(has, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    placed = stage(
        placed.withColumn("rounds", rounds).withColumn("rest", F.col("target") - F.col("rounds") * F.col("source_size")),
        "placed",
    )
    ends = placed.groupBy("at", "bucket", "offset", "rest").agg(F.sum("size").alias("words"))
    cut = ends.where((F.col("offset") <= F.col("rest")) & (F.col("offset") + F.col("words") > F.col("rest")))
    cut = cut.select("at", "bucket", (F.col("rest") - F.col("offset")).alias("gap"))
    filled = (
        placed.join(cut, ["at", "bucket"]).select("at", "bucket", "nth", "size", "gap")
        .groupBy("at", "bucket").applyInArrow(_fill, "at int, bucket bigint, nth int, extra bigint")
    )
    whole = (F.col("offset") + F.col("words") <= F.col("rest")).cast("bigint")
    reach = ends.select("at", "bucket", whole.alias("whole"))
    both = placed.join(reach, ["at", "bucket"]).join(filled, ["at", "bucket", "nth"], "left")
    extra = F.coalesce("extra", "whole")
    return stage(
        both.withColumn("copies", F.when(F.col("size") > 0, F.col("rounds") + extra).otherwise(F.lit(0)))
        .drop("rounds", "rest", "offset", "whole", "extra", "buckets"),
        "copies",
    )


def split_quotas(quotas: np.ndarray, shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The shards ``first`` to ``last`` - 1 of the splitting tree: (shard, first block, number of blocks) by source.

    The root holds all blocks and all shards. A node draws what goes to its left half from the
    multivariate hypergeometric distribution, the law of dealing shuffled blocks; each node has its own
    generator, so every task can walk from the root to its shards and all tasks agree.
    """
    total = int(quotas.sum())

    def walk(lo: int, hi: int, base: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= last:
            return
        if hi - lo == 1:
            yield lo, base, held
            return
        mid = (lo + hi) // 2
        size = total * mid // shards - total * lo // shards
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(held, size, method="marginals")
        yield from walk(lo, mid, base, left)
        yield from walk(mid, hi, base + left, held - left)

    yield from walk(0, shards, np.zeros_like(quotas), quotas)


def _stride(n: int) -> int:
    """A step near the golden section of ``n`` that visits all of 0 … n - 1."""
    step = max(1, int(n * 0.618))
    while math.gcd(step, n) != 1:
        step += 1
    return step


def deal_blocks(spark: SparkSession, quotas: Sequence[int], shards: int, seed: int = 17) -> DataFrame:
    """Deal each source's blocks to the shards: (at, block, shard), each block once."""
    held = np.asarray(quotas, np.int64)
    strides = np.array([_stride(int(q)) for q in held], np.int64) if len(held) else held

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            if not len(ids):
                continue
            for shard, base, n in split_quotas(held, shards, int(ids[0]), int(ids[-1]) + 1, seed):
                at = np.repeat(np.arange(len(n)), n)
                nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + base[at]
                block = nth * strides[at] % np.maximum(held[at], 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int32()), pa.array(block, pa.int64()), pa.array(np.full(len(at), shard), pa.int32())],
                    names=["at", "block", "shard"],
                )

    return spark.range(shards).mapInArrow(work, "at int, block bigint, shard int")


def block_size(sources: Sequence[Source]) -> int:
    """Words per block: ``BLOCK_WORDS``, or more where that would make over ``MAX_BLOCKS`` blocks.

    The hypergeometric draws of the tree are made for fewer than a billion blocks.
    """
    return max(BLOCK_WORDS, math.ceil(sum(s.target for s in sources) / MAX_BLOCKS))


def draw(copies: DataFrame, sources: Sequence[Source], block_words: int | None = None, shard_words: int | None = None, seed: int = 17) -> DataFrame:
    """One row per copy taken: the columns of ``copies`` with ``copy``, ``block``, ``shard`` and ``slot``.

    Round after round a source's line is cut into blocks of ``block_words`` words (``block_size`` if not given); a row belongs to
    the block in which it starts. The blocks are dealt to shards of about ``shard_words`` words (256 blocks if not given). ``slot`` is the
    random order within a shard.
    """
    spark = copies.sparkSession
    block_words = block_words or block_size(sources)
    shard_words = shard_words or 256 * block_words
    quotas = [math.ceil(s.target / block_words) + 1 for s in sources]
    shards = max(1, round(sum(s.target for s in sources) / shard_words))
    dealt = deal_blocks(spark, quotas, shards, seed)
    each = copies.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    position = F.col("copy") * F.col("source_size") + F.col("start")
    # The last fitting rows may start past the target, so the tail of a line shares its last block.
    limits = F.floor(F.col("target") / block_words).cast("bigint")
    each = each.withColumn("block", F.least(F.floor(position / block_words).cast("bigint"), limits))
    return each.join(dealt, ["at", "block"]).withColumn("slot", F.xxhash64(F.lit(seed + 1), "key", "nth", "copy"))


def mix(sized: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """Plan and draw a mix of rows (key, source, size, …): (the planned rows, the drawn copies).

    ``key`` tells documents apart. An empty table gives two empty frames. The plan is written before the
    draw, so both agree.
    """
    sources = list_sources(sized, weights, most)
    if not sources:
        empty = sized.withColumns({
            "at": F.lit(0), "bucket": F.lit(0).cast("bigint"), "nth": F.lit(0), "target": F.lit(0.0), "shard": F.lit(0),
            "source_size": F.lit(0).cast("bigint"), "copies": F.lit(0).cast("bigint"), "slot": F.lit(0).cast("bigint"),
        })
        return empty, empty
    copies = plan_copies(sized, sources, seed)
    return copies, draw(copies, sources, seed=seed)


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 17) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated or left out, each shard's rows together in random order.

    Rows that agree in doc_id, source and text are one document as far as other columns go. Only
    ids, sizes and places are planned; the texts travel once to their copies and once to their shard.
    """
    key = F.xxhash64(F.struct("doc_id", "source", F.col("text").cast("binary")))
    keyed = docs.withColumn("__key", key)
    sized = stage(keyed.select(F.col("__key").alias("key"), "source", word_count(F.col("text")).alias("size")), "sized")
    _, drawn = mix(sized, weights, most, seed)
    places = drawn.groupBy("key").agg(F.collect_list(F.struct("shard", "slot")).alias("__places"))
    places = places.withColumnRenamed("key", "__key")
    chosen = keyed.dropDuplicates(["__key"]).join(places, "__key").withColumn("__place", F.explode("__places"))
    together = chosen.repartition(F.col("__place.shard")).sortWithinPartitions("__place.shard", "__place.slot")
    return together.select(*docs.columns)
