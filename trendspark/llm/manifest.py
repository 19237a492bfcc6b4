"""Merkle manifest of a dataset: places by rank in merged bitmaps, levels by slot arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from trendspark.session import shuffle_width, stage

ARITY = 3
LEVELS = 4  # levels that one shuffle takes; a group has ARITY ** LEVELS slots
SLOTS = ARITY ** LEVELS
WORDS = 8  # 64-bit words of a container
CONTAINER_BITS = 9  # so many low bits of an id say its place in the container
FAN_BITS = 14  # a directory entry sums up so many containers (as a power of two), and so on upwards
DIRECTORIES = 3  # levels of directories above the containers: 9 + 4 * 14 bits hold all bigints
NO_ID = -(1 << 55)  # container of null ids, before all others


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 of all values in one text: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _running(order: str, *by: str) -> Column:
    """Rows before this one's, summed over the groups ``by``."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("n").over(window), F.lit(0))


def _directory(counts: DataFrame, levels: int) -> DataFrame:
    """From (source, at, n) to (source, at, base, total): rows in earlier containers and in the whole source.

    No window is larger than one directory entry: its base comes from the entries a level above.
    """
    if levels == 0:
        whole = F.sum("n").over(Window.partitionBy("source"))
        return counts.select("source", "at", _running("at", "source").alias("base"), whole.alias("total"))
    held = counts.withColumn("entry", F.shiftright("at", FAN_BITS))
    above = _directory(held.groupBy("source", F.col("entry").alias("at")).agg(F.sum("n").alias("n")), levels - 1)
    above = above.select("source", F.col("at").alias("entry"), F.col("base").alias("base_above"), "total")
    local = held.select("source", "entry", "at", _running("at", "source", "entry").alias("local"))
    return local.join(above, ["source", "entry"]).select("source", "at", (F.col("base_above") + F.col("local")).alias("base"), "total")


def _containers(leaves: DataFrame) -> DataFrame:
    """Bitmaps of the ids of each source: (source, at, n, held, b0 .. b7, base, total).

    Tasks merge their bitmaps by OR before and after the shuffle; only containers with an id are kept. ``n`` counts
    rows, ``held`` different ids, so the two differ where ids are null or repeat.
    """
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").bitwiseAND(63).cast("int"))
    word = F.shiftright("doc_id", 6).bitwiseAND(WORDS - 1)
    bits = [F.coalesce(F.bit_or(F.when(word == j, bit)), F.lit(0)).alias(f"b{j}") for j in range(WORDS)]
    held = sum((F.bit_count(f"b{j}") for j in range(1, WORDS)), F.bit_count("b0"))
    merged = stage(leaves.groupBy("source", "at").agg(F.count("*").alias("n"), *bits).withColumn("held", held), "containers")
    return stage(merged.join(_directory(merged.select("source", "at", "n"), DIRECTORIES), ["source", "at"]), "directory")


def with_places(leaves: DataFrame) -> DataFrame:
    """Add ``place``, the row's number in its source by ascending doc_id, and ``total``, the rows of the source.

    ``leaves``: (source, doc_id, leaf, claimed), source not null. A place is the base of the id's container plus the ones
    before its bit; nothing is sorted. Null ids come first. In containers with null or repeated ids rows are ordered by
    id, leaf and claimed; there rows that are alike are counted, and the counts summed up in bounded steps.
    """
    at = F.coalesce(F.shiftright("doc_id", CONTAINER_BITS), F.lit(NO_ID)).alias("at")
    rows = leaves.select("*", at)
    index = _containers(rows)
    word, bit = F.shiftright("doc_id", 6).bitwiseAND(WORDS - 1), F.col("doc_id").bitwiseAND(63).cast("int")
    earlier = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), bit))
    rank = sum((
        F.when(word > j, F.bit_count(f"b{j}")).when(word == j, F.bit_count(F.col(f"b{j}").bitwiseAND(earlier))).otherwise(0)
        for j in range(WORDS)
    ), F.lit(0))
    shown = ["source", "doc_id", "leaf", "claimed", "total", "place"]
    single = rows.join(index.where("n = held"), ["source", "at"]).withColumn("place", F.col("base") + rank).select(*shown)

    shared = rows.join(index.where("n > held").select("source", "at", "base", "total"), ["source", "at"])
    key, part = F.coalesce("doc_id", F.lit(0)).alias("key"), F.substring("leaf", 1, 4).alias("part")
    alike = shared.groupBy("source", "at", "base", "total", "doc_id", key, part, "leaf", "claimed").agg(F.count("*").alias("n"))
    parts = alike.groupBy("source", "at", "key", "part").agg(F.sum("n").alias("n"))
    ids = parts.groupBy("source", "at", "key").agg(F.sum("n").alias("n"))
    ids = ids.select("source", "at", "key", _running("key", "source", "at").alias("before_id"))
    parts = parts.select("source", "at", "key", "part", _running("part", "source", "at", "key").alias("before_part"))
    order = Window.partitionBy("source", "at", "key", "part").orderBy("leaf", "claimed").rowsBetween(Window.unboundedPreceding, -1)
    told = alike.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(parts, ["source", "at", "key", "part"]).join(
        ids, ["source", "at", "key"]
    )
    first = F.col("base") + F.col("before_id") + F.col("before_part") + F.col("before")
    copies = F.explode(F.sequence(first, first + F.col("n") - 1)).alias("place")
    return single.unionByName(told.select("source", "doc_id", "leaf", "claimed", "total", copies))


def _upper(count: Column, level: int) -> Column:
    """Nodes that are left of ``count`` after ``level`` levels."""
    return F.call_function("div", count + (ARITY ** level - 1), F.lit(ARITY ** level)) if level else count


def _hashed(nodes: Column) -> Column:
    """The level above an array of nodes: each run of ARITY becomes the hash of its digests."""
    runs = F.sequence(F.lit(0), _upper(F.size(nodes), 1).cast("int") - 1)
    return F.transform(runs, lambda q: F.sha2(F.array_join(F.slice(nodes, q * ARITY + 1, ARITY), ""), 256))


def _grouped(nodes: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Slot arrays of SLOTS consecutive nodes and the levels above them: (source, at, total, kids, a0 .. aLEVELS).

    ``nodes``: (source, place, total, digest, *carried). A level is taken only while its source has several nodes.
    """
    slot = F.pmod("place", F.lit(SLOTS)).cast("int").alias("slot")
    kids = F.sort_array(F.collect_list(F.struct(slot, "digest", *carried)))
    grouped = nodes.groupBy("source", F.expr(f"place div {SLOTS}").alias("at")).agg(F.max("total").alias("total"), kids.alias("kids"))
    grouped = grouped.withColumn("a0", F.transform("kids", lambda x: x["digest"]))
    for j in range(LEVELS):
        below = F.col(f"a{j}")
        grouped = grouped.withColumn(f"a{j + 1}", F.when(_upper(F.col("total"), j) > 1, _hashed(below)).otherwise(below))
    return grouped


def _path(slot: Column) -> Column:
    """The siblings of a slot on the levels of its group, those to the left and to the right."""
    steps = []
    for j in range(LEVELS):
        at = F.call_function("div", slot, F.lit(ARITY ** j)).cast("int")
        own = F.pmod(at, F.lit(ARITY))
        row = F.col(f"a{j}")
        left, right = F.slice(row, at - own + 1, own), F.slice(row, at + 2, F.lit(ARITY - 1) - own)
        siblings = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
        steps.append(F.when(_upper(F.col("total"), j) > 1, siblings))
    return F.array_compact(F.array(*steps))


def _rounds(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """Groups, groups of groups and so on, until one group per source is left; each is written once."""
    largest = nodes.agg(F.max("total")).first()[0] or 0
    rounds = [stage(_grouped(nodes, carried), "slots")]
    while largest > SLOTS:
        largest = -(-largest // SLOTS)
        tops = rounds[-1].select("source", F.col("at").alias("place"), _upper(F.col("total"), LEVELS).alias("total"), F.get(f"a{LEVELS}", F.lit(0)).alias("digest"))
        rounds.append(stage(_grouped(tops), "slots"))
    return rounds


def _descend(rounds: list[DataFrame], above: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """Paths of all nodes: (source, digest, *carried, path, *columns of above). ``above``: (source, up, ...)."""
    more = [c for c in above.columns if c not in ("source", "up")]
    top = above.withColumn("at", F.lit(0).cast("bigint"))
    for groups in reversed(rounds[1:]):
        kids = F.explode(F.transform("kids", lambda x: F.struct(x["slot"].alias("slot"), _path(x["slot"]).alias("path")))).alias("x")
        top = groups.join(top, ["source", "at"]).select("source", "at", "up", *more, kids).select(
            "source", (F.col("at") * SLOTS + F.col("x.slot")).alias("at"), F.concat("x.path", "up").alias("up"), *more
        )
    kids = F.transform("kids", lambda x: F.struct(x["digest"].alias("digest"), *[x[c].alias(c) for c in carried], _path(x["slot"]).alias("path")))
    rows = rounds[0].join(top, ["source", "at"]).select("source", "up", *more, F.explode(kids).alias("x"))
    return rows.select("source", "x.digest", *[f"x.{c}" for c in carried], F.concat("x.path", "up").alias("path"), *more)


def _in_order(roots: DataFrame) -> DataFrame:
    """Add ``place`` and ``total`` to (source, digest) by source; only counts of range partitions meet in one task."""
    width = shuffle_width(roots.sparkSession)
    parts = stage(roots.repartitionByRange(width, "source").withColumn("part", F.spark_partition_id()), "sources")
    sizes = parts.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sizes.select("part", _running("part").alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("source")) - 1
    return parts.withColumn("nth", nth).join(sizes, "part").select("source", "digest", "total", (F.col("base") + F.col("nth")).alias("place"))


def manifest(docs: DataFrame, leaf: Column, claimed: Column | None = None, source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """The tree over all rows: (doc_id, source, leaf, claimed, subroot, root, path), one row per row of ``docs``.

    Rows of a source are its leaves by ascending id (null first, rows alike in id by digest); every ARITY consecutive nodes
    become the SHA-256 of their digests as hex text, the last run whatever is left, until one node is left, the
    subroot. The subroots by source (null first, then UTF-8 bytewise) become the root in the same way. ``path`` holds the
    siblings on the way to the root, level by level, ``claimed`` a digest to be checked against it. An empty table
    gives no rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("")).alias("source")
    leaves = stage(docs.select(key, F.col(doc_id).cast("bigint").alias("doc_id"), leaf.alias("leaf"), (leaf if claimed is None else claimed).alias("claimed")), "leaves")
    carried = ("doc_id", "claimed")
    nodes = stage(with_places(leaves), "places").withColumnRenamed("leaf", "digest")
    rounds = _rounds(nodes, carried)
    subroots = stage(rounds[-1].select("source", F.get(f"a{LEVELS}", F.lit(0)).alias("digest")), "subroots")
    joint = F.lit("all")
    listed = stage(_in_order(subroots), "in-order").select(joint.alias("source"), "place", "total", "digest", F.col("source").alias("of"))
    tops = _rounds(listed, ("of",))
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    root = tops[-1].select("source", no_path.alias("up"), F.get(f"a{LEVELS}", F.lit(0)).alias("root"))
    above = stage(_descend(tops, root, ("of",)).select(F.col("of").alias("source"), F.col("path").alias("up"), F.col("digest").alias("subroot"), "root"), "subroot-paths")
    rows = _descend(rounds, above, carried)
    named = F.when(F.col("source") != "", F.substring("source", 2, 1 << 30)).alias("source")
    return rows.select("doc_id", named, F.col("digest").alias("leaf"), "claimed", "subroot", "root", "path")


def proof_digest(path: str | Column) -> Column:
    """SHA-256 of all siblings of a path, from the leaf to the root and left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(path: str | Column, leaf: str | Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))
