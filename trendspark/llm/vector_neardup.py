"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from trendspark.llm.components import components
from trendspark.session import stage

PASSES = 12
WINDOW = 256
BLOCK = 2_048
SLICE = 1_024
KEY_BITS = 64


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and one that is not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so squares neither vanish nor overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sort_keys(x: np.ndarray, number: int, seed: int) -> np.ndarray:
    """The sort keys of one pass: the signs of ``KEY_BITS`` random projections as one number each."""
    planes = np.random.default_rng([seed, number, x.shape[1]]).standard_normal((x.shape[1], KEY_BITS))
    bits = np.packbits(x @ planes > 0, axis=1, bitorder="big")
    # Flipping the top bit makes signed numbers sort as the bits do.
    return bits.view(">u8")[:, 0].astype(np.uint64).view(np.int64) ^ np.int64(-(1 << 63))


def passes_for(n_classes: int, window: int) -> int:
    """How many passes bring a pair at the limit of 0.98 into one window at least once, but for one pair in a thousand.

    A random plane parts such a pair with probability 0.064, and the first log2(n / window) signs must agree.
    """
    same = 0.936 ** np.log2(max(n_classes / window, 1))
    return max(PASSES, int(np.ceil(np.log(1e-3) / np.log1p(-min(same, 0.999)))))


def _with_keys(classes: DataFrame, passes: int, seed: int) -> DataFrame:
    """A row per class and pass, without the vector: (pass, label, dim, key, cid)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _unit(_matrix(part.column("embedding"), dim))
                for number in range(passes):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(part.num_rows, number), pa.int32()), part.column("label"), part.column("dim"),
                            pa.array(sort_keys(x, number, seed)), part.column("cid"),
                        ],
                        names=["pass", "label", "dim", "key", "cid"],
                    )

    schema = f"pass int, label {dict(classes.dtypes)['label']}, dim int, key bigint, cid bigint"
    return classes.select("cid", "label", "dim", "embedding").mapInArrow(work, schema)


def _numbered(rows: DataFrame) -> DataFrame:
    """Number the rows of each partition in the order they have: adds part and nth."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(done, done + n), pa.int64())]
            done += n
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "part", "nth"])

    return rows.mapInArrow(work, rows.withColumns({"part": F.lit(0), "nth": F.lit(0).cast("bigint")}).schema)


def _similar(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of ``x`` and ``y`` have cosine ``least`` or more; those at the limit are multiplied one by one."""
    cosine = x @ y.T
    near = cosine >= least
    i, j = np.nonzero(np.abs(cosine - least) <= 1e-9)
    near[i, j] = np.einsum("ij,ij->i", x[i], y[j]) >= least
    return near


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the numbers 0..n-1 that each reaches over the pairs (i, j)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        for ends in (root[i], root[j], i, j):
            np.minimum.at(root, ends, low)
        root = root[root]
        if (root == before).all():
            return root


def _join_near(window: int, least: float):
    """Within one block of the sorted rows, join the classes at most ``window`` places apart that are similar.

    Returns a pair per class with the smallest class it is joined with, not all the links.
    """
    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        at, cid, own = (rows.column(c).to_numpy() for c in ("at", "cid", "own"))
        dims = rows.column("dim").to_numpy()
        group = rows.select(["pass", "label", "dim"]).to_pandas().groupby(["pass", "label", "dim"]).ngroup().to_numpy()
        found = [np.zeros((2, 0), np.int64)]
        for dim in np.unique(dims).tolist():
            (here,) = np.nonzero(dims == dim)
            x = _unit(_matrix(rows.column("embedding").combine_chunks().take(pa.array(here)), dim))
            for a in range(0, len(here), window):
                left = max(0, a - window)
                later, earlier = here[a:a + window], here[left:a + window]
                near = _similar(x[a:a + window], x[left:a + window], least)
                gap = at[later][:, None] - at[earlier][None, :]
                near &= (gap > 0) & (gap <= window) & own[later][:, None]
                near &= group[later][:, None] == group[earlier][None, :]
                i, j = np.nonzero(near)
                found.append(np.stack([later[i], earlier[j]]))
        i, j = np.concatenate(found, axis=1)
        root = _roots(len(cid), i, j)
        joined = root != np.arange(len(cid))
        return pa.table({"a": pa.array(cid[joined], pa.int64()), "b": pa.array(cid[root[joined]], pa.int64())})

    return work


def joined_classes(
    classes: DataFrame, n_classes: int, least: float = 0.98, passes: int | None = None, window: int = WINDOW, seed: int = 5
) -> DataFrame:
    """Pairs (a, b) of classes that verified links join; classes have cosine ``least`` or more and come within ``window`` places in a pass.

    Each pass sorts all vectors by label and the concatenated signs of random projections. The sorted line
    is cut into blocks that overlap by the window, so a task holds a bounded number of rows whatever the
    data, also where many vectors share one key: the class number splits them. Only keys are sorted; the vectors
    meet their places once, on the way to the blocks. The links of a block are united there, so it returns at most
    a pair per row.
    """
    spark = classes.sparkSession
    passes = passes or passes_for(n_classes, window)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_classes * passes // 500_000))
    order = ["pass", "dim", "label", "key", "cid"]
    line = _with_keys(classes, passes, seed).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    line = stage(_numbered(line.drop("key")), "line")
    counts = line.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the line, not per vector.
    offsets = stage(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")), "offsets")
    placed = line.join(offsets, "part").withColumn("at", F.col("offset") + F.col("nth")).drop("part", "nth", "offset")
    block = F.floor(F.col("at") / BLOCK).cast("bigint")
    own = F.struct(block.alias("block"), F.lit(True).alias("own"))
    halo = F.struct((block + 1).alias("block"), F.lit(False).alias("own"))
    both = F.when(F.col("at") % BLOCK >= BLOCK - window, F.array(own, halo)).otherwise(F.array(own))
    spread = placed.withColumn("_b", F.explode(both)).select("*", "_b.block", "_b.own").drop("_b")
    filled = spread.join(classes.select("cid", "embedding"), "cid")
    return filled.groupBy("block").applyInArrow(_join_near(window, least), "a bigint, b bigint").distinct()


def _count_links(least: float):
    """Within a pair of slices of one component, the weight of the links of each class."""
    def work(rows: pa.Table) -> pa.Table:
        cid, weight, piece = (rows.column(c).to_numpy() for c in ("cid", "n", "piece"))
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        x = _unit(_matrix(rows.column("embedding"), rows.column("dim")[0].as_py()))
        one, two = np.nonzero(piece == low)[0], np.nonzero(piece == high)[0]
        others = np.zeros(len(cid), np.int64)
        for a in range(0, len(one), SLICE):
            mine = one[a:a + SLICE]
            for b in range(0, len(two), SLICE):
                yours = two[b:b + SLICE]
                near = _similar(x[mine], x[yours], least) & (cid[mine][:, None] != cid[yours][None, :])
                others[mine] += near @ weight[yours]
                if low < high:
                    others[yours] += weight[mine] @ near
        return pa.table({"cid": pa.array(cid, pa.int64()), "others": pa.array(others, pa.int64())})

    return work


def link_counts(classes: DataFrame, rooted: DataFrame, least: float = 0.98) -> DataFrame:
    """How many vectors of other classes each class links with: (cid, others), for classes in components of two or more.

    ``rooted`` holds (cid, root) of these. All links of a class lie inside its component, so comparing the
    component with itself finds every one, also those no window saw. A component is cut into slices of
    about ``SLICE`` classes by a hash, and each pair of slices is a group of its own, which returns sums and no links.
    """
    sizes = stage(rooted.groupBy("root").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")), "sizes")
    own = F.pmod(F.xxhash64("cid"), "slices").cast("int")
    pieces = rooted.join(sizes, "root").select("cid", "root", "slices", own.alias("piece"))
    met = pieces.withColumn("met", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    keyed = met.withColumns({"low": F.least("piece", "met"), "high": F.greatest("piece", "met")}).drop("met", "slices")
    filled = keyed.join(classes.select("cid", "n", "dim", "embedding"), "cid")
    found = filled.groupBy("root", "low", "high").applyInArrow(_count_links(least), "cid bigint, others bigint")
    return found.groupBy("cid").agg(F.sum("others").alias("others"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, passes: int | None = None, window: int = WINDOW, seed: int = 5) -> DataFrame:
    """Link vectors of one label by cosine: (vec_id, n_links, component_id, kept), one row per vector.

    Null labels, null vectors and vectors that are zero or hold null or non-finite components link with
    nothing; so do vectors of different length. Equal vectors of a label form one class, which is
    compared once and counts with all its members. The sorted passes find the components; ``n_links`` then counts every link
    inside them, however many there are. ``component_id`` is the smallest vec_id that links reach,
    ``kept`` whether it is the row's own. An empty table gives no rows.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    fit = F.col("label").isNotNull() & usable(F.col("embedding"))
    grouped = rows.where(fit).groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    classes = stage(
        grouped.withColumns({"cid": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "classes"
    )
    joins = stage(joined_classes(classes, classes.count(), least, passes, window, seed), "links")
    rooted = stage(components(joins, "a", "b").withColumnRenamed("node", "cid"), "components")
    members = stage(rooted.union(rooted.select("root", "root").distinct()), "members")
    degrees = stage(link_counts(classes, members, least), "degrees")
    known = stage(
        classes.join(rooted, "cid", "left").join(degrees, "cid", "left")
        .select(
            "label", "embedding", "first_id", F.coalesce("root", "cid").alias("root"),
            (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        ),
        "rooted",
    )
    firsts = stage(known.groupBy("root").agg(F.min("first_id").alias("component_id")), "firsts")
    named = stage(known.join(firsts, "root").select("label", "embedding", "n_links", "component_id"), "named")
    joined = rows.where(fit).join(named, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~fit).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
