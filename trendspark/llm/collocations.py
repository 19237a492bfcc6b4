"""Phrase collocations from a weighted de Bruijn graph of word n-grams."""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from urllib.parse import quote_plus

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from trendspark.llm.common import raw
from trendspark.session import stage

UNKNOWN = "und"
LONGEST = 3  # words of an edge; nodes have one word less
MIN_COUNT = 10
COVERED = 50  # per cent of a phrase's places that a longer candidate must hold to replace it
TOP = 2_000
SPREAD = 64  # parts of a language that are cut to the top before it is ranked as a whole
HELD = 1 << 20  # different grams that a task adds up before it hands them on; it bounds memory, not results
HOT_SAMPLE, HOT = 0.01, 1e-3  # nodes with such a share of the grams of such a sample of documents are dealt out by edges
# Lower-cases A-Z, makes every end of a piece a line feed and every tab a space.
_FOLD = bytes.maketrans(
    string.ascii_uppercase.encode() + b".,;:!?\x0b\x0c\r\t", string.ascii_lowercase.encode() + b"\n" * 9 + b" "
)


def _key(k: int, lang: str) -> str:
    return f"{k}{quote_plus(lang)}\t"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (lang, text) to (key, f): what a task has seen of each gram, added up as long as memory allows."""
    held: dict[tuple[int, str], Counter] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (k, lang), counter in held.items():
            grams = pa.array(counter.keys(), pa.binary())
            order = pc.sort_indices(grams)  # neighbours alike, so that the shuffle packs them closer
            keys = pc.binary_join_element_wise(pa.scalar(_key(k, lang).encode(), pa.binary()), grams.take(order), pa.scalar(b"", pa.binary()))
            yield pa.RecordBatch.from_arrays([keys.cast(pa.string()), pa.array(counter.values(), pa.int64()).take(order)], names=["key", "f"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang, data = lang.as_py(), text.as_py().decode("utf-8", "replace").encode("utf-8")
            counters = [held.setdefault((k, lang), Counter()) for k in range(1, LONGEST + 1)]
            size -= sum(map(len, counters))
            for piece in data.translate(_FOLD).split(b"\n"):
                words = piece.split()
                counters[-1].update(map(b" ".join, zip(*[words[i:] for i in range(LONGEST)])))
                for k in range(1, min(LONGEST, len(words) + 1)):
                    counters[k - 1][b" ".join(words[-k:])] += 1
            size += sum(map(len, counters))
            if size > HELD:
                yield from hand_on()
                size = 0
    yield from hand_on()


def graph_flow(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[str]]:
    """Edges and ends of the graph: (place, key, f), each different one once.

    A piece of m words gives one gram per word: the LONGEST words from there on, or what is left of
    them. The full ones are edges, which lead from the node of their first words to that of their last; the shorter
    ones are the piece-end corrections, since the flow of a node that ends a piece leaves by no edge.
    A key is the number of words, the quoted language, a tab and the words with one space between.
    A-Z are lower-cased; null texts count as empty, a null language as ``und``. Tasks add up before the shuffle.

    Returned with the hot nodes. ``place`` is the node: its edges and ends are dealt to one task, so that its flow is summed up there without a
    further shuffle. Nodes with a share of HOT of the grams of a sample of documents, 1 / HOT at most, are dealt out edge by edge
    instead. The sample decides where a count is made and not what it is.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), raw(text).alias("text"))
    node = _rest(F.substring_index("key", " ", LONGEST - 1))
    tried = stage(rows.sample(HOT_SAMPLE, 0).mapInArrow(_grams, "key string, f bigint").groupBy(node.alias("node")).agg(F.count("*").alias("n")), "sampled")
    least = HOT * (tried.agg(F.sum("n")).first()[0] or 0)
    hot = [r["node"] for r in tried.where(F.col("n") > F.lit(max(least, 100.0))).collect()]
    place = F.when(node.isin(hot), _rest("key")).otherwise(node) if hot else node
    seen = rows.mapInArrow(_grams, "key string, f bigint")
    return seen.repartition(place).groupBy(place.alias("place"), "key").agg(F.sum("f").alias("f")), hot


def _rest(key: str | Column) -> Column:
    """A key without the number of words."""
    return F.substring(key, 2, 1 << 30)


def _first(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def _last(gram: str | Column, k: int) -> Column:
    return F.substring_index(gram, " ", -k)


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of all frequent grams, written once: (lang, k, gram, f, leaving, arriving).

    Only edges and piece ends are counted in the texts. A gram of k words occurs as often as the grams
    of k + 1 words that begin with it plus the pieces that end with it, so each level hands its flow down to the next;
    the empty gram (k = 0) gets the number of words. ``leaving`` and ``arriving`` are the largest counts of a frequent
    gram one word longer that begins or ends with the gram. Grams below ``min_count`` are left out once their flow is passed on.
    """
    flow, hot = graph_flow(docs, text, lang)
    f, frequent, start = F.col("f"), F.col("f") >= min_count, F.substring_index("key", "\t", 1)

    def handed_down(k: int, done: Column) -> Column:
        """Rows of level ``k`` that are ``done`` hand their flow down and stay if frequent; all others pass."""
        begin = _first("key", k - 1) if k > 1 else F.concat(start, F.lit("\t"))
        same = F.struct("key", "f")
        down = F.struct(F.concat(F.lit(str(k - 1)), _rest(begin)).alias("key"), f.alias("f"))
        handed = F.when(frequent, F.array(same, down)).otherwise(F.array(down))
        return F.explode(F.when(F.startswith("key", F.lit(str(k))) & done, handed).otherwise(F.array(same))).alias("g")

    every = F.lit(True)
    nodes = flow.select("place", handed_down(LONGEST, every)).select("place", "g.*").groupBy("place", "key").agg(F.sum("f").alias("f"))
    whole = ~_rest("key").isin(hot) if hot else every
    flow = nodes.select(handed_down(LONGEST - 1, whole)).select("g.*").groupBy("key").agg(F.sum("f").alias("f"))
    if hot:
        flow = flow.select(handed_down(LONGEST - 1, ~whole)).select("g.*").groupBy("key").agg(F.sum("f").alias("f"))
    flow = flow.select(handed_down(1, every)).select("g.*").groupBy("key").agg(F.sum("f").alias("f"))
    told = flow.select(
        F.url_decode(_rest(start)).alias("lang"), F.substring("key", 1, 1).cast("int").alias("k"),
        F.substring_index("key", "\t", -1).alias("gram"), "f",
    )
    counts = stage(told, "flow")
    none = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(_first("gram", LONGEST - 1).alias("gram"), f.alias("leaving"), none.alias("arriving")),
        F.struct(_last("gram", LONGEST - 1).alias("gram"), none.alias("leaving"), f.alias("arriving")),
    )
    met = counts.where(F.col("k") == LONGEST).select("lang", F.inline(sides)).groupBy("lang", "gram").agg(
        F.max("leaving").alias("leaving"), F.max("arriving").alias("arriving")
    ).withColumn("k", F.lit(LONGEST - 1))
    joined = counts.join(met, ["lang", "k", "gram"], "left")
    return stage(joined.select("lang", "k", "gram", "f", F.coalesce("leaving", none).alias("leaving"), F.coalesce("arriving", none).alias("arriving")), "grams")


def unary_paths(counts: DataFrame) -> DataFrame:
    """The frequent edges, with those that only ever follow each other joined: (lang, words, f).

    A node is unary if one edge brings and one edge takes all its flow, which also means that no piece begins
    or ends there. Edges on both sides of a unary node always occur together, so a path has one count for all its edges
    and inner nodes. Every edge belongs to one path. A path lies inside a piece, so no row outgrows a text.
    Each edge finds the first of its path by pointer doubling: log2(longest path) joins of narrow rows.
    """
    # Once written, the numbers given to the edges stay; they are shorter than the words.
    edges = stage(
        counts.where(F.col("k") == LONGEST).select("lang", F.col("gram").alias("edge"), "f", F.monotonically_increasing_id().alias("id")), "edges"
    )
    full = (F.col("k") == LONGEST - 1) & (F.col("f") == F.col("leaving")) & (F.col("f") == F.col("arriving"))
    unary = stage(counts.where(full).select("lang", F.col("gram").alias("node")), "unary")
    before = edges.select("lang", F.col("id").alias("up"), _last("edge", LONGEST - 1).alias("node"))
    after = edges.select("lang", "id", _first("edge", LONGEST - 1).alias("node"))
    jumps = stage(
        unary.join(before, ["lang", "node"]).join(after, ["lang", "node"]).select("id", "up", F.lit(1).cast("bigint").alias("hops")), "jumps"
    )
    while True:
        far = jumps.select(F.col("id").alias("up"), F.col("up").alias("far"), F.col("hops").alias("more"))
        jumps = stage(
            jumps.join(far, "up", "left").select(
                "id", F.coalesce("far", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
                F.col("far").isNotNull().alias("moved"),
            ),
            "jumps",
        )
        if jumps.where("moved").limit(1).count() == 0:
            break
    placed = edges.join(jumps.drop("moved"), "id", "left").select(
        F.coalesce("up", "id").alias("head"), F.coalesce("hops", F.lit(0)).alias("hops"), "lang", "f", _last("edge", 1).alias("word"),
        F.when(F.col("up").isNull(), _first("edge", LONGEST - 1)).alias("start"),
    )
    tail = F.transform(F.sort_array(F.collect_list(F.struct("hops", "word"))), lambda x: x["word"])
    joined = placed.groupBy("head").agg(
        F.first("lang").alias("lang"), F.max("start").alias("start"), tail.alias("tail"), F.max("f").alias("f")
    )
    return joined.select("lang", F.concat(F.split("start", " "), F.col("tail")).alias("words"), "f")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact up to counts of 10^15: products are decimals of 38 digits."""
    wide = lambda c: c.cast("decimal(16,0)")
    over = F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a))
    return F.call_function("div", over, wide(left) * wide(right))


def candidates(counts: DataFrame) -> DataFrame:
    """All phrases that stay, with the counts of their parts: (lang, phrase, a, cuts).

    ``cuts`` holds one (k, l, r) per way to part the phrase. The longest phrases are read off the paths: an
    inner node of a path has the path's count, so only the outer nodes are looked up. Shorter phrases are the frequent nodes
    that no edge covers; inner nodes of paths never stay.
    """
    nodes = counts.where(F.col("k") == LONGEST - 1).select("lang", F.col("gram").alias("node"), F.col("f").alias("n_node"))
    words = counts.where(F.col("k") == 1).select("lang", F.col("gram").alias("word"), F.col("f").alias("n_word"))
    phrase = lambda c, i, n: F.array_join(F.slice(c, i, n), " ")
    paths = unary_paths(counts).withColumns({
        "first": phrase("words", 1, LONGEST - 1), "last": phrase("words", F.size("words") - (LONGEST - 2), LONGEST - 1),
        "windows": F.size("words") - (LONGEST - 1),
    })
    ends = paths.join(nodes.select("lang", F.col("node").alias("first"), F.col("n_node").alias("n_first")), ["lang", "first"]).join(
        nodes.select("lang", F.col("node").alias("last"), F.col("n_node").alias("n_last")), ["lang", "last"]
    )
    window = lambda i: F.struct(
        phrase("words", i, LONGEST).alias("phrase"),
        F.when(i == 1, F.col("n_first")).otherwise(F.col("f")).alias("n_front"),
        F.when(i == F.col("windows"), F.col("n_last")).otherwise(F.col("f")).alias("n_back"),
    )
    long = ends.select("lang", F.col("f").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("windows")), window)).alias("w"))
    none = F.lit(None).cast("bigint")
    long = long.select("lang", "w.phrase", "a", "w.n_front", "w.n_back")
    short = counts.where((F.col("k") == LONGEST - 1) & (100 * F.greatest("leaving", "arriving") < COVERED * F.col("f"))).select(
        "lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), none.alias("n_front"), none.alias("n_back")
    )
    both = long.unionByName(short).withColumns({"one": _first("phrase", 1), "other": _last("phrase", 1)})
    named = both.join(words.select("lang", F.col("word").alias("one"), F.col("n_word").alias("n_one")), ["lang", "one"]).join(
        words.select("lang", F.col("word").alias("other"), F.col("n_word").alias("n_other")), ["lang", "other"]
    )
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    cuts = F.when(F.col("n_back").isNull(), F.array(cut(1, "n_one", "n_other"))).otherwise(
        F.array(cut(1, "n_one", "n_back"), cut(2, "n_front", "n_other"))
    )
    return named.select("lang", "phrase", "a", cuts.alias("cuts"))


def collocations(docs: DataFrame, top: int = TOP, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """The strongest phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    Phrases of two and three words that occur ``min_count`` times or more, scored by their weakest cut (of
    equal ones the first). A phrase goes if a longer candidate holds at least half of its places. Ranks follow score and count
    downwards, then the bytes of the phrase. Empty tables, and languages without a frequent phrase, give no rows; repeated
    documents count as often as they occur; other columns are not read.
    """
    counts = phrase_counts(docs, min_count, text, lang)
    held = candidates(counts)
    weighed = F.transform("cuts", lambda c: F.struct(_score(F.col("a"), c["l"], c["r"]).alias("score"), c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    scored = held.select("lang", "phrase", "a", F.array_min(weighed).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
