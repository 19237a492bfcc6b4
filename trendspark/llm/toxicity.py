"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trendspark.llm.common import raw
from trendspark.session import stage

BUCKET_BITS = 18
STEMS = (4, 5)  # letters of the beginnings that count as terms beside the whole words
FACTORS = 8
MAX_TEXTS = 20_000  # different texts of a label that are learned from, about; a documented bound
MAX_BUCKETS = 4_096  # buckets that may have weight, those that part the labels best
MIN_TEXTS, MIN_DEVIATIONS = 3, 4.0  # a bucket needs so many texts, and shares of them that differ by so many deviations
EPOCHS = 12
BATCH = 64
RATE, SMOOTH, SPARSE, SHRINK = 0.5, 1.0, 0.5, 1e-4
MEMO = 1 << 16  # words whose buckets a worker remembers; it bounds memory, not results
ROWS = 256  # rows scored at once
LIMIT = 0.7

_word = re.compile(r"[^\W_]+")
_memo: dict[str, tuple[int, ...]] = {}


def _buckets(word: str) -> tuple[int, ...]:
    """The buckets of a word: itself, and its beginnings if it is longer."""
    known = _memo.get(word)
    if known is None:
        if len(_memo) >= MEMO:
            _memo.clear()
        parts = [word, *(word[:n] + "-" for n in STEMS if len(word) >= n)]
        known = _memo[word] = tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) >> (32 - BUCKET_BITS) for p in parts)
    return known


def terms(text: str) -> np.ndarray:
    """The different buckets of a whole text in ascending order: letters and digits only, in lower case."""
    seen: set[int] = set()
    for word in set(_word.findall(text.lower())):
        seen.update(_buckets(word))
    return np.sort(np.fromiter(seen, np.int32, len(seen)))


class FactorizationMachine:
    """bias + sum of w[i] + sum of v[i] . v[j] over all pairs of a text's terms, as a logit."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def logits(self, indices: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """One logit per text; ``indices`` holds the terms of all texts one after the other."""
        ends = np.cumsum(lengths)
        held = lambda x: np.diff(np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)))[np.concatenate(([0], ends))], axis=0)
        v = self.v[indices].astype(np.float64)
        pairs = 0.5 * ((held(v) ** 2).sum(axis=1) - held((v ** 2).sum(axis=1)))
        return self.bias + held(self.w[indices].astype(np.float64)) + pairs

    def score(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(np.concatenate([np.zeros(0, np.int32), *texts]), lengths), -30, 30)))


def train(texts: Sequence[np.ndarray], labels: np.ndarray, seed: int = 0) -> FactorizationMachine:
    """Learn by small batches: weights by FTRL with an L1 term, so that words without bearing keep none, factors by AdaGrad.

    Terms that no text has keep zeros. Without texts of both labels there is nothing to learn; the machine
    then only has a bias.
    """
    n = 1 << BUCKET_BITS
    draw = np.random.default_rng(seed)
    w, v = np.zeros(n), np.zeros((n, FACTORS))
    share = (labels.sum() + 0.5) / (len(labels) + 1.0)
    bias = float(np.log(share / (1.0 - share)))
    if len(labels) == 0 or labels.min() == labels.max():
        return FactorizationMachine(bias, w.astype(np.float32), v.astype(np.float32))
    held = np.unique(np.concatenate(texts))
    v[held] = draw.normal(0.0, 0.05, (len(held), FACTORS))
    z, squares, v_squares, b_squares = np.zeros(n), np.zeros(n), np.full((n, FACTORS), 1e-2), SMOOTH
    for _ in range(EPOCHS):
        order = draw.permutation(len(texts))
        for a in range(0, len(order), BATCH):
            chosen = order[a:a + BATCH]
            rows = [texts[i] for i in chosen]
            lengths = np.fromiter(map(len, rows), np.int64, len(rows))
            of = np.repeat(np.arange(len(rows)), lengths)
            own, at = np.unique(np.concatenate(rows), return_inverse=True)
            w_own, v_own = w[own], v[own]
            entries = v_own[at]
            sums = np.stack([np.bincount(of, entries[:, k], len(rows)) for k in range(FACTORS)], axis=1)
            pairs = 0.5 * ((sums ** 2).sum(axis=1) - np.bincount(of, (entries ** 2).sum(axis=1), len(rows)))
            logit = bias + np.bincount(of, w_own[at], len(rows)) + pairs
            error = 1.0 / (1.0 + np.exp(-np.clip(logit, -30, 30))) - labels[chosen]
            b_squares += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(b_squares)
            g = np.bincount(at, error[of], len(own))
            step = (np.sqrt(squares[own] + g * g) - np.sqrt(squares[own])) / RATE
            z[own] += g - step * w_own
            squares[own] += g * g
            w[own] = np.where(np.abs(z[own]) <= SPARSE, 0.0, (np.sign(z[own]) * SPARSE - z[own]) / ((SMOOTH + np.sqrt(squares[own])) / RATE))
            pull = error[of][:, None] * (sums[of] - entries)
            g_v = np.stack([np.bincount(at, pull[:, k], len(own)) for k in range(FACTORS)], axis=1) + SHRINK * v_own
            v_squares[own] += g_v ** 2
            v[own] = v_own - 0.1 * RATE * g_v / np.sqrt(v_squares[own])
    return FactorizationMachine(bias, w.astype(np.float32), v.astype(np.float32))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether labels of the row are not to be learned from; a null id does not count as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _with_terms(rows: DataFrame) -> DataFrame:
    """Replace the binary column ``text`` by the buckets of its terms."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(t.as_py().decode("utf-8", "replace")) for t in batch.column("text")]
            columns = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int32()))], names=schema.names)

    schema = rows.drop("text").withColumn("terms", F.array().cast("array<int>")).schema
    return rows.mapInArrow(work, schema)


def telling_buckets(sample: DataFrame) -> DataFrame:
    """Buckets whose share of toxic texts differs most from their share of others: (bucket, z), MAX_BUCKETS at most."""
    p, q = sample.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    counts = sample.select("label", F.explode("terms").alias("bucket")).groupBy("bucket").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )
    if not p or not q:
        return counts.select("bucket", F.lit(0.0).alias("z")).limit(0)
    share = (F.col("a") + F.col("b")) / F.lit(float(p + q))
    spread = F.sqrt(share * (1 - share) * F.lit(1 / p + 1 / q))
    z = F.when(spread > 0, (F.col("a") / F.lit(float(p)) - F.col("b") / F.lit(float(q))) / spread)
    kept = counts.withColumn("z", z).where((F.col("a") + F.col("b") >= MIN_TEXTS) & (F.abs("z") >= MIN_DEVIATIONS))
    return kept.orderBy(F.desc(F.abs("z")), "bucket").limit(MAX_BUCKETS).select("bucket", "z")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, text: str = "text", label: str = "toxic") -> FactorizationMachine:
    """Learn from the labelled rows that ``usable`` allows.

    At most about MAX_TEXTS different texts of each label are read, drawn by a hash of the text, so reruns agree; that is the
    documented bound of the sample. Copies count once, with the label that most of them have (toxic if even). Null texts,
    null ids and null labels take no part. The tasks count terms; the driver gets the telling buckets and, of each
    text in the sample, those it has, and trains on them. Shares that were drawn differently are made up for in the bias.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col(text).cast("binary").alias("text")).where(usable & F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    rows = rows.withColumns({"hash": F.xxhash64("text"), "twin": F.xxhash64(F.lit(1), "text")})
    marks = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("mark"))
    once = rows.groupBy("doc_id", "hash", "twin").agg(F.count("*").alias("n"))
    texts = stage(
        once.join(marks, "doc_id").groupBy("hash", "twin").agg(
            F.when(F.sum(F.col("mark") * F.col("n")) >= 0.5 * F.sum("n"), 1).otherwise(0).alias("label"), F.min("doc_id").alias("doc_id")
        ),
        "texts",
    )
    found = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shares = {k: min(1.0, MAX_TEXTS / n) for k, n in found.items()}
    draw = F.pmod(F.col("hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = texts.where(draw < F.when(F.col("label") == 1, shares.get(1, 0.0)).otherwise(shares.get(0, 0.0)))
    # About 2 * MAX_TEXTS rows of four numbers at most, so the texts stay where they are.
    chosen = rows.join(F.broadcast(drawn), ["doc_id", "hash", "twin"]).select("hash", "twin", "label", "text")
    sample = stage(_with_terms(chosen).groupBy("hash", "twin").agg(F.first("label").alias("label"), F.first("terms").alias("terms")), "sample")
    kept = np.zeros(1 << BUCKET_BITS, bool)
    kept[[r["bucket"] for r in telling_buckets(sample).collect()]] = True
    shared = spark.sparkContext.broadcast(kept)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.asarray(x.as_py(), np.int32) for x in batch.column("terms")]
            left = pa.array([x[shared.value[x]] for x in lists], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], left], names=batch.schema.names)

    learned = sample.mapInArrow(told, sample.schema).toArrow().sort_by([("hash", "ascending"), ("twin", "ascending")])
    machine = train([np.asarray(x.as_py(), np.int32) for x in learned.column("terms")], learned.column("label").to_numpy().astype(np.float64))
    if len(shares) == 2:
        machine.bias -= float(np.log(shares[1] / shares[0]))
    return machine


def with_score(docs: DataFrame, machine: FactorizationMachine, text: str = "text", name: str = "score") -> DataFrame:
    """Replace the text column by the probability that its label is 1, read off the whole text alone.

    Null, empty and wordless texts get what the bias says. A column that is already called ``name`` is replaced,
    all others pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rest = [c for c in docs.columns if c not in (text, name)]
    schema = docs.select(*rest, F.lit(0.0).alias(name)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            scores = known.score([terms(t.as_py().decode("utf-8", "replace")) for t in batch.column(batch.num_columns - 1)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=schema.names)

    return docs.select(*rest, raw(text).alias(name)).mapInArrow(work, schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from rows that are not held out and score all: (doc_id, held_out, score, predicted), one row per row of ``docs``."""
    machine = fit(docs.select("doc_id", "text"), labels, ~held_out())
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return with_score(rows, machine).withColumn("predicted", F.when(F.col("score") >= LIMIT, 1).otherwise(0))
