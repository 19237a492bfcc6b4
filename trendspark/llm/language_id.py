"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trendspark.llm.common import chunks
from trendspark.session import stage

UNKNOWN = "und"
ORDERS = (1, 2, 3)
BUCKET_BITS = 15
BLOCK = 1 << 20  # characters of a text that are hashed at once
MAX_LANGUAGES = 1_000  # times 2**15 doubles: the broadcast matrix stays below 262 MB


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket of character n-grams occurs in the whole lower-cased text."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for a, b in chunks(len(text), BLOCK):
        piece = text[a:b + max(ORDERS) - 1].lower().encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(piece, np.uint32)
        own = len(text[a:b].lower())
        rolling = np.zeros(len(points), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if len(points) < n:
                break
            rolling = (rolling[: len(points) - n + 1] + points[n - 1:] + np.uint32(n)) * np.uint32(0x9E3779B1)
            rolling ^= rolling >> np.uint32(15)
            if n in ORDERS:
                bucket = (rolling[:own] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BUCKET_BITS)
                counts += np.bincount(bucket, minlength=1 << BUCKET_BITS)
    return counts


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _texts(column: pa.Array) -> Iterator[str]:
    return (t.as_py().decode("utf-8", "replace") if t.is_valid else "" for t in column)


class LanguageModel:
    """Log probabilities: one row per bucket, one column per language."""

    def __init__(self, languages: list[str], log_prob: np.ndarray):
        self.languages = languages
        self.log_prob = log_prob

    def score(self, text: str) -> tuple[str, float]:
        """The likeliest language and its posterior under equal priors; ``und`` and 0 without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts = gram_counts(text)
        (seen,) = counts.nonzero()
        likelihood = counts[seen].astype(np.float64) @ self.log_prob[seen]
        best = int(likelihood.argmax())
        return self.languages[best], float(1.0 / np.exp(likelihood - likelihood[best]).sum())


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", max_docs_per_language: int = 4_000) -> LanguageModel:
    """Learn from the labelled rows that ``usable`` allows.

    At most about ``max_docs_per_language`` different texts of a language are read, the documented bound
    of the sample, and all if it has no more; a hash of the text decides which, so reruns agree. Copies count as one text. Rows
    with a null label are never used; without any usable row the model knows no language.
    Counting happens in the tasks; only bucket counts reach the driver, at most languages x 2**15 sums.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).cast("binary").alias("text")).where(
        usable & F.col(lang).isNotNull() & F.col(text).isNotNull()
    )
    # Two hashes tell texts apart; the texts themselves stay where they are until they are drawn.
    rows = rows.withColumns({"hash": F.xxhash64("text"), "twin": F.xxhash64(F.lit(1), "text")})
    texts = stage(rows.select("lang", "hash", "twin").distinct(), "texts")
    sizes = texts.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0)))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, max_docs_per_language / r["n"]))])
    draw = F.pmod(F.col("hash"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "hash", "twin"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), _texts(batch.column("text")), strict=True):
                grams = gram_counts(text)
                sums[lang] = sums[lang] + grams if lang in sums else grams
        for lang, total in sums.items():
            (seen,) = total.nonzero()
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    partial = sample.mapInArrow(count, "lang string, bucket int, n bigint")
    found = partial.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    table = np.ones((1 << BUCKET_BITS, len(languages)))  # add-one smoothing
    column = {x: i for i, x in enumerate(languages)}
    table[found["bucket"].to_numpy(np.int64), found["lang"].map(column).to_numpy(np.int64)] += found["n"].to_numpy(np.float64)
    return LanguageModel(languages, np.log(table / table.sum(axis=0)))


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Replace the text column by (lang_pred, score), read off the whole text alone.

    Null, empty and letterless texts get ``und`` and 0. Ties go to the language that sorts first. Columns that already
    have these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    frame = docs.select(*rest, F.col(text).cast("binary").alias("lang_pred"))
    schema = docs.select(*rest, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            found = [known.score(t) for t in _texts(batch.column(batch.num_columns - 1))]
            columns = [
                *batch.columns[:-1],
                pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "score"])

    return frame.mapInArrow(work, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the row belongs to the held-out quarter; a null id does not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn on the rows that are not held out and predict all: (doc_id, *carry, held_out, lang_pred, score).

    A null doc_id counts as not held out but is not learned from either. Carried columns with the names of results are replaced.
    """
    carry = tuple(c for c in carry if c not in ("doc_id", "held_out", "lang_pred", "score"))
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    rows = docs.select("doc_id", *carry, held_out().alias("held_out"), F.col("text").alias("_text"))
    return with_language(rows, model, "_text")
