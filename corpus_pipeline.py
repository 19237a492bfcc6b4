"""From raw documents to token ids: five stages, each of which works on all that the one before it kept.

Language ID drops texts whose language cannot be told, line de-duplication cuts repeated lines, SimHash keeps one of
each group of near duplicates, the mix repeats or leaves out documents until the sources meet their weights, and
byte-level BPE encodes what the mix holds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trendspark.llm import byte_bpe, language_id, line_dedup, mixing, simhash
from trendspark.llm.common import read
from trendspark.session import new_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

MIN_SCORE = 0.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a posterior of at least ``MIN_SCORE``; no letter, no language."""
    packed = docs.select("doc_id", "text", "lang", F.struct(*docs.columns).alias("__row"))
    judged = language_id.identify(packed, ("__row",))
    return judged.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select("__row.*")


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before. One that had text and loses all of it goes; ``n_chars`` follows the text."""
    packed = docs.select("doc_id", "text", F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("__row"))
    cut = line_dedup.without_repeated_lines(packed)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("__row.n_chars")).alias("n_chars")
    return left.select(*[own.get(c, F.col(f"__row.`{c}`")) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each_group(docs)


def weighted_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those of a shard together in random order."""
    return mixing.mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    import public_tokenizers

    ranks = byte_bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.with_tokens(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Stage]] = [
    ("language ID", known_language),
    ("line dedup", new_lines),
    ("SimHash near-dedup", one_of_each),
    ("mixing sources to target weights", weighted_mix),
    ("byte-level BPE encoding and decoding", token_ids),
]

# No stage can be expressed in SQL: models, fingerprints, hypergeometric draws and merges; the tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
