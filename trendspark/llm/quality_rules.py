"""Quality rules as a short-circuit cascade, in Spark expressions only."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from trendspark.llm.common import SPACES, let, word_array
from trendspark.session import stage

SYMBOLS = "[#*$%&|<>]"


def repeated_words(words: Column) -> Column:
    """How many words stand in a 3-word window that occurs twice or more, first occurrences included.

    Windows are compared by 64-bit hashes of their words. Only a text with repeats pays for the sort
    that finds where they are: of the sorted starts each window adds the words the one before it
    did not cover, three at most. Time is n log n in the words of one text, memory linear.
    """

    def covered(hashes: Column) -> Column:
        return let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda pairs: F.aggregate(
                F.sort_array(
                    F.transform(
                        F.filter(
                            pairs,
                            lambda p, k: F.coalesce(p["h"] == F.get(pairs, k - 1)["h"], F.lit(False))
                            | F.coalesce(p["h"] == F.get(pairs, k + 1)["h"], F.lit(False)),
                        ),
                        lambda p: p["i"],
                    )
                ),
                F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
                lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            ),
        )

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    repeats = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(words) >= 3, repeats).otherwise(F.lit(0).cast("bigint"))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of the whole text.

    Lines are parted by ``\\n`` and count if they hold a word; one equal to an earlier line is a
    duplicate. Null, empty and blank texts have no words and lines. Columns of these names are replaced.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    # One expression yields all counts of a text, so words and lines are split once.
    of_words = let(
        word_array(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(
        F.filter(F.split(value, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != ""),
        lambda lines: F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    counted = docs.withColumns(
        {"__words": of_words, "__lines": of_lines, "n_symbols": F.regexp_count(value, F.lit(SYMBOLS)).cast("bigint")}
    )
    return counted.withColumns(
        {name: F.col(f"__words.{name}") for name in ("n_words", "word_chars", "n_repeat_words")}
        | {name: F.col(f"__lines.{name}") for name in ("n_lines", "n_dup_lines")}
    ).drop("__words", "__lines")


@dataclass(frozen=True)
class Rule:
    """A named test; ``fails`` is a Boolean expression that is true for rows to reject, null counts as false."""

    name: str
    fails: Column


def default_rules(text: str = "text") -> list[Rule]:
    """Rules over the columns of ``with_counts`` and, the costly ones, over the text itself."""
    value = F.coalesce(F.col(text), F.lit(""))
    words, chars = F.col("n_words"), F.col("word_chars")
    letters = F.length(F.regexp_replace(value, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(value, r"\P{Lu}+", ""))
    return [
        Rule("few words", words < 50),
        Rule("repeated words", 100 * F.col("n_repeat_words") > 50 * words),
        Rule("word length", (chars < 2 * words) | (chars > 15 * words)),
        Rule("symbols", 10 * F.col("n_symbols") > words),
        # One heading that comes twice in a short text is no sign of bad quality.
        Rule("repeated lines", (F.col("n_dup_lines") > 2) & (10 * F.col("n_dup_lines") > 3 * F.col("n_lines"))),
        Rule("few letters", 10 * letters < 6 * chars),
        Rule("capitals", 10 * capitals > 6 * chars),
        Rule("exclamations", 5 * F.regexp_count(value, F.lit("[!?]{2}")) > words),
    ]


def order_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2_000, runs: int = 2) -> list[Rule]:
    """Order rules by rejections per second, as a sample of about ``sample_rows`` rows shows them.

    The sample is drawn over the whole table, counted and written once; each rule is then timed on it alone,
    the better of ``runs`` runs, less the time of a rule that tests nothing. Only the order depends on
    it, never a verdict. An empty table leaves the order as given.
    """
    size = docs.count()
    if not size:
        return list(rules)
    # Drawn in all tasks of the scan; only the few rows drawn are counted and brought together.
    drawn = docs.sample(min(1.0, sample_rows / size), seed=7).repartition(1)
    sample = stage(with_counts(drawn, text), "rule-sample")

    def measure(fails: Column) -> tuple[float, int]:
        best, rejected = float("inf"), 0
        for _ in range(runs):
            begun = time.perf_counter()
            rejected = sample.agg(F.count_if(fails)).first()[0]
            best = min(best, time.perf_counter() - begun)
        return best, rejected

    idle, _ = measure(F.lit(False))
    gain = {}
    for rule in rules:
        seconds, rejected = measure(rule.fails)
        gain[rule.name] = rejected / max(seconds - idle, 1e-3)
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(rules: Sequence[Rule]) -> Column:
    """Whether a row passes all rules; once one rejects it, the later ones are not worked out."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(F.coalesce(rule.fails, F.lit(False)), F.lit(False)).otherwise(verdict)
    return verdict


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] | None = None, sample_rows: int = 2_000) -> DataFrame:
    """Add the counts, ``base_failed`` (few or mostly repeated words) and ``kept``, the verdict of all rules.

    Every row stays. A null or empty text has no words and fails. ``rules`` are ordered on a sample
    first; they may refer to the columns of ``with_counts``.
    """
    counted = with_counts(docs, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rules = default_rules(text) if rules is None else rules
    ordered = order_rules(docs, rules, text, sample_rows)
    return counted.withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & cascade(ordered))
