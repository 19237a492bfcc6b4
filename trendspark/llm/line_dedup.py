"""Line de-duplication by winnowing over line hashes."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from trendspark.llm.common import raw, row_key
from trendspark.session import stage

GRAM_WORDS = 25  # a repeated run of whole lines with fewer words is left alone
WINDOW_WORDS = 50  # a repeated run with as many words is always found


def split_lines(text: bytes) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """The lines of a text, the places of those with a word, and hashes and word counts of these.

    Lines are compared without regard to the white space around and between their words.
    """
    lines = text.split(b"\n")
    places, hashes, words = [], [], []
    for i, line in enumerate(lines):
        if parts := line.split():
            places.append(i)
            hashes.append(xxhash.xxh64_intdigest(b" ".join(parts)))
            words.append(len(parts))
    return lines, places, np.array(hashes, np.uint64), np.array(words, np.int64)


def winnow(hashes: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Fingerprints (hash, first line) of a text.

    A gram is the shortest run of lines from a line on with ``GRAM_WORDS`` words. From the grams inside
    the shortest run from a line on with ``WINDOW_WORDS`` words, the one with the smallest hash
    is chosen, the last of equals. Which one that is depends on the lines of the window alone, so a run of that many
    words has a fingerprint in common wherever it occurs.
    """
    n, ends = len(hashes), np.concatenate(([0], np.cumsum(words)))
    # The line after the shortest run from each line on that has enough words; n + 1 if there is none.
    after_gram = np.searchsorted(ends, ends[:-1] + GRAM_WORDS)
    after_window = np.searchsorted(ends, ends[:-1] + WINDOW_WORDS)
    chosen: list[tuple[int, int]] = []
    queue: deque[tuple[int, int]] = deque()
    data, upto = hashes.tobytes(), 0
    for i in range(n):
        if after_window[i] > n:
            break
        while upto < n and after_gram[upto] <= after_window[i]:
            gram = xxhash.xxh64_intdigest(data[8 * upto:8 * after_gram[upto]])
            while queue and queue[-1][0] >= gram:
                queue.pop()
            queue.append((gram, upto))
            upto += 1
        while queue[0][1] < i:
            queue.popleft()
        if not chosen or chosen[-1] != queue[0]:
            chosen.append(queue[0])
    return chosen


def _line_table(docs: DataFrame) -> DataFrame:
    """(key, doc_id, hashes, words, grams, starts) of each different document."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, words, grams, starts = [], [], [], []
            for text in batch.column("text"):
                _, _, h, w = split_lines(text.as_py())
                chosen = winnow(h, w)
                hashes.append(h.view(np.int64))
                words.append(w.astype(np.int32))
                grams.append(np.array([g for g, _ in chosen], np.uint64).view(np.int64))
                starts.append(np.array([s for _, s in chosen], np.int32))
            longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("doc_id"), pa.array(hashes, longs), pa.array(words, ints), pa.array(grams, longs), pa.array(starts, ints)],
                names=["key", "doc_id", "hashes", "words", "grams", "starts"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"key bigint, doc_id {kind}, hashes array<bigint>, words array<int>, grams array<bigint>, starts array<int>"
    return docs.mapInArrow(work, schema).dropDuplicates(["key"])


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements at the beginning of ``a`` and ``b`` agree; looks no further than twice as far."""
    n, done, step = min(len(a), len(b)), 0, 64
    while done < n:
        same = a[done:min(n, done + step)] == b[done:min(n, done + step)]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + len(same), 2 * step
    return n


def extend(here: np.ndarray, there: np.ndarray, ends: np.ndarray, at: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches (first, last) of ``here`` covered by common runs of ``GRAM_WORDS`` words through the places ``at`` (here, there).

    ``ends`` are the sums of words before each line. A match inside the present stretch is extended only if the
    line just before or behind the stretch agrees as well; otherwise it adds nothing. So a text of
    many equal lines is gone through once and not once a line.
    """
    stretches, low, high = [], 0, -1
    for i, j in sorted(at):
        if i <= high:
            after, before = j + high + 1 - i, j + low - 1 - i
            on = high + 1 < len(here) and after < len(there) and here[high + 1] == there[after]
            if not on and not (low > 0 and before >= 0 and here[low - 1] == there[before]):
                continue
        back = _agree(here[:i][::-1], there[:j][::-1]) if i and j else 0
        first, last = i - back, i + _agree(here[i:], there[j:]) - 1
        if ends[last + 1] - ends[first] < GRAM_WORDS:
            continue
        if first <= high:
            low, high = min(low, first), max(high, last)
            # Reaching back over earlier stretches makes one of them.
            while stretches and stretches[-1][1] >= low:
                low = min(low, stretches.pop()[0])
        else:
            low, high = first, last
        stretches.append((low, high))
    return stretches


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (key, first, last) of lines of a later text that an earlier one has as well."""
    for batch in batches:
        keys, firsts, lasts = [], [], []
        for row in batch.to_pylist():
            base, other = row["here_from"], row["there_from"]
            found = extend(
                np.array(row["here"]), np.array(row["there"]), np.concatenate(([0], np.cumsum(row["words"]))),
                [(m["pos"] - base, m["other"] - other) for m in row["at"]],
            )
            keys += [row["key"]] * len(found)
            firsts += [first + base for first, _ in found]
            lasts += [last + base for _, last in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["key", "first", "last"]
        )


def windows(hashes: np.ndarray, words: np.ndarray, at: list[int]) -> list[tuple[int, int, int]]:
    """(hash, first line, last line) of the shortest runs from and up to each line with ``WINDOW_WORDS`` words that hold a line of ``at``."""
    ends = np.concatenate(([0], np.cumsum(words)))
    after = np.searchsorted(ends, ends[:-1] + WINDOW_WORDS)
    start = np.searchsorted(ends, ends[1:] - WINDOW_WORDS, side="right") - 1
    n, marks, data = len(hashes), np.array(sorted(at)), hashes.tobytes()
    spans = {(i, int(j)) for i, j in enumerate(after) if j <= n} | {(int(i), j + 1) for j, i in enumerate(start) if i >= 0}
    held = [(i, j) for i, j in sorted(spans) if np.searchsorted(marks, i) < np.searchsorted(marks, j)]
    return [(xxhash.xxh64_intdigest(data[8 * i:8 * j]), i, j - 1) for i, j in held]


def _window_table(marked: DataFrame) -> DataFrame:
    """(key, doc_id, window, pos, last) of the windows around the marked lines."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes, words, at = (batch.column(c)[row].as_py() for c in ("hashes", "words", "at"))
                found = windows(np.array(hashes, np.int64), np.array(words, np.int64), at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.repeat(batch.column("key")[row], len(found)), pa.repeat(batch.column("doc_id")[row], len(found)),
                        pa.array(np.array([h for h, _, _ in found], np.uint64).view(np.int64)),
                        pa.array([i for _, i, _ in found], pa.int32()), pa.array([j for _, _, j in found], pa.int32()),
                    ],
                    names=["key", "doc_id", "window", "pos", "last"],
                )

    kind = dict(marked.dtypes)["doc_id"]
    return marked.select("key", "doc_id", "hashes", "words", "at").mapInArrow(work, f"key bigint, doc_id {kind}, window bigint, pos int, last int")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """The runs of lines that occurred before: (key, runs), for documents that have any.

    ``docs`` has (key, doc_id, text as bytes). Of all places with one fingerprint the first, by doc_id (null
    last), key and line, is matched with each of the others, never the others among themselves.
    A match is extended line by line in both directions; the later side is a run if it has ``GRAM_WORDS`` words.
    The first holder of a fingerprint need not hold what surrounds it, so around repeated fingerprints all runs of
    ``WINDOW_WORDS`` words are looked up as well, each by its own first place.
    Lines count without the blank ones.
    """
    table = stage(_line_table(docs), "lines")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "pos", "size")
    prints = (
        table.select("doc_id", "key", F.size("hashes").alias("size"), F.explode(F.arrays_zip("grams", "starts")).alias("f"))
        .select("doc_id", "key", "size", F.col("f.grams").alias("gram"), F.col("f.starts").alias("pos"))
        .select("gram", place.alias("place"))
    )
    firsts = prints.groupBy("gram").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = stage(firsts, "firsts")
    found = prints.join(firsts, "gram").where(F.col("place") > F.col("first"))
    pairs = stage(
        found.groupBy(
            F.col("place.key").alias("key"), F.col("place.size").alias("size"),
            F.col("first.key").alias("other_key"), F.col("first.size").alias("other_size"),
        ).agg(F.collect_set(F.struct(F.col("place.pos").alias("pos"), F.col("first.pos").alias("other"))).alias("at")),
        "line-pairs",
    )
    # Of either text no more lines are handed on than can match: as far as the other one reaches.
    shift = F.transform("at", lambda m: m["other"] - m["pos"])
    least, most = F.array_min(shift), F.array_max(shift)
    zero = F.lit(0)
    pairs = pairs.withColumns({
        "here_from": F.greatest(zero, -most), "here_to": F.least(F.col("size"), F.col("other_size") - least),
        "there_from": F.greatest(zero, least), "there_to": F.least(F.col("other_size"), F.col("size") + most),
    })

    def part(column: str, side: str) -> Column:
        return F.slice(column, F.col(f"{side}_from") + 1, F.col(f"{side}_to") - F.col(f"{side}_from"))

    with_there = pairs.join(table.select(F.col("key").alias("other_key"), "hashes"), "other_key")
    with_there = with_there.withColumn("there", part("hashes", "there")).drop("hashes")
    with_both = with_there.join(table.select("key", "hashes", "words"), "key")
    rows = with_both.select(
        "key", "at", "here_from", "there_from", "there", part("hashes", "here").alias("here"), part("words", "here").alias("words")
    )
    runs = rows.mapInArrow(_extend, "key bigint, first int, last int")
    marks = prints.join(firsts.select("gram"), "gram").groupBy(F.col("place.key").alias("key")).agg(F.collect_set("place.pos").alias("at"))
    around = stage(_window_table(table.select("key", "doc_id", "hashes", "words").join(marks, "key")), "windows")
    spot = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "pos")
    spots = around.select("window", "key", "pos", "last", spot.alias("spot"))
    earliest = spots.groupBy("window").agg(F.min("spot").alias("earliest"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = spots.join(stage(earliest, "earliest"), "window").where(F.col("spot") > F.col("earliest"))
    runs = runs.union(again.select("key", F.col("pos").alias("first"), "last"))
    return runs.groupBy("key").agg(F.collect_set(F.struct("first", "last")).alias("runs"))


def _cut(text: bytes | None, runs: list[dict] | None) -> tuple[bytes | None, int, int]:
    if text is None:
        return None, 0, 0
    lines, places, _, _ = split_lines(text)
    if not runs:
        return text, len(places), 0
    gone = np.zeros(len(lines), bool)
    covered = np.zeros(len(places), bool)
    for run in runs:
        covered[run["first"]:run["last"] + 1] = True
        gone[places[run["first"]]:places[run["last"]] + 1] = True
    left = [line for line, out in zip(lines, gone.tolist(), strict=True) if not out]
    return b"\n".join(left), len(places), int(covered.sum())


def without_repeated_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """Delete runs of whole lines that occurred before, in an earlier document or further up in the same one.

    Adds n_lines (lines with a word) and n_removed (of these, the deleted ones). Rows that agree in
    doc_id and text are one document and are cut alike. A run goes if it has ``GRAM_WORDS`` words;
    runs of ``WINDOW_WORDS`` words are always found. Blank lines inside a run go with it. Null texts stay
    null; a text of which nothing is left becomes empty. No row is dropped. Columns named n_lines and n_removed are replaced.
    """
    keyed = docs.withColumn("__key", row_key("doc_id", text))
    runs = repeated_runs(keyed.select(F.col("__key").alias("key"), "doc_id", raw(text).alias("text")))
    named = stage(runs.select(F.col("key").alias("__key"), F.col("runs").alias("__runs")), "runs")
    # The same plan at every size: a broadcast of few runs would only hide what the texts cost to move.
    joined = keyed.hint("merge").join(named, "__key", "left").withColumn(text, F.col(text).cast("binary"))
    rest = [c for c in docs.columns if c not in (text, "n_lines", "n_removed")]
    schema = docs.select(*rest, text, F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, runs = batch.column(len(rest)), batch.column(len(rest) + 1)
            cut = [_cut(t.as_py(), r.as_py()) for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:len(rest)], pa.array([t if t is None else t.decode("utf-8", "replace") for t, _, _ in cut], pa.string()),
                    pa.array([n for _, n, _ in cut], pa.int32()), pa.array([n for _, _, n in cut], pa.int32()),
                ],
                names=schema.names,
            )

    return joined.select(*rest, text, "__runs").mapInArrow(work, schema)
