"""Byte-level BPE by backtracking over longest matches."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from trendspark.llm.common import raw

PIECES, PAIRS = 1 << 17, 1 << 16  # entries the memos may hold before they start anew; they bound memory, not results
LONGEST_KEPT = 64  # characters of a piece that is kept, which bounds the memo in bytes too
ROWS = 512  # rows whose ids are held at once


class Memo(dict):
    """What a function gave for its latest arguments; when full, its entries are kept aside for another round."""

    def __init__(self, work: Callable, most: int):
        super().__init__()
        self.work, self.most, self.older = work, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.work(key)
            if type(key) is str and len(key) > LONGEST_KEPT:
                return value
        if len(self) >= self.most:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


class BytePairCodec:
    """Encodes as merging the best-ranked neighbours again and again would, in linear time.

    Bytes are mapped to the characters 0 to 255, so an Aho-Corasick automaton over the vocabulary
    finds the longest token from a place on. A prefix of an encoding is the encoding of that prefix
    exactly if all its neighbours are compatible, that is, no merge would have crossed their border.
    So the encoder takes the longest token that is compatible with the one before, and
    falls back to shorter tokens, or one token back, never visiting a dead end twice.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.spelled = {str(rank): token for rank, token in self.tokens.items()}
        self.pattern = regex.compile(pattern)
        missing = [b for b in range(256) if chr(b) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self.compatible = Memo(lambda pair: self._fits(*pair), PAIRS)
        self.shown = Memo(self._show, PIECES)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.sizes = {rank: len(token) for rank, token in self.tokens.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token, rank)
        self.automaton.make_automaton()
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            self._learn(token, rank)
        for token, rank in self.ranks.items():
            self.shorter[rank] = next((self.ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in self.ranks), None)

    def _learn(self, token: str, rank: int) -> None:
        """Find the last merge that makes the token: two earlier tokens that may stand side by side."""
        for k in range(1, len(token)):
            left, right = self.ranks.get(token[:k]), self.ranks.get(token[k:])
            if left is not None and right is not None and max(left, right) < rank and self._fits(left, right):
                self.parts[rank] = (left, right)
                self.joined[left, right] = rank
                return

    def _fits(self, left: int, right: int) -> bool:
        """Whether BPE can leave ``left`` and ``right`` side by side.

        The merges that made the two tokens are undone at their border, the latest first. Had
        two parts met there that merge before the undone step, the border could not have stayed.
        """
        limit = None
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and (limit is None or merged < limit):
                return False
            a, b = self.parts.get(left), self.parts.get(right)
            if a is None and b is None:
                return True
            # Of two merges of one rank the left one comes first, so the right one is undone first.
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def encode_piece(self, piece: str) -> list[int]:
        """The ids of one match of the pattern, given as Latin-1 characters."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        compatible, longest = self.compatible, self.automaton.iter_long
        # The longest token from the start, then from its end, and so on; mostly that is the answer.
        ids = [rank for _, rank in longest(piece)]
        good = 1
        for pair in zip(ids, ids[1:]):
            if not compatible[pair]:
                break
            good += 1
        else:
            return ids
        sizes, shorter = self.sizes, self.shorter
        dead = set()
        token = ids[good]
        del ids[good:]
        at = sum(map(sizes.__getitem__, ids))
        while True:
            end = at + sizes[token]
            if end not in dead and (not ids or compatible[ids[-1], token]):
                ids.append(token)
                at = end
                if at == len(piece):
                    return ids
                token = next(longest(piece, at))[1]
                continue
            token = shorter[token]
            while token is None:
                dead.add(at)
                last = ids.pop()
                at -= sizes[last]
                token = shorter[last]

    def _show(self, match: str) -> str:
        return " ".join(map(str, self.encode_piece(match.encode("utf-8").decode("latin-1"))))

    def encode(self, text: str) -> str:
        """The ids of a text in decimal, one space between."""
        return " ".join(map(self.shown.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: str) -> bytes:
        """The bytes that decimal ids stand for."""
        return "".join(map(self.spelled.__getitem__, ids.split(" "))).encode("latin-1") if ids else b""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of the bytes, a space, the rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def share_ranks(spark: SparkSession, path: str) -> Broadcast:
    """Send the vocabulary to the executors; its size is that of the file, not of the data."""
    return spark.sparkContext.broadcast(load_ranks(path))


_codecs: dict[str, BytePairCodec] = {}


def _codec(shared: Broadcast, pattern: str, key: str) -> BytePairCodec:
    """One codec per worker process and vocabulary."""
    if key not in _codecs:
        _codecs[key] = BytePairCodec(shared.value, pattern)
    return _codecs[key]


def with_tokens(docs: DataFrame, shared: Broadcast, pattern: str, text: str = "text", ids: bool = True) -> DataFrame:
    """Replace the text by its token ids and the digests of a round trip.

    Adds n_tokens, ids_sha256 (of the decimal ids with single spaces), decoded_sha256 (of the bytes
    the ids decode to) and, with ``ids``, the ids themselves as an array. Null counts as the empty
    text, which has no tokens. Long texts are encoded whole. Columns that already have these names are replaced, all
    others pass through.
    """
    names = ("n_tokens", "ids_sha256", "decoded_sha256", *(("ids",) if ids else ()))
    rest = [c for c in docs.columns if c != text and c not in names]
    frame = docs.select(*rest, raw(text).alias("n_tokens"))
    added = [F.lit(0).cast("bigint").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")]
    if ids:
        added.append(F.array().cast("array<int>").alias("ids"))
    schema = docs.select(*rest, *added).schema

    key = hashlib.sha256(repr((pattern, sorted(shared.value.items()))).encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern, key)
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            counts, digests, decoded, numbers = [], [], [], []
            for value in batch.column(batch.num_columns - 1):
                shown = codec.encode(value.as_py().decode("utf-8", "replace"))
                counts.append(shown.count(" ") + 1 if shown else 0)
                digests.append(hashlib.sha256(shown.encode("ascii")).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(shown)).hexdigest())
                if ids:
                    numbers.append(np.fromstring(shown, np.int32, sep=" "))
            columns = [*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if ids:
                columns.append(pa.array(numbers, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return frame.mapInArrow(work, schema)
