"""Information-theoretic sanitisation of personal data.

Identifiers with a fixed form are found by pattern. What else gives a person away is learned from the corpus:
a term that hardly occurs but near one identifier tells almost as much as the identifier itself.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trendspark.llm.common import row_key
from trendspark.session import stage

KINDS = ("email", "ip", "card", "phone", "term")
CONTEXT_WORDS = 5  # words on either side of an identifier that count as near
THRESHOLD = 0.8  # share of an identifier's information that a term may disclose
MIN_CONTEXTS = 2  # different surroundings in which a term must stand near the identifier
FLUSH = 200_000  # terms a task counts before it hands them on

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that does not match from its first digit does not match from a later one either, so
# starting only there and never giving digits back changes nothing but the time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right doubled, digits summed."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards, so the time does not grow with the square of a long word."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", found.end() if found else at + 1)


def identifiers(text: str) -> list[Span]:
    """E-mail and IP addresses, card and phone numbers as (kind, start, end), by start and then kind."""
    spans: list[Span] = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            spans.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                spans.append(("phone", m.start(), m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def show(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _value(kind: str, found: str) -> str:
    """One spelling for one identifier."""
    return f"{kind}:{found.lower()}" if kind in ("email", "ip") else f"{kind}:{''.join(_DIGIT.findall(found))}"


def terms_outside(text: str, spans: list[Span]) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms of a text in order. Letters inside an identifier are no terms."""
    words, k = [], 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        if not any(s[1] < m.end() and m.start() < s[2] for s in spans[k:k + 4]):
            words.append((m.start(), m.end(), m[0].lower()))
    return words


def near_terms(text: str, spans: list[Span], words: list[tuple[int, int, str]]) -> Iterator[tuple[str, str, int]]:
    """(identifier, term, hash of the surroundings) for terms near identifiers."""
    at = 0
    for kind, start, end in spans:
        while at < len(words) and words[at][0] < start:
            at += 1
        near = [w[2] for w in words[max(0, at - CONTEXT_WORDS):at + CONTEXT_WORDS]]
        around = int.from_bytes(hashlib.blake2b(" ".join(near).encode(), digest_size=8).digest(), "little", signed=True)
        for term in sorted(set(near)):
            yield _value(kind, text[start:end]), term, around


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    return (t.as_py().decode("utf-8", "replace") if t.is_valid else "" for t in batch.column("text"))


def _find_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of texts with identifiers: rows with entity, term and surroundings for terms near it, with the entity alone for each, and with term and all its places for each term."""
    for batch in batches:
        out: list[tuple] = []
        for key, text in zip(batch.column("key").to_pylist(), _texts(batch), strict=True):
            if spans := identifiers(text):
                words = terms_outside(text, spans)
                out.extend((key, *row, None) for row in near_terms(text, spans, words))
                out.extend((key, entity, None, None, None) for entity in sorted({_value(kind, text[a:b]) for kind, a, b in spans}))
                places: dict[str, list[Span]] = {}
                for a, b, term in words:
                    places.setdefault(term, []).append(("term", a, b))
                out.extend((key, None, term, None, show(at)) for term, at in places.items())
        names = ["key", "entity", "term", "around", "places"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])
        counts.clear()
        return rows

    for batch in batches:
        for text in _texts(batch):
            counts.update(set(_TERM.findall(text.lower())))
            if len(counts) >= FLUSH:
                yield flush()
    yield flush()


def revealing_terms(docs: DataFrame, held: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Terms that disclose an identifier, with their places: (key, entity, term, places, disclosure).

    With probabilities as shares of all documents, a term discloses the part PMI(entity; term) / IC(entity) of
    the identifier's information content, 1 if it occurs with it alone. A term counts if that part reaches
    ``threshold`` and it stands near the identifier in ``MIN_CONTEXTS`` different surroundings, so words that
    merely occur once, or are copied along, do not. Nearness only names the candidates: that two occur together
    is counted over whole documents.
    """
    n = docs.count()
    near = held.where("entity is not null and term is not null")
    together = near.groupBy("entity", "term").agg(F.count_distinct("around").alias("contexts")).where(F.col("contexts") >= MIN_CONTEXTS)
    owners = held.where("term is null").select("key", "entity").distinct()
    of_entity = owners.groupBy("entity").agg(F.count("*").alias("n_entity"))
    of_term = docs.select("text").mapInArrow(_count_terms, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n_term"))
    content = F.log2(F.lit(n) / F.col("n_entity"))
    # Neither occurs less often than both: what cannot reach the threshold is left out before documents are looked at.
    most = F.log2(F.lit(n) / F.greatest("n_entity", "n_term")) / content
    known = together.join(of_entity, "entity").join(of_term, "term").where((content > 0) & (most >= threshold - 1e-9))
    known = stage(known.select("entity", "term", "n_entity", "n_term"), "known")
    terms = held.where("entity is null").select("key", "term", "places").dropDuplicates(["key", "term"])
    both = stage(terms.join(known, "term").join(owners, ["key", "entity"]), "both")
    counts = both.groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
    shared = F.log2(F.col("n_both") * F.lit(n) / (F.col("n_entity") * F.greatest("n_term", "n_both")))
    told = stage(counts.withColumn("disclosure", shared / content).where(F.col("disclosure") >= threshold).select("entity", "term", "disclosure"), "revealing")
    return both.select("key", "entity", "term", "places").join(told, ["entity", "term"])


def find_personal_data(docs: DataFrame, carry: tuple[str, ...] = (), text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: (doc_id, *carry, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans).

    ``spans`` lists all spans as kind:start:end in code points, end exclusive, by start and then kind;
    ``base_sha256`` is the digest of those found by pattern. ``term`` spans are all places, in documents with the
    identifier, of terms that disclose it. Null counts as the empty text. Rows that agree in doc_id and text share
    their spans. All statistics cover all documents.
    """
    rows = docs.select("doc_id", *carry, row_key("doc_id", text).alias("__key"), F.col(text).cast("binary").alias("text"))
    held = stage(rows.select(F.col("__key").alias("key"), "text").mapInArrow(_find_held, "key bigint, entity string, term string, around bigint, places string"), "held")
    told = revealing_terms(rows, held, threshold)
    terms = told.groupBy(F.col("key").alias("__key")).agg(F.array_join(F.sort_array(F.collect_set("places")), ",").alias("terms"))
    rest = ["doc_id", *carry]
    numbers = [F.lit(0).cast("bigint").alias(f"n_{kind}") for kind in KINDS[:4]]
    schema = rows.select(*rest, "__key", *numbers, F.lit("").alias("base_sha256"), F.lit("").alias("base")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [identifiers(t) for t in _texts(batch)]
            shown = [show(spans) for spans in found]
            counts = [pa.array([sum(s[0] == kind for s in spans) for spans in found], pa.int64()) for kind in KINDS[:4]]
            digests = pa.array([hashlib.sha256(s.encode()).hexdigest() for s in shown], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts, digests, pa.array(shown, pa.string())], names=schema.names)

    based = rows.select(*rest, "__key", "text").mapInArrow(work, schema)
    joined = based.join(stage(terms, "terms"), "__key", "left")
    term_list = F.filter(F.array_distinct(F.split(F.coalesce("terms", F.lit("")), ",")), lambda s: s != "")
    all_spans = F.filter(F.concat(F.split("base", ","), term_list), lambda s: s != "")
    place = lambda s: F.struct(
        F.split_part(s, F.lit(":"), F.lit(2)).cast("bigint").alias("start"),
        F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).alias("kind"),
        F.split_part(s, F.lit(":"), F.lit(3)).cast("bigint").alias("end"), s.alias("span"),
    )
    ordered = F.array_join(F.transform(F.sort_array(F.transform(all_spans, place)), lambda p: p["span"]), ",")
    return joined.select(
        *rest, *(f"n_{kind}" for kind in KINDS[:4]), F.size(term_list).cast("bigint").alias("n_term"), "base_sha256",
        ordered.alias("spans"),
    )


def redact(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Replace spans in the texts: identifiers are generalised to their kind (``<EMAIL>``), terms are removed.

    ``found`` is the result of ``find_personal_data(docs, carry=("key",))`` for docs with a ``key`` column that
    tells rows apart. Overlapping spans are replaced as one, by the first's kind. Null texts stay null.
    """
    schema = docs.schema
    joined = docs.withColumn(text, F.col(text).cast("binary")).join(
        found.select("key", F.col("spans").alias("__spans")).dropDuplicates(["key"]), "key", "left"
    ).select(*docs.columns, "__spans")
    at = docs.columns.index(text)

    def clean(value: bytes | None, spans: str | None) -> str | None:
        if value is None:
            return None
        old, new, done = value.decode("utf-8", "replace"), [], 0
        for span in (spans or "").split(",") if spans else []:
            kind, start, end = span.split(":")
            if int(start) >= done:
                new.append(old[done:int(start)] + ("" if kind == "term" else f"<{kind.upper()}>"))
            done = max(done, int(end))
        return "".join(new) + old[done:]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns[:-1])
            pairs = zip(columns[at].to_pylist(), batch.columns[-1].to_pylist(), strict=True)
            columns[at] = pa.array([clean(t, s) for t, s in pairs], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(work, schema)
