"""The registered queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from trendspark.llm import (
    byte_bpe, chat_format, collocations, language_id, line_dedup, manifest, mixing, passage_dedup, quality_rules, sanitise, simhash, toxicity, vector_neardup,
)
from trendspark.llm.common import read, row_key

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    return language_id.identify(read(spark, sf, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op2_shared_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy passages that documents share."""
    return passage_dedup.shared_passages(read(spark, sf, "documents"))


def op3_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdicts of the rule cascade."""
    judged = quality_rules.judge(read(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Formatted conversations, with digests of what is read back from them."""
    probe = spark.sql(
        "SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    chats = chat_format.with_segments(chat_format.with_turns(chat_format.gather_turns(rows)))
    seen = chats.select(
        "conv_id", chat_format.read_turns(F.col("formatted")).alias("read"), chat_format.read_loss(F.col("segments")).alias("loss"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    spoken = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of every document without its repeated lines."""
    cut = line_dedup.without_repeated_lines(read(spark, sf, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("chars_left"), F.sha2("text", 256).alias("text_sha256")
    )


def op6_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of personal data in every document."""
    return sanitise.find_personal_data(read(spark, sf, "documents"))


def op7_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    """How many words of every document the mix takes, and to which shards its copies go."""
    docs = read(spark, sf, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), row_key().alias("key"))
    planned, drawn = mixing.mix(sized)
    place = ["at", "bucket", "nth"]
    taken = drawn.groupBy(*place).agg(F.sum("size").alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards"))
    return planned.join(taken, place, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("bigint")).alias("taken"),
        F.coalesce("shards", F.array().cast("array<int>")).alias("shards"),
    )


def op8_simhash_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and group of near duplicates of every document."""
    return simhash.near_duplicate_groups(read(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the token ids of every document and of what they decode to."""
    import public_tokenizers

    ranks = byte_bpe.share_ranks(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return byte_bpe.with_tokens(docs, ranks, public_tokenizers.PATTERN, ids=False)


def op10_vector_neardup(spark: SparkSession, sf: str) -> DataFrame:
    """Links and groups of near-duplicate vectors."""
    return vector_neardup.near_duplicate_vectors(read(spark, sf, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, roots and proof of every document; part of them checked with the line breaks taken out of their text."""
    docs = read(spark, sf, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    proven = manifest.manifest(docs, manifest.leaf_digest([*fields, F.col("text")]), manifest.leaf_digest([*fields, seen]))
    folded = proven.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest("path").alias("proof_sha256"), manifest.fold("path", "claimed").alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """How likely every document is toxic, learned from the labels that are not held out."""
    return toxicity.judge(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op13_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The strongest phrases of each language."""
    return collocations.collocations(read(spark, sf, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_language_id, op2_shared_passages, op3_quality_rules, op4_chat_format, op5_line_dedup,
        op6_personal_data, op7_source_mix, op8_simhash_neardup, op9_byte_bpe, op10_vector_neardup,
        op11_merkle_manifest, op12_toxicity, op13_collocations,
    )
}

# The words of the texts, their places and their 3-word windows. RE2 has no \v, so the class is spelled out.
_QUALITY = r"""
WITH base AS (
    SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
),
spread AS (SELECT rid, unnest(range(1, len(words) - 1)) AS i, words FROM base),
windows AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram FROM spread),
repeated AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
covered AS (
    SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY rid
),
lines AS (
    SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
),
counts AS (
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
        CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(coalesce(l.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(l.n_lines, 0) AS BIGINT) AS n_lines,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(text, '\P{L}+', '', 'g')) AS letters,
        length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS capitals,
        len(regexp_extract_all(text, '[!?]{2}')) AS shouts
    FROM base LEFT JOIN lines l USING (rid) LEFT JOIN covered c USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
        OR 10 * n_symbols > n_words OR (n_dup_lines > 2 AND 10 * n_dup_lines > 3 * n_lines) OR 10 * letters < 6 * word_chars
        OR 10 * capitals > 6 * word_chars OR 5 * shouts > n_words) AS kept
FROM counts
"""

# Each turn is marked by <s>[INST], [/INST] and </s>; each control string in a text grows by one backslash.
_CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
named AS (
    SELECT conv_id, turn, text, CASE WHEN role IN ('human', 'prompter') THEN 'user'
        WHEN role IN ('gpt', 'model', 'bot') THEN 'assistant' ELSE role END AS role FROM turns
),
joined AS (
    SELECT conv_id, count(*) AS n_turns,
        string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS spoken,
        coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
        sum(20 + length(role) + length(text)
            + len(regexp_extract_all(role || ' ' || text, '<\\*/?s>|\[\\*/?INST\]'))) AS formatted_chars
    FROM named GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(spoken) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
    sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""

_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (
    SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) = len(list_filter(e, lambda x: isfinite(x)))
        AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM fit a JOIN fit b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.98
),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, CAST((SELECT count(*) FROM links WHERE a = vec_id) AS BIGINT) AS n_links,
    least(vec_id, coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id)) AS component_id,
    vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = vec_id), vec_id) AS kept
FROM v
"""

# CRC-32 bit by bit; the tree level by level; the claimed leaves folded step by step.
_MANIFEST = r"""
WITH RECURSIVE marked AS (
    SELECT *, coalesce((list_reduce(
        list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
        lambda s, b: list_reduce(
            list_prepend(xor(s, b), CAST(range(8) AS UBIGINT[])),
            lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS UBIGINT)) ELSE x // 2 END
        )
    ) % 2) = 1, false) AS tampered FROM documents
),
parts AS (
    SELECT doc_id, source, text, tampered,
        coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
        replace(text, chr(10), '') AS bare
    FROM marked
),
leaves AS (
    SELECT row_number() OVER () AS rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || CASE WHEN tampered THEN coalesce(strlen(bare) || ':' || bare, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS claimed
    FROM parts
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM leaves
),
tree(source, level, pos, digest, n) AS (
    SELECT source, 0, pos, leaf, n FROM placed
    UNION ALL
    SELECT source, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM tree WHERE n > 1
    GROUP BY source, level, pos // 3, n
),
subroots AS (
    SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1
),
top(level, pos, digest, n) AS (
    SELECT 0, pos, subroot, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, pos // 3, n
),
steps AS (
    SELECT p.rid, t.level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos < p.pos // CAST(3 ** t.level AS BIGINT)), '') AS lefts,
        coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos > p.pos // CAST(3 ** t.level AS BIGINT)), '') AS rights
    FROM placed p JOIN tree t ON t.source IS NOT DISTINCT FROM p.source AND t.n > 1 AND t.pos // 3 = p.pos // CAST(3 ** (t.level + 1) AS BIGINT)
    GROUP BY p.rid, t.level
    UNION ALL
    SELECT p.rid, 100 + t.level, coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos < s.pos // CAST(3 ** t.level AS BIGINT)), ''),
        coalesce(string_agg(t.digest, '' ORDER BY t.pos) FILTER (WHERE t.pos > s.pos // CAST(3 ** t.level AS BIGINT)), '')
    FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source
    JOIN top t ON t.n > 1 AND t.pos // 3 = s.pos // CAST(3 ** (t.level + 1) AS BIGINT)
    GROUP BY p.rid, t.level
),
numbered AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level) AS no FROM steps),
folded(rid, no, digest) AS (
    SELECT rid, 0, claimed FROM placed
    UNION ALL
    SELECT f.rid, f.no + 1, sha256(s.lefts || f.digest || s.rights) FROM folded f JOIN numbered s ON s.rid = f.rid AND s.no = f.no + 1
),
proofs AS (SELECT rid, string_agg(lefts || rights, '' ORDER BY no) AS proof FROM numbered GROUP BY rid)
SELECT p.doc_id, p.leaf, s.subroot, r.digest AS root, sha256(coalesce(q.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source JOIN (SELECT digest FROM top WHERE n = 1) r ON true
LEFT JOIN proofs q ON q.rid = p.rid
JOIN folded f ON f.rid = p.rid AND f.no = (SELECT count(*) FROM numbered b WHERE b.rid = p.rid)
"""

# Grams of one to three words counted outright, without a graph.
_PHRASES = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS rid,
        string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS parts
    FROM documents
),
worded AS (SELECT lang, regexp_extract_all(unnest(parts), '[^\x20\x09]+') AS words FROM pieces),
placed AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
grams AS (
    SELECT lang, unnest([1, 2, 3]) AS k, i, words FROM placed
),
counts AS (
    SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS gram, count(*) AS f FROM grams WHERE i + k - 1 <= len(words)
    GROUP BY ALL
),
cand AS (
    SELECT lang, k, gram, f AS a, string_split(gram, ' ') AS w FROM counts WHERE k > 1 AND f >= 10
),
cuts AS (
    SELECT c.*, j, array_to_string(w[1:j], ' ') AS front, array_to_string(w[j + 1:], ' ') AS back
    FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
),
weighed AS (
    SELECT c.lang, c.gram, c.a, c.j, x.f AS l, y.f AS r,
        CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM cuts c JOIN counts x ON x.lang = c.lang AND x.gram = c.front JOIN counts y ON y.lang = c.lang AND y.gram = c.back
),
weakest AS (SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, j) = 1),
covered AS (
    SELECT DISTINCT s.lang, s.gram FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS gram FROM cand WHERE k = 3
    ) s JOIN cand c ON c.lang = s.lang AND c.gram = s.gram WHERE 100 * s.a >= 50 * c.a
),
ranked AS (
    SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.gram) AS rank, w.gram AS phrase, a, l, r, score
    FROM weakest w LEFT JOIN covered v ON v.lang = w.lang AND v.gram = w.gram WHERE v.gram IS NULL
),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op3_quality_rules": _QUALITY, "op4_chat_format": _CHAT, "op10_vector_neardup": _VECTORS,
    "op11_merkle_manifest": _MANIFEST, "op13_collocations": _PHRASES,
}
