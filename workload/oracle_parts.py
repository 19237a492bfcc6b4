"""The derived tables again, as SQL common table expressions for DuckDB."""

from .tables import KEEP, NOW

KEEP_LIST = ", ".join(f"'{r}'" for r in KEEP)


def unit(key: str, seed: str) -> str:
    """A keyed number in [0, 1) over one text column."""
    return f"(CAST(('0x' || substr(md5('{seed}|' || {key}), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def sigmoid(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({x}))))"


SNAPSHOTS = """
snapshots AS (
  SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber,
             CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT),
             strftime(l_shipdate, '%Y-%m-%d'))) AS snapshot_key,
         'v' || (l_partkey % 200) AS "videoId",
         CASE WHEN l_linenumber <> 5 THEN p_name END AS title,
         l_partkey % (SELECT count(*) FROM documents) AS doc_ref,
         CAST(o_orderdate AS TIMESTAMP) AS "publishedAt",
         CASE WHEN l_linenumber <> 7 THEN CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) END AS "trendingDate",
         CASE WHEN n_name <> 'NATION_7' THEN n_name END AS region,
         CAST(floor(l_extendedprice) AS BIGINT) AS "viewCount",
         CAST(floor(l_extendedprice * l_discount) AS BIGINT) AS "likeCount",
         CAST(l_quantity AS BIGINT) AS "commentCount",
         CASE WHEN l_linenumber <> 6 THEN CAST(l_quantity AS BIGINT) END AS "rank",
         'src_' || l_returnflag AS source,
         'src_' || l_returnflag || '_' || l_linestatus AS data_source
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""

TEXTS = """
texts AS (
  SELECT snapshots.*, documents.text AS description
  FROM snapshots LEFT JOIN documents ON doc_ref = doc_id
)"""

DEDUPED = f"""
deduped AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY "videoId", "trendingDate", region ORDER BY snapshot_key DESC) AS rn
    FROM snapshots WHERE region IS NULL OR region IN ({KEEP_LIST})
  ) WHERE rn = 1
)"""


def score_parts(source: str, rank: str) -> str:
    """Scoring of the rows of ``source``; ``rank`` is the chart position to use."""
    return f"""
aged AS (
  SELECT *, coalesce(CASE WHEN h = 0 THEN 1.0::DOUBLE ELSE h END, 24.0::DOUBLE) AS age FROM (
    SELECT *, {rank} AS place,
           CAST(epoch_us(coalesce("trendingDate", TIMESTAMP '{NOW}')) - epoch_us("publishedAt") AS DOUBLE)
             / 3.6e9::DOUBLE AS h
    FROM {source})
),
rated AS (
  SELECT *, greatest("viewCount" / age, 0.0::DOUBLE) AS "viewsPerHr",
         greatest("likeCount" / age, 0.0::DOUBLE) AS "likesPerHr",
         greatest("commentCount" / age, 0.0::DOUBLE) AS "commentsPerHr"
  FROM aged
),
logged AS (
  SELECT *, ln(1 + "viewsPerHr") AS "viewsPerHr_log", ln(1 + "likesPerHr") AS "likesPerHr_log",
         ln(1 + "commentsPerHr") AS "commentsPerHr_log"
  FROM rated
),
quartiles AS (
  SELECT quantile_cont("viewsPerHr_log", [0.25, 0.5, 0.75]) AS v,
         quantile_cont("likesPerHr_log", [0.25, 0.5, 0.75]) AS l,
         quantile_cont("commentsPerHr_log", [0.25, 0.5, 0.75]) AS c
  FROM logged
),
metrics AS (
  SELECT *, sqrt("viewsPerHr_n" * "likesPerHr_n") AS "earlyViral_n" FROM (
    SELECT logged.*,
      {sigmoid('("viewsPerHr_log" - v[2]) / (CASE WHEN v[3] > v[1] THEN v[3] - v[1] ELSE 1.0 END)')} AS "viewsPerHr_n",
      {sigmoid('("likesPerHr_log" - l[2]) / (CASE WHEN l[3] > l[1] THEN l[3] - l[1] ELSE 1.0 END)')} AS "likesPerHr_n",
      {sigmoid('("commentsPerHr_log" - c[2]) / (CASE WHEN c[3] > c[1] THEN c[3] - c[1] ELSE 1.0 END)')} AS "commentsPerHr_n",
      {sigmoid('6.0::DOUBLE * ((1.0::DOUBLE - coalesce(place, 50) / 50.0::DOUBLE) - 0.5::DOUBLE)')} AS "rankScore_n",
      exp(least(-age / 24.0::DOUBLE, 0.0::DOUBLE)) AS "recency_n",
      {sigmoid('10.0::DOUBLE * ("likeCount" / (CASE WHEN "viewCount" = 0 THEN 1 ELSE "viewCount" END)::DOUBLE - 0.05::DOUBLE)')}
        AS "engagementRatio_n"
    FROM logged, quartiles)
),
raw AS (
  SELECT *, 0.35::DOUBLE * "viewsPerHr_n" + 0.25::DOUBLE * "likesPerHr_n" + 0.15::DOUBLE * "commentsPerHr_n"
          + 0.15::DOUBLE * "rankScore_n" + 0.10::DOUBLE * "recency_n" + 0.10::DOUBLE * "engagementRatio_n"
          + 0.05::DOUBLE * "earlyViral_n" AS raw_score
  FROM metrics
),
ranked AS (
  SELECT *, (rank() OVER (ORDER BY raw_score) + (count(*) OVER (PARTITION BY raw_score) - 1) / 2.0::DOUBLE)
            / count(*) OVER () AS pct
  FROM raw
),
scored AS (
  SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE,
            pow(pct, 1.5::DOUBLE) + {unit('snapshot_key', '42')} * 0.05::DOUBLE * (1 - pow(pct, 1.5::DOUBLE)))) AS viral_score
  FROM ranked
)"""


SCORED = SNAPSHOTS + "," + DEDUPED + "," + score_parts("deduped", 'coalesce("rank", 0)')


def noisy(name: str, width: float) -> str:
    return (
        f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, y + ({unit('id', name)} - 0.5::DOUBLE)"
        f" * {2 * width}::DOUBLE)), 6) AS {name}"
    )


PREDICTIONS = (
    SCORED
    + f""",
labelled AS (
  SELECT snapshot_key AS id, lang, round(viral_score, 6) AS y
  FROM scored LEFT JOIN documents ON doc_ref = doc_id
),
predictions AS (
  SELECT id, lang, CAST(floor({unit('id', 'fold')} * 5) AS INTEGER) AS fold, y,
         {noisy('p1', 0.15)}, {noisy('p2', 0.2)}, {noisy('p3', 0.3)}
  FROM labelled
)"""
)

EXAMPLES = f"""
examples AS (
  SELECT ex_id, prompt, response, round({unit('ex_id', 'score')}, 6) AS score,
         CASE WHEN {unit('ex_id', 'split')} < 0.1 THEN 'test' ELSE 'train' END AS split
  FROM (
    SELECT concat_ws('-', a.conv_id, a.turn) AS ex_id, a.text AS prompt, b.text AS response
    FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn - 1
    WHERE a.role = 'user' AND b.role = 'assistant')
)"""


def average_rank(col: str, by: str = "") -> str:
    """Average-tie rank of ``col``."""
    part = f"PARTITION BY {by} " if by else ""
    same = f"{by}, {col}" if by else col
    return f"(rank() OVER ({part}ORDER BY {col}) + (count(*) OVER (PARTITION BY {same}) - 1) / 2.0::DOUBLE)"


def ordinal_rank(col: str, key: str) -> str:
    """Row number in the order of ``col``, equal values by the hash of the key."""
    return f"row_number() OVER (ORDER BY {col}, md5('42|' || {key}))"
