"""Case, patent and keyword tables mapped onto the supplied star schema.

Each view is one SQL text with ``{table}`` placeholders. Spark fills them with
DataFrames; the oracle fills them with table names, so both sides start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

# Legal sentences built from row values, so that text operators meet the
# wording they look for. ``n`` is an integer column, ``t`` a text column.
_LEGAL_TAIL = """
  CASE WHEN {n} % 3 = 0 THEN ' The court finds that the accused software of party ' || CAST({n} % 7 AS STRING)
    || ' infringes the patent claims in suit. See also 567 U.S. ' || CAST(100 + {n} % 9 AS STRING) || '.' ELSE '' END
  || CASE WHEN {n} % 4 = 1 THEN ' The motion was granted because the computer network claims recite an abstract idea under section 101.' ELSE '' END
  || CASE WHEN {n} % 5 = 2 THEN ' Evidence shows that the asserted patent is invalid, citing stare decisis and binding authority from 1998 and 2015.' ELSE '' END
  || CASE WHEN {n} % 6 = 3 THEN ' Pursuant to the agreement, whereas U.S. Patent No. 7,' || CAST(100 + {n} % 11 AS STRING) || ',456 was licensed, the digital database service is useful.' ELSE '' END
  || CASE WHEN {n} % 8 = 5 THEN ' Therefore, the data privacy policy of the online platform governs the server and the database. Smith v. Jones 123 F.3d 456.' ELSE '' END
"""

CASES = """
  SELECT CAST(d.doc_id AS STRING) AS id, d.doc_id AS row_no,
    'Customer ' || CAST(o.o_custkey AS STRING) || ' v. ' || d.source AS case_name,
    'Customer ' || CAST(o.o_custkey AS STRING) || ' et al. v. ' || d.source AS case_name_full,
    CAST(o.o_orderdate AS DATE) AS date_filed,
    CAST(o.o_orderdate AS DATE) + CAST(o.o_custkey % 400 AS INT) AS date_terminated,
    CASE o.o_custkey % 10 WHEN 0 THEN 'Supreme Court' WHEN 1 THEN 'Federal Circuit' WHEN 2 THEN 'Federal Circuit'
      WHEN 3 THEN 'Federal Circuit' WHEN 4 THEN 'Eastern Texas' WHEN 5 THEN 'Eastern Texas'
      WHEN 6 THEN 'Eastern Texas' ELSE 'Northern California' END AS court,
    CASE o.o_custkey % 10 WHEN 0 THEN 'scotus' WHEN 1 THEN 'cafc' WHEN 2 THEN 'cafc' WHEN 3 THEN 'cafc'
      WHEN 4 THEN 'txed' WHEN 5 THEN 'txed' WHEN 6 THEN 'txed' ELSE 'cand' END AS court_id,
    'D-' || CAST(o.o_custkey AS STRING) AS docket_number,
    CAST(o.o_custkey AS STRING) AS docket_id,
    o.o_orderpriority AS judge,
    CASE o.o_orderstatus WHEN 'F' THEN 'Published' WHEN 'P' THEN 'Non-Precedential' END AS precedential_status,
    CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE d.lang END AS suit_nature,
    CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE 'Appeal from order ' || CAST(o.o_orderkey AS STRING) END AS procedural_history,
    CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE 'Filed in ' || d.lang END AS syllabus,
    coalesce(l.n_lines, 0) AS citation_count,
    CASE WHEN d.doc_id % 11 = 7 THEN NULL ELSE d.text END AS text_excerpt,
    d.text ||""" + _LEGAL_TAIL.replace("{n}", "d.doc_id") + """ AS full_text,
    l.score AS tech_relevance_score,
    CASE WHEN d.doc_id % 13 = 5 THEN NULL ELSE '[''primary:' || d.lang || ''', ''Secondary: ' || d.source || ' '']' END AS tech_keywords_found,
    d.source AS source
  FROM {documents} d
  JOIN {orders} o ON d.doc_id = o.o_orderkey
  LEFT JOIN (
    SELECT l_orderkey, count(*) AS n_lines,
      CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 10 AS DOUBLE) AS score
    FROM {lineitem} GROUP BY l_orderkey) l ON d.doc_id = l.l_orderkey
"""

OFFICE_ACTIONS = """
  SELECT 'US' || CAST(l_orderkey AS STRING) AS publicationNumber,
    'APP' || CAST(l_orderkey AS STRING) AS patentApplicationNumber,
    CASE WHEN l_quantity < 2 THEN NULL ELSE 'US' || CAST(l_partkey AS STRING) END AS citedDocumentIdentifier,
    'US' AS countryCode, 'B' || CAST(l_linenumber % 3 AS STRING) AS kindCode,
    CASE l_suppkey % 4 WHEN 0 THEN 2100 WHEN 1 THEN 2400 WHEN 2 THEN 2600 ELSE 2800 END AS techCenter,
    CAST(2100 + l_suppkey % 100 AS INT) AS groupArtUnitNumber,
    l_shipdate AS officeActionDate,
    CAST(l_linenumber AS STRING) || '-' || CAST(l_linenumber + 2 AS STRING) || ', ' || CAST(l_linenumber + 4 AS STRING) AS relatedClaimNumberText,
    CASE WHEN l_returnflag = 'R' THEN NULL
      WHEN l_linestatus = 'F' THEN '[''c. 103|claim 1|paragraph ' || CAST(l_linenumber AS STRING) || '|fig. 2'']'
      WHEN l_tax > 0.05 THEN '[''c. 102|claim 3|Claim 4|sections 112 and section102'']'
      ELSE '[''c. 102|par. 7|figure 1'']' END AS passageLocationText,
    CASE l_linenumber % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'Y' ELSE 'A' END AS citationCategoryCode,
    CASE WHEN l_suppkey % 9 = 0 THEN NULL ELSE 'Inventor ' || CAST(l_suppkey AS STRING) END AS inventorNameText,
    CASE WHEN l_tax > 0.04 THEN 'TRUE' ELSE 'FALSE' END AS examinerCitedReferenceIndicator,
    CASE WHEN l_discount > 0.05 THEN 'true' ELSE 'FALSE' END AS applicantCitedExaminerReferenceIndicator,
    CASE WHEN l_quantity > 45 THEN 'TRUE' WHEN l_quantity < 5 THEN NULL ELSE 'no' END AS nplIndicator
  FROM {lineitem}
"""

KEYWORD_ROWS = """
  SELECT l.l_orderkey AS id, CAST(o.o_orderdate AS DATE) AS date_filed,
    '[''primary:' || p.p_name || ''', ''Secondary: ' || p.p_type || ' '', '' '']' AS raw
  FROM {lineitem} l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
"""

CASE_QUERIES = """
  SELECT item_id AS query_id, text ||""" + _LEGAL_TAIL.replace("{n}", "item_id") + """ AS text
  FROM {benchmark}
"""

# Short questions about patents, one per conversation turn.
PATENT_QUESTIONS = """
  SELECT conv_id, turn,
    CASE conv_id % 4 WHEN 0 THEN 'Is my software invention in the field of computer vision patentable? '
      WHEN 1 THEN 'Please check whether the mechanical device is obvious or identical to US7123456, the prior art. '
      WHEN 2 THEN 'Does this method in the chemical industry challenge a valid claim in 9876543 with clarity? '
      ELSE '' END || text AS question
  FROM {conversations}
"""

KEYWORD_SERIES = """
  SELECT p.p_name AS keyword, CAST(year(o.o_orderdate) AS INT) AS year, count(*) AS count
  FROM {lineitem} l
  JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
  GROUP BY p.p_name, year(o.o_orderdate)
"""

# The keyword's busy years: counts at or above its mean, which leaves gaps.
GAPPY_SERIES = (
    "SELECT keyword, year, count FROM (SELECT s.*, avg(count) OVER (PARTITION BY keyword) AS mean FROM ("
    + KEYWORD_SERIES + ") s) m WHERE count >= mean"
)

VIEWS = {
    "cases": CASES,
    "office_actions": OFFICE_ACTIONS,
    "keyword_rows": KEYWORD_ROWS,
    "case_queries": CASE_QUERIES,
    "patent_questions": PATENT_QUESTIONS,
    "keyword_series": KEYWORD_SERIES,
    "gappy_series": GAPPY_SERIES,
}


# Unique columns of the tables whose rows are costly to process.
_SPREAD_BY = {
    "documents": ("doc_id",), "pages": ("page_id",),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
}


def spread(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Use all cores when a scan yields fewer tasks than the cluster has.

    One small file is one task. A large table has many files and row groups and
    is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, _SPREAD_BY[name]) if name in _SPREAD_BY else df


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def view_sql(name: str) -> str:
    """The same view for an engine where the tables are registered by name."""
    return VIEWS[name].format(**{t: t for t in TABLES})
