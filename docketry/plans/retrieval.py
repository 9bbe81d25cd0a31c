"""Join, graph, search and strategy queries."""

import numpy as np
from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import cleaning as C
from docketry.operators import graph as G
from docketry.operators import office_actions as O
from docketry.operators import pruned as PR
from docketry.operators import quantised as QN
from docketry.operators import retrieval as R
from docketry.operators import strategy as S
from docketry.operators.joins import enriched_cases, party_details
from docketry.plans.aggregates import r6
from docketry.operators.statistics import vector_statistics
from docketry.plans.registry import query
from docketry.session import cut_lineage

# --- joins ------------------------------------------------------------------


@query(
    "jn1_enriched_cases",
    views=("cases",),
    sql="""SELECT id, c_mktsegment AS case_type, coalesce(c_name, judge) AS assigned_judge, split_part(case_name, ' v. ', 1) AS plaintiff,
      (SELECT count(*) FROM orders o WHERE o.o_custkey = c.c_custkey) AS parties,
      coalesce(CASE WHEN row_no % 2 = 0 THEN 'Cluster ' || source END, precedential_status) AS precedential_status,
      CASE WHEN c_custkey IS NULL THEN NULL WHEN c_custkey % 3 = 0 THEN '2001-02-03 filed Case filed'
        ELSE '2001-02-03 filed Case filed;' || (2001 + c_custkey % 9) || '-05-06 terminated Case terminated' END AS events
      FROM cases LEFT JOIN customer c ON CAST(docket_id AS BIGINT) = c.c_custkey""",
)
def jn1(t):
    cases = t.cases.withColumn("cluster_id", F.col("id"))
    dockets = t.customer.select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("assignedTo"),
        F.col("c_mktsegment").alias("nature_of_suit"), F.lit(None).cast("string").alias("jurisdiction_type"),
        F.lit(None).cast("string").alias("appellate_fee_status"), F.lit("2001-02-03").alias("date_filed"),
        F.when(F.col("c_custkey") % 3 != 0, F.concat((2001 + F.col("c_custkey") % 9).cast("string"), F.lit("-05-06"))).alias("date_terminated"),
    )
    parties = t.orders.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("docket_id"),
        F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("type"), F.lit("party").alias("role"),
    )
    clusters = t.documents.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Cluster "), "source")).alias("precedential_status"),
        F.array("source").alias("citing"), F.array("lang").alias("cited_by"),
    )
    out = enriched_cases(cases, dockets, parties, clusters)
    return out.select(
        "id", "case_type", "assigned_judge", "parties_in_name.plaintiff", F.col("party_count").alias("parties"),
        "precedential_status",
        F.array_join(F.transform("procedural_events", lambda e: F.concat_ws(" ", e["date"], e["event_type"], e["description"])), ";").alias("events"),
    )


@query(
    "jn1_party_details",
    views=("cases",),
    sql="""SELECT c.id, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'party' ELSE 'Not Available' END AS role, o_orderstatus AS type,
      CASE WHEN o_orderkey % 3 = 0 THEN 'Lawyer ' || o_custkey || ',second' ELSE '' END AS attorneys
      FROM cases c JOIN orders o ON o.o_custkey = CAST(c.docket_id AS BIGINT)""",
)
def jn1_parties(t):
    lawyers = F.array(*[F.struct(x.alias("name")) for x in (F.concat(F.lit("Lawyer "), "o_custkey"), F.lit("second"))])
    parties = t.orders.select(
        F.col("o_custkey").cast("string").alias("docket_id"), F.col("o_orderpriority").alias("name"),
        F.when(F.col("o_orderkey") % 2 == 0, "party").alias("role"), F.col("o_orderstatus").alias("type"),
        F.when(F.col("o_orderkey") % 3 == 0, lawyers).alias("attorneys"),
    )
    return party_details(t.cases, parties).withColumn("attorneys", F.array_join("attorneys", ","))


PATENT_EDGES = """, e AS (SELECT DISTINCT publicationNumber AS src, citedDocumentIdentifier AS dst FROM office_actions
    WHERE citedDocumentIdentifier IS NOT NULL),
  nodes AS (SELECT DISTINCT unnest([src, dst]) AS id FROM e),
  deg AS (SELECT n.id, (SELECT count(*) FROM e WHERE e.dst = n.id) AS in_degree, (SELECT count(*) FROM e WHERE e.src = n.id) AS out_degree FROM nodes n)"""


@query(
    "jn2_node_metrics_lookup",
    views=("office_actions",),
    sql=PATENT_EDGES + """ SELECT s_name, coalesce(in_degree, 0)::BIGINT AS in_degree, coalesce(out_degree, 0)::BIGINT AS out_degree
      FROM supplier LEFT JOIN deg ON deg.id = 'US' || s_suppkey * 7""",
)
def jn2(t):
    keyed = t.supplier.select("s_name", F.concat(F.lit("US"), F.col("s_suppkey") * 7).alias("pub"))
    out = G.with_node_metrics(keyed, "pub", G.degrees(O.citation_edges(t.office_actions)))
    return out.select("s_name", F.col("citation_network_in_degree").alias("in_degree"),
                      F.col("citation_network_out_degree").alias("out_degree"))


@query(
    "jn3_lookup",
    views=("cases",),
    sql="""SELECT id, CASE WHEN n_nationkey IS NULL THEN 1 ELSE n_regionkey END::BIGINT AS court_level FROM cases
      LEFT JOIN nation ON 'D-' || n_nationkey = docket_number""",
)
def jn3(t):
    levels = t.nation.select(F.concat(F.lit("D-"), "n_nationkey").alias("court_id"), F.col("n_regionkey").alias("level"))
    return C.court_levels(t.cases.select("id", "docket_number"), levels, "docket_number").select("id", "court_level")


CASE_EDGES = """, o AS (SELECT id, date_filed, row_number() OVER (ORDER BY date_filed, id) AS pos FROM cases),
  ce AS (SELECT c.id AS src, o.id AS dst FROM cases c JOIN o ON o.pos <= c.citation_count AND o.date_filed < c.date_filed)"""


@query("jn4_earlier_case_edges", views=("cases",), sql=CASE_EDGES + " SELECT src, dst FROM ce")
def jn4(t):
    return G.earlier_case_edges(t.cases)


def case_profiles(t):
    text = C.joined_text("full_text", "syllabus", "text_excerpt", "procedural_history")
    return S.profiled(t.cases, "row_no", text, "date_filed")


def query_profiles(t):
    return S.profiled(t.case_queries, "query_id", "text")


def strategy_inputs(t):
    profiles = cut_lineage(case_profiles(t))
    return query_profiles(t), profiles, S.fit_case_terms(profiles)


@query("jn5_similar_pairs")
def jn5(t):
    return S.similar_pairs(*strategy_inputs(t))


VECTORS = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
  d AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance
    FROM v q, v),
  nn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM d)"""


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("jn6_nearest", sql=VECTORS + " SELECT query_id, id, round(distance, 6) AS distance FROM nn WHERE rn <= 10")
def jn6(t):
    return PR.pruned_nearest(vectors(t), vectors(t), 10).select("query_id", "id", *r6("distance"))


@query(
    "jn8_set_overlap",
    views=("cases",),
    sql=r""", w AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(full_text), '[\s\p{Z}]+'), lambda w: w <> '')) AS a,
        list_distinct(list_filter(regexp_split_to_array(lower(judge || ' ' || court || ' ' || case_name), '[\s\p{Z}]+'), lambda w: w <> '')) AS b FROM cases)
      SELECT id, len(list_intersect(a, b)) AS shared, round(len(list_intersect(a, b))::DOUBLE / len(b), 6) AS share FROM w""",
)
def jn8(t):
    rows = t.cases.select(
        "id", X.word_set(F.col("full_text")).alias("a"), X.word_set(F.concat_ws(" ", "judge", "court", "case_name")).alias("b"))
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    return rows.select("id", shared.alias("shared"), F.round(shared / F.size("b"), 6).alias("share"))


# --- graphs -----------------------------------------------------------------


@query("grf1_citation_edges", views=("office_actions",), sql=PATENT_EDGES + " SELECT src, dst FROM e")
def grf1(t):
    return O.citation_edges(t.office_actions)


@query("agg22_degrees", views=("office_actions",),
       sql=PATENT_EDGES + """ SELECT id, in_degree, out_degree, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM e) AS edges FROM deg""")
def agg22(t):
    degrees = cut_lineage(G.degrees(O.citation_edges(t.office_actions)))  # read three times
    return degrees.select(
        "id", "in_degree", "out_degree", degrees.agg(F.count("*")).scalar().alias("nodes"),
        degrees.agg(F.sum("out_degree")).scalar().alias("edges"))


# Steps after which the textbook iteration below stands still at the rounding used.
STEPS = 60


def sql_pagerank(edges: str, nodes: str, steps: int = STEPS, alpha: float = 0.85) -> str:
    """Textbook power iteration: even start, even restart, dangling mass spread evenly in every step."""
    text = f""", od AS MATERIALIZED (SELECT src, count(*) AS degree FROM {edges} GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM {nodes}),
      p0 AS MATERIALIZED (SELECT id, degree, 1.0::DOUBLE / (SELECT n FROM n) AS x FROM {nodes} LEFT JOIN od ON od.src = id)"""
    for i in range(1, steps + 1):
        text += f""", d{i} AS MATERIALIZED (SELECT (1.0::DOUBLE - {alpha}::DOUBLE + {alpha}::DOUBLE * coalesce(sum(x) FILTER (degree IS NULL), 0)) / (SELECT n FROM n) AS even FROM p{i - 1}),
          g{i} AS (SELECT e.dst AS id, sum(p.x / p.degree) AS gain FROM {edges} e JOIN p{i - 1} p ON p.id = e.src GROUP BY 1),
          p{i} AS MATERIALIZED (SELECT p.id, p.degree, (SELECT even FROM d{i}) + {alpha}::DOUBLE * coalesce(g.gain, 0) AS x FROM p{i - 1} p LEFT JOIN g{i} g ON g.id = p.id)"""
    return text + f", pr AS (SELECT id, x AS score FROM p{steps})"


@query("grf2_pagerank", views=("office_actions",),
       sql=PATENT_EDGES + sql_pagerank("e", "nodes") + " SELECT id, round(score * 10000, 4) AS score FROM pr")
def grf2(t):
    ranks = G.pagerank(O.citation_edges(t.office_actions), tolerance=1e-9)
    return ranks.select("id", F.round(F.col("score") * 10000, 4).alias("score"))


@query("grf3_betweenness")
def grf3(t):
    return G.betweenness(O.citation_edges(t.office_actions))


@query("grf4_node_metrics")
def grf4(t):
    return G.node_metrics(O.citation_edges(t.office_actions))


# --- search -----------------------------------------------------------------

SEARCH = (
    CASE_EDGES
    + sql_pagerank("ce", "cases")
    + r""", q AS (SELECT query_id, text, embedding::DOUBLE[] AS x FROM case_queries JOIN embeddings ON vec_id = query_id),
  v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings),
  d AS (SELECT q.query_id, v.id, list_sum(list_transform(list_zip(q.x, v.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS distance FROM q, v),
  pool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM d),
  u AS (SELECT p.query_id, p.distance, c.*, lower(trim(regexp_replace(case_name, '\s+', ' ', 'g'))) AS nm FROM pool p JOIN cases c ON c.row_no = p.id
    WHERE rn <= 100 AND text_excerpt IS NOT NULL AND tech_keywords_found IS NOT NULL AND tech_relevance_score IS NOT NULL AND date_filed IS NOT NULL),
  f AS (SELECT *, row_number() OVER (PARTITION BY query_id, nm ORDER BY distance, row_no) AS r1 FROM u),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, row_no) AS r2 FROM f WHERE r1 = 1) WHERE r2 <= 5),
  w AS (SELECT h.*, q.text AS qt, list_distinct(list_filter(regexp_split_to_array(lower(q.text), '[\s\p{Z}]+'), lambda w: w <> '')) AS a,
    list_distinct(list_filter(regexp_split_to_array(lower(case_name || ' ' || text_excerpt || ' ' || tech_keywords_found), '[\s\p{Z}]+'), lambda w: w <> '')) AS b
    FROM h JOIN q USING (query_id)),
""" + ",\n".join(
        f"  {name}{i} AS (SELECT query_id, row_no, list_distinct(regexp_extract_all({source}, '{pattern}', 1)) AS s FROM w)"
        for i, pattern in enumerate(X.ENTITY_PATTERNS.values())
        for name, source in (("qe", "qt"), ("ce_", "text_excerpt"))
    ) + """,
  ent AS (SELECT qe0.query_id, qe0.row_no, (""" + " + ".join(f"len(list_intersect(qe{i}.s, ce_{i}.s))" for i in range(4))
    + ")::DOUBLE / greatest(1, " + " + ".join(f"len(qe{i}.s)" for i in range(4)) + ") AS entity FROM qe0 "
    + " ".join(f"JOIN {n} USING (query_id, row_no)" for n in ("qe1", "qe2", "qe3", "ce_0", "ce_1", "ce_2", "ce_3")) + """),
  sc AS (SELECT w.query_id, w.row_no AS id, w.case_name, 1 - distance AS semantic, len(list_intersect(a, b))::DOUBLE / len(a) AS keyword,
    tech_relevance_score AS tech, tech_keywords_found AS tech_keywords, array_to_string(list_sort(list_intersect(a, b)), ' ') AS matching, score AS citation, entity, date_diff('day', DATE '2000-01-01', date_filed)::DOUBLE / 9132 AS "time"
    FROM w JOIN ent ON ent.query_id = w.query_id AND ent.row_no = w.row_no LEFT JOIN pr ON pr.id = w.id),
  tot AS (SELECT *, 0.3::DOUBLE * semantic + 0.2::DOUBLE * keyword + 0.2::DOUBLE * tech + 0.15::DOUBLE * citation + 0.1::DOUBLE * entity + 0.05::DOUBLE * "time" AS score FROM sc)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, case_name, round(score, 6) AS score,
    round(semantic, 6) AS semantic, round(keyword, 6) AS keyword, round(entity, 6) AS entity, tech_keywords, matching FROM tot"""
)


@query("rnk1_hybrid_search", views=("cases", "case_queries"), sql=SEARCH)
def rnk1(t):
    asked = t.case_queries.join(t.embeddings, F.col("query_id") == F.col("vec_id")).select(
        F.col("query_id").alias("id"), "text", F.col("embedding").alias("vector"))
    cases = t.cases.withColumns({"id": F.col("row_no")})
    ranks = G.pagerank(G.earlier_case_edges(t.cases), t.cases.select("id"), tolerance=1e-9).select(
        F.col("id").cast("long").alias("id"), "score")
    found = R.hybrid_search(asked, cases, vectors(t), ranks, 5, search=PR.pruned_nearest)
    return found.select("query_id", "rank", "id", "case_name", *r6("score", "semantic", "keyword", "entity"), "tech_keywords",
                        F.array_join("matching_keywords", " ").alias("matching"))


@query(
    "rnk2_neighbour_diagnostic",
    views=("cases",),
    sql=", " + VECTORS[5:] + """ SELECT query_id, nn.id, round(distance, 6) AS distance, case_name, tech_keywords_found,
      round(list_avg(x), 6) AS query_mean FROM nn JOIN cases ON row_no = nn.id JOIN v ON v.vec_id = query_id WHERE rn <= 20""",
)
def rnk2(t):
    found = PR.pruned_nearest(vectors(t), vectors(t), 20)
    stats = vector_statistics(t.embeddings, "embedding").select(F.col("vec_id").alias("query_id"), F.col("mean").alias("query_mean"))
    names = t.cases.select(F.col("row_no").alias("id"), "case_name", "tech_keywords_found")
    return found.join(names, "id").join(stats, "query_id").select(
        "query_id", "id", *r6("distance"), "case_name", "tech_keywords_found", *r6("query_mean"))


def against_exact(found, v, k):
    """Found neighbours, whether each is one of the exact ones, and the share of the exact ones that were found."""
    exact = cut_lineage(PR.pruned_nearest(v, v, k).select("query_id", "id"))
    rows = cut_lineage(found.join(exact.withColumn("exact", F.lit(True)), ["query_id", "id"], "left"))
    share = rows.agg(F.count("exact")).scalar() / exact.agg(F.count("*")).scalar()
    return rows.select("query_id", "id", *r6("distance"), F.coalesce("exact", F.lit(False)).alias("is_exact_neighbour"), F.round(share, 4).alias("recall"))


@query("rnk3_approximate_nearest")
def rnk3(t):
    v = cut_lineage(vectors(t))
    cells = max(1, int(np.sqrt(v.count())))
    return against_exact(R.approximate_nearest(v, v, 10, cells, max(1, 2 * cells // 3)), v, 10)


@query("rnk3_quantised_nearest")
def rnk3_quantised(t):
    v = cut_lineage(vectors(t))
    cells = max(1, int(np.sqrt(v.count())))
    return against_exact(QN.quantised_nearest(v, v, 10, nlist=cells, nprobe=max(1, 2 * cells // 3)), v, 10)


@query("rnk4_text_vectors")
def rnk4(t):
    rows = R.hashed_embeddings(t.documents.select("doc_id", "text"), "text")
    return rows.select("doc_id", F.transform("vector", lambda x: F.round(x.cast("double"), 5)).alias("vector"))


def length_encoder(texts):
    """A stand-in for a language model: shares of a text's characters by code point."""
    out = np.zeros((len(texts), 32))
    for row, text in zip(out, texts):
        row += np.bincount(np.frombuffer(text.encode("utf-32-le"), np.uint32) % 32, minlength=32)
    return out


@query(
    "rnk4_encoder_vectors",
    sql="""WITH c AS (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda x: unicode(x) % 32)) AS slot FROM documents),
      n AS (SELECT doc_id, slot, count(*)::DOUBLE AS n FROM c GROUP BY ALL), l AS (SELECT doc_id, sqrt(sum(n * n)) AS length FROM n GROUP BY 1)
      SELECT doc_id, slot::INT AS slot, round(n / length, 3) AS value FROM n JOIN l USING (doc_id)""",
)
def rnk4_encoder(t):
    rows = R.encoded(t.documents.select("doc_id", "text"), "text", length_encoder)
    return rows.select("doc_id", F.posexplode("vector").alias("slot", "v")).where("v <> 0").select(
        "doc_id", "slot", F.round(F.col("v").cast("double"), 3).alias("value"))


@query("rnk5_keyword_index")
def rnk5(t):
    return R.keyword_index(t.documents.select("doc_id", "text"), "doc_id", "text")


# --- strategy ---------------------------------------------------------------


@query("rnk6_recommend_strategy")
def rnk6(t):
    out = S.recommend(*strategy_inputs(t))
    return out["cases"].join(out["details"].select("id", "winning_arguments"), "id").select(
        "query_id", "place", "id", "time_period", *r6("similarity", "text_similarity", "issue_overlap", "temporal_score", "citation_overlap"),
        F.size("winning_arguments").alias("arguments"))


@query("rnk7_distinct_cases")
def rnk7(t):
    return S.recommend(*strategy_inputs(t))["cases"].select("query_id", "place", "id", "time_period", *r6("similarity"))


@query("agg16_period_distribution")
def agg16(t):
    queries, profiles, model = strategy_inputs(t)
    return S.period_counts(S.similar_pairs(queries, profiles, model), profiles)


@query("agg17_strategy_frequencies")
def agg17(t):
    found = S.recommend(*strategy_inputs(t))["frequencies"]
    return found.select("query_id", "kind", "rank", "text", "frequency", F.size("cases").alias("cases"))


@query("txt36_result_signatures")
def txt36(t):
    out = S.recommend(*strategy_inputs(t))
    return S.result_signatures(out["cases"], out["details"]).select(
        "query_id", "id", "time_period", "rounded", F.array_join("heads", "|").alias("heads"))
