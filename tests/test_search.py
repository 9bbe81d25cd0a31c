from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.operators import centrality as Z
from docketry.operators import scaling
from docketry.operators import graph as G
from docketry.operators import learn as L
from docketry.operators import pruned as PR
from docketry.operators import quantised as QN
from docketry.operators import retrieval as R
from docketry.operators import strategy as S
from docketry.plans import retrieval as retrieval_plans

EDGES = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "b"), ("a", "b"), ("x", "y"), ("y", "x"), ("x", "a"), ("b", "d")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string")


def dense_rank(pairs, alpha=0.85):
    nodes = sorted({n for e in pairs for n in e})
    links = set(pairs)
    rank = {n: 1 / len(nodes) for n in nodes}
    out = {n: [d for s, d in links if s == n] for n in nodes}
    for _ in range(500):
        loose = sum(rank[n] for n in nodes if not out[n])
        new = {n: (1 - alpha) / len(nodes) + alpha * loose / len(nodes) for n in nodes}
        for n in nodes:
            for d in out[n]:
                new[d] += alpha * rank[n] / len(out[n])
        rank = new
    return rank


def test_pagerank(edges):
    got = {r["id"]: r["score"] for r in G.pagerank(edges, tolerance=1e-9, max_iterations=60).collect()}
    want = dense_rank(EDGES)
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[n] - want[n]) < 1e-4 for n in want)


def test_large_sources_are_split(spark, monkeypatch):
    hub = [("hub", f"n{i}") for i in range(30)] + [("n1", "hub"), ("n2", "n3")]
    df = spark.createDataFrame(hub, "src string, dst string")
    plain = {r["id"]: r["score"] for r in G.pagerank(df, iterations=6).collect()}
    real = G.spread_edges
    monkeypatch.setattr(G, "spread_edges", lambda e: real(e, 7))
    split = {r["id"]: r["score"] for r in G.pagerank(df, iterations=6).collect()}
    assert all(abs(plain[n] - split[n]) < 1e-12 for n in plain)
    assert max(r["parts"] for r in G.spread_edges(df)[1].collect()) == 5
    got = {r["id"]: r["betweenness"] for r in G.betweenness(df).collect()}
    assert abs(got["hub"] - brute_betweenness(hub)["hub"]) < 1e-9


def brute_betweenness(pairs):
    links = {(s, d) for s, d in pairs if s != d}
    nodes = sorted({n for e in links for n in e})
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, frontier = {s: 0}, {s: 1.0}, [s], [s]
        while frontier:
            fresh = []
            for v in frontier:
                for a, b in links:
                    if a == v and (b not in dist or dist[b] == dist[v] + 1):
                        if b not in dist:
                            dist[b], paths[b] = dist[v] + 1, 0.0
                            fresh.append(b)
                        paths[b] += paths[v]
            order += fresh
            frontier = fresh
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for a, b in links:
                if b == w and a in dist and dist[a] == dist[w] - 1:
                    dep[a] += paths[a] / paths[w] * (1 + dep[w])
            if w != s:
                score[w] += dep[w]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness(edges):
    got = {r["id"]: r["betweenness"] for r in G.betweenness(edges).collect()}
    want = brute_betweenness(EDGES)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


@pytest.mark.parametrize("name", ["grf3", "grf4"])
def test_registered_betweenness_is_exact_on_small_graphs(edges, monkeypatch, name):
    monkeypatch.setattr(retrieval_plans.O, "citation_edges", lambda _: edges)
    got = {r["id"]: r["betweenness"] for r in getattr(retrieval_plans, name)(SimpleNamespace(office_actions=None)).collect()}
    want = brute_betweenness(EDGES)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def random_graph(n, seed):
    """Hubs, cycles, nodes that nothing points at, some of them with equal targets, loops and repeated edges."""
    rng = np.random.default_rng(seed)
    core = n // 3
    pairs = [(int(a), int(b)) for a, b in zip(rng.integers(0, core, n), (core * rng.random(n) ** 2).astype(int))]
    outer = [(i, int(t)) for i in range(core, n) for t in rng.integers(0, core, int(rng.integers(1, 3)))]
    twins = [(n + i, t) for i in range(5) for t in (0, 1, 2)]
    return [(f"n{a}", f"n{b}") for a, b in [*pairs, *outer, *twins, *pairs[:20], (3, 3)]]


@pytest.mark.parametrize("way", ["tasks", "small batches", "joins"])
def test_betweenness_of_a_random_graph(spark, monkeypatch, way):
    pairs = random_graph(60, 7)
    if way == "small batches":
        monkeypatch.setattr(Z, "CELLS", 100)
    if way == "joins":
        monkeypatch.setattr(Z, "ROWS", 2500)  # several batches of searches
    df = spark.createDataFrame(pairs, "src string, dst string")
    got = {r["id"]: r["betweenness"] for r in Z.betweenness(df, sent_edges=0 if way == "joins" else 10_000, fan=8).collect()}
    want = brute_betweenness(pairs)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_inner_edges_are_sent_by_their_number(spark, monkeypatch):
    def no_joins(*_):
        raise AssertionError("searched by joins")

    monkeypatch.setattr(scaling, "BROADCAST_BYTES", 100)  # the size as text does not matter
    monkeypatch.setattr(Z, "_by_joins", no_joins)
    pairs = random_graph(40, 9)
    got = {r["id"]: r["betweenness"] for r in Z.betweenness(spark.createDataFrame(pairs, "src string, dst string")).collect()}
    want = brute_betweenness(pairs)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-12 for n in want)


def test_searches_leave_no_trace():
    rng = np.random.default_rng(3)
    starts, targets = Z.compressed(rng.integers(0, 30, 90), rng.integers(0, 30, 90), 30)
    state = Z.Searches(starts, targets, 2)
    search = (np.array([-1, 4]), np.array([2, 1]), np.array([0, 1, 7]), np.array([3.0, 1.0]))
    state.run(*search)
    once = state.total.copy()
    state.run(*search)
    assert once.any() and np.allclose(state.total, 2 * once)
    assert state.unseen.all() and not state.lean.any()


def test_sampled_betweenness_is_within_the_stated_error(spark):
    pairs = random_graph(300, 8)
    want = brute_betweenness(pairs)
    df = spark.createDataFrame(pairs, "src string, dst string")
    eps = 0.05
    inner = len({a for a, b in pairs if a != b} & {b for a, b in pairs if a != b})
    pointed = len({b for a, b in pairs if a != b})
    used = Z.sources_for(inner, pointed / (len(want) - 2), eps)
    assert used < len(want)  # so it samples
    for seed in (1, 2):
        got = {r["id"]: r["betweenness"] for r in Z.betweenness(df, eps=eps, seed=seed).collect()}
        assert got.keys() == want.keys() and max(abs(got[n] - want[n]) for n in want) <= eps
    assert Z.sources_for(1000, 1.0, 0.01, 0.1) == 49518


def test_equal_sources_are_searched_once(spark):
    links = spark.createDataFrame([(5, 0), (5, 1), (6, 0), (6, 1), (7, 1), (0, 1)], "src long, dst long")
    chosen = spark.createDataFrame([(i,) for i in (0, 1, 5, 6, 7)], "node long")
    got = {(r["root"], tuple(r["targets"])): r["weight"] for r in Z.searches(links, chosen, 2).collect()}
    assert got == {(0, (1,)): 1, (-1, (0, 1)): 2, (-1, (1,)): 1}


def test_earlier_case_edges(spark, monkeypatch):
    rows = [("a", "2000-01-01", 3), ("b", "2000-01-01", 0), ("c", "2001-01-01", 2), ("d", "2002-01-01", 9), ("e", None, 5)]
    df = spark.createDataFrame(rows, "id string, date_filed string, citation_count long").withColumn("date_filed", F.col("date_filed").cast("date"))
    want = {("c", "a"), ("c", "b"), ("d", "a"), ("d", "b"), ("d", "c")}
    assert {(r["src"], r["dst"]) for r in G.earlier_case_edges(df).collect()} == want
    monkeypatch.setattr(G, "fits_broadcast", lambda *_: False)
    assert {(r["src"], r["dst"]) for r in G.earlier_case_edges(df).collect()} == want


def vectors(spark, n=400, d=8, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, d)).astype(np.float32)
    m[10] = m[20]  # equal vectors tie by id
    m[n // 2:] = m[n // 2:] * 0.01 + 5  # half of the rows sit in one spot
    return m, spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "id long, vector array<float>").repartition(5)


def clustered(spark, n=3000, d=6, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, d)) * 50
    m = (centres[rng.integers(0, 40, n)] + rng.normal(size=(n, d))).astype(np.float32)
    m[7] = m[9] = m[11]
    return m, spark.createDataFrame([(i, m[i].tolist()) for i in range(n)] + [(n, None)], "id long, vector array<float>").repartition(5)


@pytest.mark.parametrize("make", [vectors, clustered])
def test_pruned_search_equals_the_whole_search(spark, make):
    m, df = make(spark)
    some = df.where("id % 7 = 0")
    for queries, k in ((df, 5), (some, 1), (some, 30)):
        want = sorted(tuple(r) for r in R.nearest(queries, df, k).collect())
        found, met = PR.searched(queries, df, k)
        assert sorted(tuple(r) for r in found.collect()) == want
    if make is clustered:
        found, met = PR.searched(df, df, 5)
        pairs = met.selectExpr("sum(queries * rows)").first()[0]
        assert pairs < 0.1 * len(m) ** 2


def test_queries_of_many_cells_meet_rows_in_blocks(spark):
    m = np.random.default_rng(2).normal(size=(600, 32))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(600)], "id long, vector array<double>").repartition(4)
    found, met = PR.searched(df, df, 5)
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in R.nearest(df, df, 5).collect())
    assert met.selectExpr("sum(queries)").first()[0] < 4 * 600


def test_pruned_search_of_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 0.0]), (3, [3.0, 4.0])], "id long, vector array<double>")
    got = {(r["query_id"], r["id"]): r["distance"] for r in PR.pruned_nearest(df, df, 10).collect()}
    assert len(got) == 9 and got[1, 3] == 25.0 and got[2, 1] == 0.0
    assert PR.pruned_nearest(df, df.limit(0), 3).count() == 0 and PR.pruned_nearest(df.limit(0), df, 3).count() == 0


def test_quantised_search(spark):
    m, df = clustered(spark)
    exact = R.nearest(df, df, 5)
    for options in ({}, {"nlist": 30, "nprobe": 8}):
        found = QN.quantised_nearest(df, df, 5, parts=3, **options)
        assert R.recall(found, exact).first()["recall"] >= 0.9
        row = found.where("query_id = 100 AND id <> 100").first()
        assert abs(row["distance"] - float(((m[100].astype(float) - m[row["id"]].astype(float)) ** 2).sum())) < 1e-9
    books = QN.codebooks(df, 3, 16)
    assert [b.shape for b in books] == [(16, 2)] * 3
    x = np.array([[0.0], [0.0], [5.0]])
    assert QN.centroids_of(x, 256, 5, 0).tolist() == [[0.0], [5.0]]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_equals_brute_force_in_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(R, "QUERY_BLOCK", 90)
    monkeypatch.setattr(R, "ROW_BLOCK", 70)
    m, df = vectors(spark)
    df = df.withColumn("id", F.lpad(F.col("id").cast("string"), 6, "0") if kind == "string" else F.col("id"))
    got = {}
    for r in R.nearest(df, df, 6).collect():
        got.setdefault(int(r["query_id"]), []).append((r["distance"], int(r["id"])))
    x = m.astype(float)
    for q in range(len(m)):
        d = ((x - x[q]) ** 2).sum(axis=1)
        want = sorted(zip(d.tolist(), range(len(m))))[:6]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want], q


def test_approximate_recall(spark):
    _, df = vectors(spark, 600)
    exact = R.nearest(df, df, 5)
    assert R.recall(R.approximate_nearest(df, df, 5, nprobe=8), exact).first()["recall"] >= 0.9
    full = R.approximate_nearest(df, df, 5, nlist=6, nprobe=6)
    assert R.recall(full, exact).first()["recall"] == 1.0


def test_encoder_vectors_have_unit_length(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    out = R.encoded(df, "text", lambda texts: np.array([[len(t), 2.0] for t in texts])).collect()
    assert all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-6 for r in out)


def test_encoder_gets_texts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(R, "ENCODED_BYTES", 100)
    monkeypatch.setattr(R, "ENCODED_ROWS", 8)
    rows = [(i, None if i % 9 == 4 else "ab" * (i % 37)) for i in range(300)] + [(300, "é" * 400)]
    df = spark.createDataFrame(rows, "id int, text string").coalesce(1)

    def size(texts):  # all rows of a call learn what it was given
        return np.array([[len(texts), sum(len(t.encode()) for t in texts), 1.0] for _ in texts])

    out = R.encoded(df, "text", size).orderBy("id").collect()
    assert [(r["id"], r["text"]) for r in out] == rows
    for r in out:
        texts, held = (round(v / r["vector"][2]) for v in r["vector"][:2])
        assert texts <= 8 and (held <= 100 or texts == 1)
    assert R.encoded(df.limit(0), "text", size).count() == 0


TEXTS = [
    "The court finds that the software patent claims are invalid under the statute. See 567 U.S. 101. Alpha beta gamma delta.",
    "The court finds that the software patent claims are invalid under the statute. See 567 U.S. 101. Alpha beta gamma delta!",
    "The motion was granted because the network device infringes the claims in suit. Alpha epsilon zeta eta theta.",
    "A literal infringement was alleged by the owner of the digital database. Iota kappa lambda 567 U.S. 102.",
    "Nothing legal is said here at all, only alpha and omega words repeated.",
]


def test_similar_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "STRATEGY_BLOCK", 1)
    monkeypatch.setattr(S, "CASE_BLOCK", 2)
    rows = [(i, t, f"{1995 + 6 * i}-01-01") for i, t in enumerate(TEXTS)]
    cases = spark.createDataFrame(rows, "id long, t string, d string")
    profiles = S.profiled(cases, "id", "t", "d")
    queries = S.profiled(spark.createDataFrame([(7, TEXTS[0]), (8, TEXTS[2] + " " + TEXTS[3])], "id long, t string"), "id", "t")
    model = S.fit_case_terms(profiles, 100, 1.0, 2)
    got = {(r["query_id"], r["id"]): r["similarity"] for r in S.similar_pairs(queries, profiles, model).collect()}
    from docketry.lexicons import PERIOD_RANK
    from docketry.operators.retrieval import with_tfidf

    left = {r["id"]: r for r in with_tfidf(model, queries).collect()}
    right = {r["id"]: r for r in with_tfidf(model, profiles).collect()}

    def overlap(a, b):
        a, b = set(a), set(b)
        return len(a & b) / len(a | b) if a | b else 0.0

    want = {}
    for q, x in left.items():
        for c, y in right.items():
            s = (0.4 * float(x["terms"].dot(y["terms"])) + 0.3 * overlap(x["issues"], y["issues"])
                 + 0.2 * (1 - abs(PERIOD_RANK[x["time_period"]] - PERIOD_RANK[y["time_period"]]) / 3)
                 + 0.1 * overlap(x["citations"], y["citations"]))
            if s > 0.3:
                want[(q, c)] = s
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    details = S.with_arguments(profiles)
    chosen = S.distinct_top_cases(S.similar_pairs(queries, profiles, model), details, 3)
    kept = [r["id"] for r in chosen.where("query_id = 7").orderBy("place").collect()]
    assert kept[0] == 1 and len(kept) == len(set(kept))  # case 1 lies nearer to the default period than case 0


def test_near_copies_are_left_out(spark):
    pairs = spark.createDataFrame([(1, i, 0.9 - i / 100) for i in range(6)], "query_id long, id long, similarity double")
    same = [{"text": "claims are invalid", "context": "it is said that claims are invalid"}]
    point = [{"type": "holding", "text": "the claims are invalid today"}]
    rows = [(0, "p", same, point), (1, "p", same, point), (2, "q", same, point), (3, "p", same, []), (4, "p", [], point), (5, "p", [], point)]
    details = spark.createDataFrame(
        rows, "id long, time_period string, winning_arguments array<struct<text:string,context:string>>, key_points array<struct<type:string,text:string>>")
    got = [r["id"] for r in S.distinct_top_cases(pairs, details, 5).orderBy("place").collect()]
    assert got == [0, 2, 3, 4]  # 1 copies 0; 5 copies 4; other period or no points never do


def test_string_ids(spark):
    rows = [(f"US{i}A", t) for i, t in enumerate(TEXTS)]
    profiles = S.profiled(spark.createDataFrame(rows, "id string, t string"), "id", "t")
    model = S.fit_case_terms(profiles, 100, 1.0, 2)
    same = {r["query_id"]: r["similarity"] for r in S.similar_pairs(profiles, profiles, model).collect() if r["id"] == r["query_id"]}
    assert set(same) == {r[0] for r in rows}
    asked = S.profiled(spark.createDataFrame([(7, TEXTS[0])], "id long, t string"), "id", "t")
    assert {(r["query_id"], type(r["id"])) for r in S.similar_pairs(asked, profiles, model).collect()} == {(7, str)}
    minority = spark.createDataFrame([(f"US{i}A", [float(i), 0.0], float(i < 4)) for i in range(12)], "id string, vector array<double>, label double")
    made = [r["id"] for r in L.synthetic_minority(minority).collect() if r["synthetic"]]
    assert sorted(made) == ["US0A", "US1A", "US2A", "US3A"]


def test_search_fills_up_behind_one_name(spark):
    """The nearest rows share a name; the search widens until k names are found."""
    n = 80
    rows = [(i, "Same v. Same" if i < 50 else f"Case {i}", "2001-01-01", "c", "software claims", "[]", 0.5) for i in range(n)]
    cases = spark.createDataFrame(rows, "id long, case_name string, date_filed string, court string, text_excerpt string, tech_keywords_found string, tech_relevance_score double")
    cases = cases.withColumn("date_filed", F.col("date_filed").cast("date"))
    vectors_ = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(n)], "id long, vector array<float>")
    asked = spark.createDataFrame([(900, "software", [0.0, 1.0]), (901, "software", [79.0, 1.0])], "id long, text string, vector array<float>")
    found = R.hybrid_search(asked, cases, vectors_, spark.createDataFrame([], "id long, score double"), k=5, pool=4).collect()
    got = {q: sorted(r["id"] for r in found if r["query_id"] == q) for q in (900, 901)}
    assert got == {900: [0, 50, 51, 52, 53], 901: [75, 76, 77, 78, 79]}
    few = R.hybrid_search(asked, cases.where("id < 52"), vectors_, spark.createDataFrame([], "id long, score double"), k=5, pool=4)
    assert sorted(r["id"] for r in few.collect() if r["query_id"] == 900) == [0, 50, 51]


def test_synthetic_rows_lie_between_nearest_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=2).tolist(), 1.0 if i < 15 else 0.0) for i in range(60)]
    rows[3] = (3, rows[2][1], 1.0)  # equal vectors
    df = spark.createDataFrame(rows, "id long, vector array<double>, label double")
    first = None
    for block in (4096, 4):  # the same points however the search is dealt out
        monkeypatch.setattr(R, "QUERY_BLOCK", block)
        monkeypatch.setattr(R, "ROW_BLOCK", block)
        made = sorted((r["id"], tuple(r["vector"]), r["label"]) for r in L.synthetic_minority(df).collect() if r["synthetic"])
        assert len(made) == 30 and all(r[2] == 1.0 for r in made)
        first = first or made
        assert made == first
    points = {r[0]: np.array(r[1]) for r in rows if r[2] == 1.0}
    for i, x, _ in made:
        p = points[i]
        near = sorted((k for k in points if k != i), key=lambda k: float(((points[k] - p) ** 2).sum()))[:5]
        assert any(abs(np.linalg.norm(x - p) + np.linalg.norm(x - points[k]) - np.linalg.norm(p - points[k])) < 1e-9 for k in near)


def test_pagerank_of_a_graph_with_many_nodes_that_nothing_points_at(spark, monkeypatch):
    pairs = random_graph(60, 9)
    df = spark.createDataFrame(pairs, "src string, dst string")
    sizes = []
    real = G.spread_edges
    monkeypatch.setattr(G, "spread_edges", lambda e: sizes.append(e.count()) or real(e))
    got = {r["id"]: r["score"] for r in G.pagerank(df, tolerance=1e-9).collect()}
    want = dense_rank(pairs)
    assert got.keys() == want.keys() and all(abs(got[n] - want[n]) < 1e-8 for n in want)
    sources, targets = {a for a, _ in pairs}, {b for _, b in pairs}
    assert sizes == [len({(a, b) for a, b in pairs if a in targets and b in sources})]  # the steps run over inner edges


def test_steps_of_pagerank_over_arrays_equal_joins(spark, monkeypatch):
    pairs = random_graph(80, 11)
    df = spark.createDataFrame(pairs, "src string, dst string")
    rank = lambda **more: {r["id"]: r["score"] for r in G.pagerank(df, tolerance=1e-10, **more).collect()}
    joined = []
    real = G._steps_by_joins
    monkeypatch.setattr(G, "_steps_by_joins", lambda *a: joined.append(1) or real(*a))
    here = rank()
    assert not joined  # a small graph takes no join for each step
    want, far = dense_rank(pairs), rank(held=10)
    assert joined and here.keys() == far.keys() == want.keys()
    assert all(abs(here[n] - want[n]) < 1e-9 and abs(here[n] - far[n]) < 1e-9 for n in want)


def test_a_query_goes_once_to_a_group_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    monkeypatch.setattr(R, "ROW_BLOCK", 50)  # three groups
    cells, centres = R.build_cells(rows, 12)
    asked, placed = R.probed(rows, cells.select("id", "vector", "cell"), centres, 8)
    sent = asked.groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("space").alias("s"), F.sum(F.size("cells")).alias("c")).collect()
    assert all(r["n"] == r["s"] <= 3 and r["c"] == 8 for r in sent)
    assert placed.count() == 120
    cell = {r["id"]: r["cell"] for r in cells.collect()}
    got = {}
    for r in R.nearest_within(asked, placed, 5).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    for q in range(120):
        near = set(np.argsort(((centres - x[q]) ** 2).sum(axis=1), kind="stable")[:8].tolist())
        order = sorted((((x[i] - x[q]) ** 2).sum(), i) for i in range(120) if cell[i] in near)
        assert got[q] == {i for _, i in order[:5]}


def test_balancing_compares_points_of_near_cells_only(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 6, size=(400, 1)) * 100.0 + rng.random((400, 3))
    data = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(1000 + i, [0.0] * 3, 0.0) for i in range(500)]
    met, real = [], PR.searched
    monkeypatch.setattr(PR, "searched", lambda *a: met.append(real(*a)) or met[0])
    made = L.synthetic_minority(spark.createDataFrame(data, "id long, vector array<double>, label double")).where("synthetic")
    assert made.count() == 100
    assert met[0][1].agg(F.sum(F.col("queries") * F.col("rows"))).first()[0] < 400 * 400 / 3


def test_betweenness_numbers_only_the_nodes_it_needs(spark, monkeypatch):
    """Of nodes that nothing points at only the drawn sources; the drawn ones are the first by hash."""
    from docketry.operators import centrality as C

    pairs = [(f"leaf{i}", f"n{i % 7}") for i in range(300)] + [(f"n{i}", f"n{(i * 3 + 1) % 7}") for i in range(7)]
    df = spark.createDataFrame(pairs, "src string, dst string")
    sizes, real = [], C.global_rank
    monkeypatch.setattr(C, "global_rank", lambda d, *a: sizes.append(d.count()) or real(d, *a))
    got = {r["id"]: r["betweenness"] for r in G.betweenness(df, sources=40).collect()}
    assert len(got) == 307 and sizes[0] <= 7 + 40
    ids = spark.createDataFrame([(x,) for x in got], "id string")
    first = {r["id"] for r in ids.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(40).collect()}
    assert {r["id"] for r in ids.where(C.drawn(ids, 307, 40, 42)).collect()} == first
    whole = brute_betweenness(pairs)
    exact = {r["id"]: r["betweenness"] for r in G.betweenness(df).collect()}
    assert all(abs(exact[x] - whole[x]) < 1e-9 for x in whole)
    far = {r["id"]: r["betweenness"] for r in G.betweenness(df, sources=40, sent_edges=0).collect()}
    assert far.keys() == got.keys() and all(abs(far[x] - got[x]) < 1e-12 for x in got)


def test_blocks_of_queries_grow_with_their_number(spark, monkeypatch):
    """Rows are copied once for each block of queries, so these do not stay small when queries are many."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 3)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(4)
    monkeypatch.setattr(R, "QUERY_BLOCK", 10)
    monkeypatch.setattr(R, "MOST_QUERIES", 300)
    seen, real = [], R.block_pairs
    monkeypatch.setattr(R, "block_pairs", lambda *a: seen.append(real(*a)) or seen[-1])
    found = R.nearest(rows, rows, 3).collect()
    cores = spark.sparkContext.defaultParallelism
    copies = seen[0].where("is_row = 1").groupBy("id").agg(F.countDistinct("a").alias("n")).agg(F.max("n")).first()[0]
    assert copies <= -(-900 // (900 // (4 * cores))) < 90 and seen[0].schema["vector"].dataType.simpleString() == "array<float>"
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(axis=2)
    want = {(q, int(i)): d[q, i] for q in range(900) for i in np.lexsort((np.arange(900), d[q]))[:3]}
    assert {(r["query_id"], r["id"]) for r in found} == want.keys()
    assert all(r["distance"] == want[r["query_id"], r["id"]] for r in found)
