import random
import re
from html.parser import HTMLParser

from pyspark.sql import functions as F

from docketry.functions import patent as P
from docketry.functions import text as X
from docketry.operators import near_lists as N


def one(spark, value, column):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(column(F.col("v")).alias("r")).first()["r"]


def test_claim_numbers(spark):
    cases = {"1-3, 7": [1, 2, 3, 7], "x, 4": [4], "1-a": [], "3-1": [], "1-2-3": [], "": [], None: [], "5,5, 2": [2, 5],
             "3-1, 9": [9], "2 - 4": [2, 3, 4], "-5": []}
    for text, want in cases.items():
        assert one(spark, text, P.claim_numbers) == want, text


def test_rejection_types(spark):
    cases = {"§103": ["103"], "c. 102": ["102"], "c.112": ["112"], "section 103": [], "section103": ["103"], None: [],
             "§103 and c. 101, §103": ["101", "103"]}
    for text, want in cases.items():
        assert one(spark, text, P.rejection_types) == want, text
    assert one(spark, "section 103", lambda c: P.rejection_types(c, allow_space=True)) == ["103"]


def test_keyword_lists(spark):
    cases = {None: [], "[]": [], "['primary:patent', 'secondary:Cloud ']": ["patent", "cloud"], "broken [": [],
             "['plain', ' ']": ["plain"], "[\"primary:it's\"]": ["it's"]}
    for text, want in cases.items():
        assert one(spark, text, X.parse_keywords) == want, text


def test_relevance_counts_words_and_phrases(spark):
    text = "Software software. The data breach of a computer network; softwares."
    # primary: software x2, computer, data breach; secondary: network; context: software x2, computer, network, data
    assert abs(one(spark, text, X.tech_relevance) - min(1.0, (4 * 5 + 3 + 5) / 72)) < 1e-12
    assert one(spark, "Not Available", X.tech_relevance) == 0.0
    assert one(spark, None, X.tech_relevance) == 0.0
    assert one(spark, "DMCA notice", X.matching_keywords) == ["secondary:dmca"]


def test_term_with_punctuation_is_counted_apart(spark):
    count = lambda c: X.term_hits(F.lower(c), ["e-commerce", "commerce"])
    assert one(spark, "e-commerce and commerce", count) == 3


def test_html_text(spark):
    html = "<html><script>var a='</p>';</script><style>p{}</style><!-- no --><p>A &amp;lt; B</p><p>C&nbsp;&#233;&amp D</p></html>"
    assert one(spark, html, X.strip_html) == "A &lt; BC é& D"


class _Visible(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.hidden = [], False

    def handle_starttag(self, tag, attrs):
        self.hidden |= tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden &= tag not in ("script", "style")

    def handle_data(self, data):
        if not self.hidden:
            self.found.append(data)


def visible(html):
    parser = _Visible()
    parser.feed(html)
    parser.close()
    return re.sub(r"\s+", " ", "".join(parser.found)).strip()


def test_page_text_equals_the_standard_parser(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    pages += [
        '<a title="a>b">link</a>', "&#38;lt; &#x26;gt;", "&#xE9;&eacute;&euro;&hellip; &notit; &notin; &ampx; &unknown; &",
        "&#0;&#x80;&#129;&#55296;&#99999999999;&# x &#x; &#7;&#65534;&#x1F600;", "<p it's>x</p> a < b & c", '<b a=x="y>z">t',
        "<script-foo>shown</script-foo><SCRIPT a='>'>x</p></Script >y", "<i a = 'q>r' b>u</i>&copy2026;&AMP;&NotEqualTilde;",
        "a<br/>b<img src=x/>c<!-- > -->d<!doctype x>e<?php f>g</ >h", "", "<p " + "a='>' " * 20_000 + ">long</p>", "&amp;" * 20_000,
    ]
    df = spark.createDataFrame([(h,) for h in pages], "html string").select("html", X.strip_html("html").alias("text"))
    for row in df.collect():
        assert row["text"] == visible(row["html"]), row["html"][:200]
    assert one(spark, None, X.strip_html) is None


def test_citation_recency_uses_four_digit_years(spark):
    df = spark.createDataFrame([("in 1998 and 2015", "2010_2020"), ("", "pre_2000")], "t string, p string")
    assert [r["r"] for r in df.select(X.citation_recency("t", "p").alias("r")).collect()] == [0.5, 0.0]


def test_complexity_of_empty_text(spark):
    assert one(spark, "", X.legal_complexity) == 0.0
    assert one(spark, "", X.precedent_influence) == 0.0


def test_sentences_keep_abbreviations(spark):
    text = "Smith v. Jones came first. Mr. Lee lost! Was it so? Yes."
    assert one(spark, text, X.sentences) == ["Smith v. Jones came first.", "Mr. Lee lost!", "Was it so?", "Yes."]


def test_citations_with_reference_list(spark):
    text = ("Under 567 U.S. 123 and U.S. Patent No. 7,123,456 and 567 U.S. 123. 2015 WL 99\n"
            "References Cited here\n[1] First entry [2] Second entry\n\nEnd")
    found = one(spark, text, X.citations)
    assert found[:3] == ["567 U.S. 123", "U.S. Patent No. 7,123,456", "2015 WL 99"]
    assert "First entry" in found and "Second entry" in found


def test_near_duplicates_keep_the_first(spark):
    items = ["a b c d e f g h i j", "a b c d e f g h i k", "x y", "a b c d e f g h i j z"]

    def brute(limit):
        kept = []
        for x in items:
            t = set(x.split())
            if not any(len(t & set(k.split())) / len(t | set(k.split())) > limit for k in kept):
                kept.append(x)
        return kept

    df = spark.createDataFrame([(items,)], "v array<string>")
    for limit in (0.7, 0.8, 0.85, 0.95):
        got = df.select(X.drop_near_duplicates(F.col("v"), limit, "string").alias("r")).first()["r"]
        assert got == brute(limit), limit


def test_insights_and_points(spark):
    text = "Intro here. The court finds that the claims are invalid today. It was so because the record is thin enough. End."
    df = spark.createDataFrame([(text,)], "t string").select(X.sentences("t").alias("s"))
    wins = df.select(X.insights("s", X.lexicons.INSIGHT_PATTERNS["winning_arguments"]).alias("r")).first()["r"]
    assert [w["text"] for w in wins] == ["the claims are invalid today"]
    assert wins[0]["context"].startswith("Intro here.") and wins[0]["context"].endswith("thin enough.")
    points = df.select(X.key_points("s").alias("r")).first()["r"]
    assert [(p["type"], p["text"]) for p in points] == [
        ("holding", "the claims are invalid today"), ("reasoning", "so because the record is thin enough")]  # "as" inside "was"


def test_points_are_split_once(spark):
    kinds, words = ("holding", "reasoning"), ("alpha beta gamma", "beta gamma delta", "omega", "alpha omega beta beta", "")
    lists = [[(kinds[i % 2], words[(i * j + i) % 5]) for i in range(j)] for j in range(7)]
    rows = [(i, lists[i], b) for i in range(7) for b in lists]
    point = "array<struct<type:string,text:string>>"
    df = spark.createDataFrame(rows, f"i int, a {point}, b {point}").select("a", "b", X.point_similarity("a", "b").alias("s"))
    for r in df.collect():
        sets = [[(p["type"], set(p["text"].split())) for p in r[c]] for c in ("a", "b")]
        want = max((len(x & y) / len(x | y) if x | y else 0.0 for t, x in sets[0] for u, y in sets[1] if t == u), default=0.0)
        assert r["s"] == want
    pairs = df._jdf.queryExecution().optimizedPlan().toString().split("array_intersect(")[1:]
    assert pairs and all("split(" not in p.split("try_divide")[0].split("array_distinct")[0] and not p.startswith("array_distinct") for p in pairs)


def test_period_boundaries(spark):
    cases = {"1999-12-31": "pre_2000", "2000-01-01": "2000_2010", "2009-12-31": "2000_2010", "2010-01-01": "2010_2020",
             "2020-01-01": "post_2020", "": "2010_2020", None: "2010_2020", "soon": "2010_2020"}
    for day, want in cases.items():
        assert one(spark, day, X.time_period) == want, day


def test_legal_issues_by_period(spark):
    df = spark.createDataFrame([("a useful thing", "pre_2000"), ("a useful thing", "post_2020"), ("VALID 101", "2000_2010")],
                               "t string, p string")
    got = [r["r"] for r in df.select(X.legal_issues("t", "p").alias("r")).collect()]
    assert got == [["patentability"], [], ["patentability", "validity"]]


def test_parties_need_two_sides(spark):
    assert tuple(one(spark, "A v. B", X.parties)) == ("A", "B")
    assert tuple(one(spark, "A v. B v. C", X.parties)) == ("", "")


def test_question_tags(spark):
    q = "Is my invention in the field of computer vision obvious over US7123456?"
    df = spark.createDataFrame([(q,)], "q string").withColumn("tok", P.question_tokens("q"))
    row = df.select(P.question_type("q").alias("t"), P.question_rejections("q").alias("s"), P.technical_field("tok").alias("f"),
                    P.cited_patents("q").alias("r"), P.claim_span("tok").alias("c")).first()
    assert row["t"] == "general" or row["t"] == "patentability"
    assert row["s"] == ["103"] and row["f"] == "of computer vision" and row["r"] == ["7123456"]
    assert row["c"].startswith("is my invention in the field")


def _greedy(lines, limit):
    kept = []
    for place, line in enumerate(lines):
        words = set((line or "").lower().split())
        if all(not (words | other) or len(words & other) / len(words | other) <= limit for _, other in kept):
            kept.append((place, words))
    return [place for place, _ in kept]


def test_near_duplicates_of_long_lists(spark):
    rng = random.Random(5)
    lists = {k: [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 7))) for _ in range(60)] for k in ("x", "y", None)}
    # A chain in which each line is like its neighbours only, equal lines, null and blank ones.
    lists["chain"] = [" ".join(f"w{i + j}" for j in range(10)) for i in range(12)] + [None, " ", "w1", "W1 w1", "w1"]
    lists["common"] = ["the " * 3 + f"of and {i} {i + 1000}" for i in range(300)] + ["the of and 7 1007"]
    rows = [(k, i, line, i % 3) for k, lines in lists.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "k string, position int, text string, tokens int")
    for limit in (0.0, 0.5, 0.7):
        found = N.without_near_duplicates(df, ["k"], limit)
        assert found.columns == df.columns
        got = sorted((r["k"] or "", r["position"]) for r in found.collect())
        assert got == sorted((k or "", place) for k, lines in lists.items() for place in _greedy(lines, limit)), limit
    assert N.without_near_duplicates(df.limit(0), ["k"], 0.7).count() == 0
    # Rare words first: lines that share common words only are never compared.
    sets = df.where("k = 'common'").select("k", "position", X.word_set(F.col("text")).alias("tokens"))
    assert N.similar_items(sets, ["k"], 0.7).count() == 1


def test_near_duplicates_of_lists_in_rows(spark, monkeypatch):
    rng = random.Random(7)
    lists = [[" ".join(rng.choices("abcdefGH", k=rng.randint(0, 7))) for _ in range(40)] for _ in range(6)]
    lists += [[], None, [None, " ", "w1", "W1\u00a0w1", "w1\u2003w2"], [" ".join(f"w{i + j}" for j in range(10)) for i in range(12)]]
    df = spark.createDataFrame([(i // 2, v) for i, v in enumerate(lists)], "k int, v array<string>").repartition(2)  # equal keys are lists apart
    for limit in (0.0, 0.5, 0.7, 0.95):
        want = sorted((i // 2, p, v[p] or "") for i, v in enumerate(lists) if v for p in _greedy(v, limit))
        with monkeypatch.context() as m:
            m.setattr(N, "without_near_duplicates", lambda *_: 1 / 0)  # short lists stay in their row
            got = N.lists_without_near_duplicates(df, "v", limit)
            assert got.columns == ["k", "position", "text"]
            assert sorted((r["k"], r["position"], r["text"] or "") for r in got.collect()) == want, limit
        for name, value in (("ROW_ITEMS", 20), ("ROW_CHARS", 100)):
            if limit == 0.7:
                with monkeypatch.context() as m:
                    m.setattr(N, name, value)
                    got = N.lists_without_near_duplicates(df, "v", limit).collect()
                    assert sorted((r["k"], r["position"], r["text"] or "") for r in got) == want, name


def test_blanks_are_those_of_the_pattern(spark):
    chars = [chr(c) for c in range(1, 0x3100)]
    rows = spark.createDataFrame([(c,) for c in chars], "c string")
    found = {r["c"] for r in rows.where(F.regexp_like("c", F.lit(f"^{X.SPACE}$"))).collect()} | {"\n"}
    assert found == set(N.BLANKS)
    for c in chars:
        assert N.words_of(f"a{c}b") == ({"a", "b"} if c in N.BLANKS else {f"a{c}b"})


def test_kept_places_equal_the_greedy_pass():
    rng = random.Random(11)
    for _ in range(300):
        words = "abcdefghijkl"[:rng.randint(3, 12)]
        items = [" ".join(rng.choices(words, k=rng.randint(0, 12))) for _ in range(rng.randint(0, 25))]
        for limit in (0.0, 0.3, 0.5, 0.7, 0.9):
            assert N.kept_places(items, limit) == _greedy(items, limit)


def test_issue_patterns_are_tried_at_first_letters_only(spark):
    from docketry import lexicons

    fast = {i: X.any_pattern(ps) for i, ps in lexicons.ISSUE_PATTERNS.items()}
    assert all(p.startswith("(?=[") for p in fast.values())
    for odd in ([r"\bfoo|bar"], [r"\b(a|b)?c"], [r"(a|b)"], [r"\b(a|b)x|y"], [r"\b(\d+)"], [r"\b(a)", "b"]):
        assert X.any_pattern(odd) == "|".join(odd)
    words = ["infring", "INFRINGES", "İnfringing", "ınvalid", "enſforce", "ſubject matter", "subject  matter", "xinvalid",
             "invalidé", "a 101.", "1101", "induced\n infringement", "induced infringements", "", " ", "alice test", "(mayo test)", "Kind", "natural phenomenon"]
    df = spark.createDataFrame([(i, f"{a} {b}") for i, (a, b) in enumerate((a, b) for a in words for b in words)], "id int, t string")
    for issue, ps in lexicons.ISSUE_PATTERNS.items():
        odd = df.where(F.col("t").rlike("(?iU)" + "|".join(ps)) != F.col("t").rlike("(?iU)" + fast[issue]))
        assert not odd.count() and df.where(F.col("t").rlike("(?iU)" + fast[issue])).count()


def test_has_text(spark):
    texts = [None, "", " \t\n", "  　", " x ", "​", "\x0b\x1c\x85", "."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select((F.length(X.strip_space(F.col("t"))) > 0).alias("a"), X.has_text(F.col("t")).alias("b"), "t").collect():
        assert r["a"] == r["b"], repr(r["t"])
