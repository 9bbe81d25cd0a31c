import random

from docketry.operators.gazetteer import name_matches


def count(text, name):
    return sum(text.startswith(name, i) for i in range(len(text)))


def test_equals_plain_search_in_any_blocks(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abé𝄞 ") for _ in range(n))
    texts = [(i % 30, word(rng.randrange(60))) for i in range(40)] + [(50, None), (51, "")]
    names = [(rng.choice("XY"), word(rng.randrange(1, 4))) for _ in range(60)] + [("X", None), ("X", ""), (None, "ab")]
    rows = spark.createDataFrame(texts, "id int, t string").selectExpr("*", "'x' AS name", "1 AS n")
    table = spark.createDataFrame(names, "kind string, name string")
    order = lambda rows: sorted(rows, key=repr)
    expected = order((i, k, n, count(t, n)) for i, t in texts if t for k, n in set(names) if n and n in t)
    for block in (10_000, 40):
        assert order(tuple(r) for r in name_matches(rows, "id", "t", table, block).collect()) == expected
    assert name_matches(rows, "id", "t", table.limit(0)).count() == 0
    assert name_matches(rows.limit(0), "id", "t", table).count() == 0


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).selectExpr("'ID' AS kind", "concat('name', id, ';') AS name")
    texts = spark.range(500).selectExpr("id", "concat('name', id, '; name', id + 99800, '; name', id) AS t")
    found = name_matches(texts, "id", "t", names)
    assert found.count() == 500 + 200 and found.where("n = 1").count() == 700
