"""The pipeline, stage by stage, and the registered queries."""

import duckdb
import pytest
import __spark_entry__ as entry
import check_oracle
import corpus_pipeline
from docketry.llm import mixing, sanitise
from docketry.llm.queries import ORACLES, QUERIES
from docketry.sources.views import TABLES
from tests.llm.helpers import ODD, documents
from tests.llm.test_models import toxic_rows
from tests.llm.test_near import shingles

DATA = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tmp_path_factory.mktemp("tables")


def test_stages_one_by_one(spark, folder):
    rows, labels = toxic_rows(400)
    rows += [(1000, rows[3][1], "en", "b"), (1001, rows[4][1] + " more", "en", "b"), (1002, "write to me@example.org now please", "fr", "c")]
    docs = documents(spark, rows).select(COLUMNS)
    spark.createDataFrame(labels, "doc_id long, toxic int, quality string").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    truth = {i: y for i, y, _ in labels}
    one = corpus_pipeline.toxicity(spark, docs, str(folder))
    assert one.columns == COLUMNS
    left = {r["doc_id"] for r in one.collect()}
    wrong = [i for i, y in truth.items() if (i in left) == bool(y)]
    assert len(wrong) <= 4 and 1002 in left
    two = corpus_pipeline.near_duplicates(spark, one, str(folder))
    kept = {r["doc_id"]: r["text"] for r in two.collect()}
    assert two.columns == COLUMNS
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in one.collect()}
    for i, s in sets.items():  # every dropped text has a smaller near copy, and no two kept ones are near
        near = [j for j in sets if j != i and s and 100 * len(s & sets[j]) >= 80 * len(s | sets[j])]
        assert not (i in kept and any(j in kept for j in near)) and (i in kept or any(j < i for j in near))
    three = corpus_pipeline.personal_data(spark, two, str(folder))
    assert three.columns == COLUMNS
    clean = {r["doc_id"]: r for r in three.collect()}
    assert clean.keys() == kept.keys() and all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert clean[1002]["text"].split()[2] == "[email]"
    assert all(not sanitise.base_spans(r["text"]) for r in clean.values())
    four = corpus_pipeline.mixture(spark, three, str(folder))
    assert four.columns == COLUMNS
    dealt = sorted(r["doc_id"] for r in four.collect())
    assert dealt == sorted(r["doc_id"] for r in mixing.mixture(three).collect()) and set(dealt) <= set(kept)
    five = corpus_pipeline.byte_pairs(spark, four, str(folder)).collect()
    assert sorted(r["doc_id"] for r in five) == dealt and all(r["round_trip"] for r in five)
    assert all(r["n_tokens"] == len(r["ids"]) for r in five)


def test_run_equals_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(folder))
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, str(folder)).collect()))


def test_odd_documents_pass_every_stage(spark, folder):
    for rows in (ODD, []):
        docs = documents(spark, rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(folder))
        assert (len(docs.collect()) > 0) == bool(rows)


def test_every_operator_is_registered():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(ORACLES) <= set(entry.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixture", "byte_pairs"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert check_oracle._rows(df.columns, [tuple(r) for r in df.collect()]) == check_oracle._rows(columns, cur.fetchall())


@pytest.mark.parametrize("name,columns", [
    ("op1_sanitisation", "doc_id n_email n_ip n_card n_phone base_sha256 spans"),
    ("op2_divergence", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"),
    ("op3_deobfuscation", "doc_id held_out score predicted"), ("op4_url_trees", "page_id host path rule verdict"),
    ("op5_byte_pair", "doc_id n_tokens ids_sha256 decoded_sha256"), ("op6_rotation_codes", "vec_id n_links component_id kept"),
    ("op7_byte_cnn", "doc_id held_out score predicted"), ("op8_bbit_minhash", "doc_id n_shingles component_id kept"),
    ("op9_token_counts", "doc_id n_bytes n_tokens over_limit"),
])
def test_contract_columns(spark, name, columns):
    df = QUERIES[name](spark, DATA)
    assert set(columns.split()) <= set(df.columns)
    table = {"op4_url_trees": "pages", "op6_rotation_codes": "embeddings"}.get(name, "documents")
    assert df.count() == spark.read.parquet(f"{DATA}/{table}.parquet").count()


def test_folds(spark):
    import zlib

    from docketry.llm.queries import fold

    got = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", fold(5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in got)
