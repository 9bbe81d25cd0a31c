import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle
from docketry.sources.views import TABLES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_registry_loads_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["top1_top_keywords", "cln1_repair_misaligned", "txt25_passage_features", "agg11_center_report",
                                  "prj3_quantile_labels", "win8_rank", "jn6_nearest", "fct1_damped_forecast", "set2_union_distinct"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = check_oracle._rows(columns, cur.fetchall())
    assert check_oracle._rows(df.columns, [tuple(r) for r in df.collect()]) == want
