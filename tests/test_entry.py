"""Every contract query runs and agrees with its SQL on a small table set."""

import os

import pytest

DATA = "/root/testdata/sf0.001"


def test_import_without_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= 100)"], cwd=root, capture_output=True, text=True)
    assert done.stdout.strip() == "True", done.stderr


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["object_valid", "object_issues", "string_email", "list_unique", "json_lossless", "date_between", "encode_object", "choice_discriminate"])
def test_query_agrees_with_sql(spark, name):
    import duckdb

    from sparkpact.queries import oracle_sql, queries

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = queries()[name](spark, DATA)
    want = db.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    mine = sorted(map(repr, (tuple(r) for r in got.select(*columns).collect())))
    assert mine == sorted(map(repr, want.fetchall()))


def test_dict_values_of_odd_balances_agree_with_sql(spark, tmp_path):
    import duckdb

    from sparkpact.queries import oracle_sql, queries

    balances = [-0.0, 0.0, -0.01, 5.0, None, float("nan"), -999.99]
    path = str(tmp_path / "customer.parquet")
    spark.createDataFrame([(k, k % 3, b) for k, b in enumerate(balances)], "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(path)
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{path}/*.parquet'")
    got = queries()["dict_values"](spark, str(tmp_path)).select("c_custkey", "path", "message_key").collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(oracle_sql()["dict_values"]).fetchall())
