"""Every query that has SQL gives what DuckDB gives."""

import os

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else repr(v)
    return sorted(columns), sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if n in __spark_entry__.queries()])
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    got = con.execute(__spark_entry__.oracle_sql()[name])
    columns = [c[0] for c in got.description]
    assert norm([tuple(r) for r in df.collect()], df.columns) == norm(got.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_snapshot_verdicts_of_one_turn(spark, tmp_path):
    spark.createDataFrame([(5, 0), (10, 0), (10, 1), (3, 0), (3, 1), (4, 1)], "conv_id long, turn int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = __spark_entry__.queries()["snapshot_verdicts"](spark, str(tmp_path)).collect()
    assert {r.conv_id: r.complete for r in got} == {5: True, 10: False, 3: True, 4: False}
