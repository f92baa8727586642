"""Two orders whose public codes are equal, as happens from some millions on."""

import datetime

import duckdb

import __spark_entry__ as entry


def test_nested_export_has_a_row_for_each_code_and_status(spark, tmp_path):
    day = lambda n: datetime.datetime(1998, 1, n)
    orders = [(435366, "O", day(1)), (5418678, "O", day(2)), (6684619, "F", day(1)), (8362893, "O", day(1)), (7, "O", day(3))]
    lines = [(435366, 5, 1, "A", day(9)), (5418678, 4, 1, "N", day(8)), (5418678, 6, 2, "R", day(10)), (6684619, 1, 1, "A", day(4))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r[c] for c in ("id", "status_label", "n", "told")) for r in entry.queries()["nested_export"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.execute(f"SELECT id, status_label, n, told FROM ({entry.oracle_sql()['nested_export']})").fetchall()) and len(got) == 4
