"""request_ttl where a requester repeats a value with another age, and where a click has none."""

import datetime

import duckdb

from ledgerwing.plans import event_queries as eq


def test_repeated_value_is_no_change(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    rows = [(1, 1.5, "click"), (2, 1.5, "click"), (20, 2.5, "click"), (21, 2.5, "click"), (33, None, "click"), (34, 1.5, "click"), (35, -0.0, "click"), (36, 0.0, "click"), (37, 0.0, "view"), (68, 3.5, "click")]
    df = spark.createDataFrame([(i, at + datetime.timedelta(seconds=i), 7, e, v, "") for i, v, e in rows], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(eq.ORACLE_SQL["request_ttl"]).fetchall(), key=str)
    got = sorted(map(tuple, eq.QUERIES["request_ttl"](spark, str(tmp_path)).collect()), key=str)
    assert got == want and [d for i, d in want if i in (2, 21)] == ["NO_CHANGE", "NO_CHANGE"]
