from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("last, first", [("2024-01-19 23:59:59.8", "2024-01-20 00:00:00.1"), ("2024-01-19 23:59:58.5", "2024-01-20 00:00:02.5"), ("2024-01-19 23:59:59.999999", "2024-01-20 00:00:00")])
def test_temporal_check_within_a_second(spark, tmp_path, last, first):
    """The ends are compared as they are, not as the whole seconds that are reported."""
    rows = [(datetime.fromisoformat(x),) for x in ("2024-01-02 03:04:05", last, first, "2024-01-25 00:00:00")] + [(None,)]
    spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()["sp08_temporal_check"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == con.execute(entry.oracle_sql()["sp08_temporal_check"]).fetchall()


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_temporal_check_in_any_time_zone(spark, tmp_path, zone):
    """Times without a zone give the same ends whatever the session's zone is; 2024-03-10 02:30 does not exist in New York."""
    rows = [(datetime.fromisoformat(x),) for x in ("2024-01-02 03:04:05", "2024-01-19 23:59:59.860451", "2024-03-10 02:30:00.5", "2024-03-10 03:10:00")]
    spark.createDataFrame(rows, "ts timestamp_ntz").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = entry.queries()["sp08_temporal_check"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [tuple(r) for r in got] == con.execute(entry.oracle_sql()["sp08_temporal_check"]).fetchall()
