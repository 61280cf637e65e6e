import datetime as dt
import os

import duckdb
from pyspark.sql import functions as F

from reqwatch.operators import kept, places, reports
from reqwatch.plans.registry import ORACLES, QUERIES
from reqwatch.sources import adapters

NOW = "2024-02-01 00:00:00"


def test_longest_blocks_of_both_versions(spark):
    blocks = [("8.0.0.0/8", "wide"), ("8.8.8.0/24", "narrow"), ("8.8.8.8", "one"), ("2600::/16", "six"), ("2600:1::/32", "six narrow"), ("::ffff:9.9.9.0/120", "mapped"), ("odd", "none"), (None, "none"), ("0.0.0.0/0", "anywhere"), ("8.8.8.0/24", "nearer")]
    want = {"8.1.1.1": "wide", "8.8.8.9": "narrow", "8.8.8.8": "one", "2600::1": "six", "2600:1:0:0::5": "six narrow", "9.9.9.9": "mapped", "::ffff:8.8.8.8": "one", "1.2.3.4": "anywhere"}
    rows = spark.createDataFrame([(a,) for a in [*want, "8.1.1.1", "2a00::1", "x", "", None]], "ip_address string")
    got = places.placed(rows, spark.createDataFrame(blocks, "block string, city string")).collect()
    assert {r.ip_address: r.city for r in got} == want and len(got) == len(want)
    assert places.placed(rows, spark.createDataFrame([], "block string, city string")).count() == 0


def test_keys_with_an_address_of_their_own(spark):
    rows = spark.createDataFrame([("a", "8.1.1.1"), ("b", "8.1.1.1"), ("a", "8.1.1.1"), ("c", "2600::1"), ("8.1.1.1", "9.9.9.9"), ("d", None)], "host string, held string")
    got = places.placed(rows, spark.createDataFrame([("8.0.0.0/8", "eight"), ("2600::/16", "six")], "block string, city string"), "host", address="held")
    assert sorted(map(tuple, got.collect())) == [("a", "eight"), ("b", "eight"), ("c", "six")]


def test_places_of_users_beyond_the_last_short_address(spark, tmp_path):
    """From user 65536 on the third number of the view's addresses is above 255."""
    users = [0, 40, 1023, 1024, 1300, 65535, 65536, 65552, 65560, 65599, 66560, 67000, 540_000, 540_001, 540_031, 2**24 + 17, 2**32, 2**32 + 16, 2**40 + 40]
    at = dt.datetime(2024, 1, 2)
    events = spark.createDataFrame([(k, at, u, "view", 1.0, "{}") for k, u in enumerate(users * 2)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, QUERIES["geo_blocks"](spark, str(tmp_path)).select("ip_address", "city").collect()))
    with duckdb.connect() as c:
        c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(c.execute(f"select ip_address, city from ({ORACLES['geo_blocks']})").fetchall())
    assert ("10.0.256.0", "area 256") in got and ("10.0.256.24", "house 24") in got and ("10.0.256.16", "street 256/1") in got


def test_answers_grow_old(spark):
    at = lambda d: dt.datetime(2024, 1, d, 12)
    store = spark.createDataFrame([("8.1.1.1", "old", at(20)), ("8.8.8.9", "known", at(30)), ("5.5.5.5", "not asked", at(31))], "ip_address string, city string, looked_up_at timestamp")
    rows = spark.createDataFrame([("8.1.1.1",), ("8.8.8.9",), ("8.2.2.2",), ("9.9.9.9",)], "ip_address string")
    got = places.renewed(rows, spark.createDataFrame([("8.0.0.0/8", "new")], "block string, city string"), store, NOW).collect()
    assert {r.ip_address: r.city for r in got} == {"8.8.8.9": "known", "5.5.5.5": "not asked", "8.1.1.1": "new", "8.2.2.2": "new"}


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_changes_write_only_the_days_they_touch(spark, tmp_path):
    path = f"{tmp_path}/log"
    rows = [(k, f"8.8.8.{k % 3}", "[m] T", f"https://e.com/p/{k}", k == 4, None, None, None if k == 19 else dt.datetime(2024, 1, 1 + k // 4, k % 4)) for k in range(20)]
    log = spark.createDataFrame(rows, "id long, ip_address string, type string, url string, is_false_positive boolean, country_code string, updated_at timestamp, created_at timestamp")
    for c in ("country_name", "city", "isp", "cloud_provider"):
        log = log.withColumn(c, F.lit(None).cast("string"))
    kept.write(log.withColumns({"is_foreign": F.lit(False), "is_cloud_ip": F.lit(False)}), path)
    state = lambda: {r.id: (r.is_false_positive, r.updated_at is not None, r.country_code) for r in kept.read(spark, path).collect()}
    before = files(path)
    marks = spark.createDataFrame([(4,), (5,), (9,), (19,), (77,), (5,)], "id long")
    rules = kept.mark_false_positives(spark, path, marks, NOW)
    assert sorted((r.created_from_threat_id, r.path_pattern) for r in rules.collect()) == [(5, "p/5"), (9, "p/9"), (19, "p/19")]
    assert {k for k, v in state().items() if v[0]} == {4, 5, 9, 19} and {k for k, v in state().items() if v[1]} == {5, 9, 19} and len(state()) == 20
    after = files(path)
    days = lambda fs: {f.split("day=")[1].split("/")[0] for f in fs}
    same = {f for f in before if after.get(f) == before[f]}
    assert days(same) == {"2024-01-01", "2024-01-04", "2024-01-05"} and days(set(before) - same) == {"2024-01-02", "2024-01-03", "__HIVE_DEFAULT_PARTITION__"}
    assert kept.mark_false_positives(spark, path, marks, NOW).count() == 0 and files(path) == after  # the second time changes nothing
    geo = spark.createDataFrame([("8.8.8.1", "US", "Here", "x", "Amazon.com", "")], "ip_address string, country_code string, country_name string, city string, isp string, org string")
    assert len(kept.enrich(spark, path, geo.where("ip_address = 'none'"))) == 0 and files(path) == after
    assert len(kept.enrich(spark, path, geo)) == 6 and {k for k, v in state().items() if v[2] == "US"} == {k for k in range(20) if k % 3 == 1}
    assert kept.enrich(spark, path, geo) == []
    # 29.9 days before: day 1 goes whole, day 2 but for its last rows
    gone = kept.purge(spark, path, "2024-02-01 02:00:00", 30)
    assert sorted(map(str, gone)) == ["2024-01-01", "2024-01-02"] and sorted(state()) == [*range(6, 20)]
    assert kept.purge(spark, path, "2024-02-01 02:00:00", 30) == [] and "2024-01-01" not in days(files(path))


def test_deep_pages(spark, sf_dir):
    logs = adapters.threat_logs(spark, sf_dir).select("id", "created_at").union(spark.createDataFrame([(k, None) for k in range(10_000, 10_030)], "id long, created_at timestamp_ntz"))
    logs = logs.union(logs.limit(5)).cache()
    n = logs.count()
    for number in (1, 7, n // 20, n // 20 + 1, n // 20 + 5):
        assert list(map(tuple, reports.deep_page(logs, number).collect())) == list(map(tuple, reports.page(logs, number).collect()))
    assert reports.deep_page(logs.limit(0), 3).count() == 0
    plan = reports.deep_page(adapters.threat_logs(spark, sf_dir), 20)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan
