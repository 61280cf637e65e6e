"""Correlation reports as streams against the batch reports at several times."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from reqwatch.operators import correlate
from reqwatch.streaming import correlation

KIND = "id long, ip_address string, url string, type string, created_at timestamp"
#: An hour that New York's clocks skip lies in these rows' day.
START = dt.datetime(2024, 3, 10, 5, 0, tzinfo=dt.timezone.utc)
BATCH = {"coordinated": correlate.coordinated_attacks, "campaigns": correlate.campaigns, "rapid": correlate.rapid_attackers}


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def made(seed=7, n=1500):
    """Rows of three hours in order of time, with a hot url, ties, repeats, nulls in each column and rows on whole minutes."""
    own, out = random.Random(seed), []
    for k in range(n):
        sec = own.choice([k * 7, k * 7, k * 7 // 60 * 60])
        url = own.choice(["/hot"] * 4 + [f"/u{own.randrange(30)}", None])
        out.append((k, own.choice([f"10.0.0.{own.randrange(25)}", "10.0.0.1", None]), url, own.choice(["A", "B", "C", None]), START + dt.timedelta(seconds=sec)))
    return out + out[-3:] + [(n, "10.0.0.1", "/hot", "A", None)]


def stream_of(spark, folder, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.parquet(f"{folder}/in/part={k:02d}")
    return spark.readStream.schema(KIND + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part")


def run(stream, kind, folder, **more):
    correlation.to_reports(stream, kind, f"{folder}/{kind}", f"{folder}/{kind}-state", watermark="1 minute", **more).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/{kind}/reports").drop("batch")


@pytest.mark.parametrize("kind,window_s,slide_s,bounds", [("coordinated", 900, 300, {"least": 3, "limit": 4}), ("campaigns", 3600, 1200, {"least": 5, "limit": 2, "sample": 3}), ("rapid", 1800, 600, {"least": 3, "limit": 5})])
def test_equal_to_batch_at_each_time(spark, tmp_path, zone, kind, window_s, slide_s, bounds):
    rows = made()
    got = run(stream_of(spark, tmp_path, [rows[k : k + 400] for k in range(0, len(rows), 400)]), kind, tmp_path, window_s=window_s, slide_s=slide_s, **bounds)
    times = [r.at for r in got.select(F.unix_timestamp("as_of").alias("at")).distinct().orderBy("at").collect()]
    last = max(r[4] for r in rows if r[4]).timestamp() - 60
    first = START.timestamp()
    assert times == [t for t in range(int(first) + slide_s, int(last) + 1, slide_s)]
    flat = spark.createDataFrame(rows, KIND)
    for t in (times[0], times[3], times[len(times) // 2], times[-1]):
        as_of = spark.range(1).select(F.timestamp_seconds(F.lit(t)).cast("string")).first()[0]
        want = BATCH[kind](flat.where(F.unix_timestamp("created_at") < t), as_of, window_s, **bounds)
        mine = got.where(F.unix_timestamp("as_of") == t).drop("as_of")
        assert sorted(mine.columns) == sorted(want.columns)
        plain = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
        assert plain(mine) == plain(want) != []


def test_late_rows_and_restart(spark, tmp_path):
    """A row that the watermark of the batch before has passed counts nowhere; a stream started anew goes on with the windows it held."""
    at = lambda s: START + dt.timedelta(seconds=s)
    seen = lambda ip, s: (s, ip, "/x", "A", at(s))
    stream = stream_of(spark, tmp_path, [[seen("a", 10), seen("b", 20)], [seen("c", 50), seen("c", 51)], [seen("a", 600)], [seen("a", 601)], [seen("late", 30), seen("a", 1300)]])
    run(stream, "coordinated", tmp_path, window_s=120, slide_s=60)
    spark.createDataFrame([seen("d", 1310), seen("e", 1311), seen("f", 9000)], KIND).coalesce(1).write.parquet(f"{tmp_path}/in/part=99")
    got = run(stream, "coordinated", tmp_path, window_s=120, slide_s=60).orderBy("as_of").collect()
    short = [((r.as_of.astimezone(dt.timezone.utc) - START).total_seconds() if r.as_of.tzinfo else (r.as_of - START.replace(tzinfo=None)).total_seconds(), r.attacker_ips, r.attempts) for r in got]
    assert short == [(60, "a,b,c", 4), (120, "a,b,c", 4), (1320, "a,d,e", 3), (1380, "a,d,e", 3)]


def test_bounds_and_empty_stream(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[]])
    with pytest.raises(ValueError):
        correlation.members(stream, "url", "ip_address", 900, 7)
    with pytest.raises(ValueError):
        correlation.to_reports(stream, "other", str(tmp_path), str(tmp_path))


def test_addresses_as_rows(spark):
    rows = [r for r in made() if r[4]]
    logs = spark.createDataFrame(rows, KIND)
    as_of = "2024-03-10 08:00:00"
    got = correlate.coordinated_addresses(logs, as_of, 7200, 3, 5).collect()
    report = {r.url: r for r in correlate.coordinated_attacks(logs, as_of, 7200, 3, 5).collect()}
    assert {r.url for r in got} == set(report) and len(report) == 4  # rows without a url take the fifth place and are not reported
    for url, r in report.items():
        own = [g for g in got if g.url == url]
        assert ",".join(sorted(g.ip_address for g in own if g.ip_address)) == r.attacker_ips
        assert sum(g.attempts for g in own) == r.attempts
