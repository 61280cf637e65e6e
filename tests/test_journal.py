"""From requests to the log: windows of each address and type, floods, multipart bodies, redaction and the sink's tries."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_detection import requests, types
from test_queries import landed

from reqwatch.config import EngineConfig
from reqwatch.operators import detect, journal, redact, segments, suppress
from reqwatch.streaming import state

ROW = "request_id string, ip_address string, type string, t double"


def at(seconds):
    return dt.datetime(2024, 3, 10, 6, 59, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds)


@pytest.fixture(params=["UTC", "America/New_York"])
def zone(spark, request):
    """The day of the tests is one on which New York's clocks jump."""
    spark.conf.set("spark.sql.session.timeZone", request.param)
    yield request.param
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def kept(rows):
    return sorted((r.request_id, r.type) for r in rows.collect())


def test_rows_without_an_id_of_their_own(spark, zone):
    """A request stands for several types; each type is in a window of its own."""
    rows = [("r1", "a", "A", 0), ("r2", "a", "A", 10), ("r2", "a", "B", 10), ("r3", "a", "B", 11.5), ("r4", "a", "A", 300), ("r4", "a", "B", 300), ("r5", "a", "B", 310), ("r6", "b", "A", 300), (None, "b", "A", 300), ("r7", None, "A", 1), ("r8", "a", "A", None)]
    df = spark.createDataFrame([(*r[:3], None if r[3] is None else float(r[3])) for r in rows], ROW).withColumn("created_at", F.timestamp_seconds(F.col("t") + 1710054000))
    got = suppress.first_in_window(df, ["ip_address", "type"])
    assert got.columns == df.columns
    assert kept(got.where("request_id is not null")) == [("r1", "A"), ("r2", "B"), ("r4", "A"), ("r5", "B")]
    assert got.where("ip_address = 'b'").count() == 1  # of equal seconds one row, an unknown request first
    twice = df.union(df)
    assert kept(suppress.first_in_window(twice, ["ip_address", "type"]).where("ip_address = 'a'")) == [("r1", "A"), ("r2", "B"), ("r4", "A"), ("r5", "B")]


def log_stream(spark, folder, batches):
    kind = "request_id string, ip_address string, type string, created_at timestamp, note string"
    for k, rows in enumerate(batches):
        spark.createDataFrame([(*r, f"n{r[0]}") for r in rows], kind).coalesce(1).write.parquet(f"{folder}/in/part={k}")
    return spark.readStream.schema(kind + ", part int").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in").drop("part")


def test_stream_of_log_rows_in_any_zone(spark, tmp_path, zone):
    batches = [
        [("r1", "a", "A", at(0)), ("r1", "a", "B", at(0))], [("r2", "a", "A", at(60)), ("r2", "a", "C", at(60)), ("r0", None, "A", at(61))], [("r3", "a", "A", at(299)), ("r3", "b", "A", at(299.5)), ("r4", "b", "A", at(299.9))],
        [("r5", "a", "A", at(300)), ("r5", "a", "B", at(301)), ("r5", "a", "C", at(301))], [("r6", "a", "C", at(361)), ("r6", "a", "A", at(7000))], [("r7", "a", "A", at(7100)), ("r7", "a", "B", at(7300))],
    ]
    want = [("r1", "A"), ("r1", "B"), ("r2", "C"), ("r3", "A"), ("r5", "A"), ("r5", "B"), ("r6", "A"), ("r6", "C"), ("r7", "B")]
    out = landed(state.deduplicated(log_stream(spark, tmp_path, batches), 300, "1 minute", ("request_id",)), tmp_path, "kept")
    assert kept(out) == want
    assert {r.request_id: (r.created_at.astimezone(dt.timezone.utc), r.note) for r in out.where("type = 'C'").collect()} == {"r2": (at(60), "nr2"), "r6": (at(361), "nr6")}
    flat = spark.createDataFrame([r for b in batches for r in b], "request_id string, ip_address string, type string, created_at timestamp")
    assert kept(suppress.first_in_window(flat, ["ip_address", "type"])) == want
    floods = state.flood_alerts(log_stream(spark, f"{tmp_path}/again", batches), 4, 300, "1 minute")
    assert [(r.ip_address, r.started.astimezone(dt.timezone.utc), r.requests) for r in landed(floods, tmp_path, "floods").collect()] == [("a", at(0), 5)]


def test_batch_that_fails_mutes_nothing(spark, tmp_path):
    """A stream whose sink fails is started again: the rows of the failed batch are still first in their windows."""
    rows = state.deduplicated(log_stream(spark, tmp_path, [[("r1", "a", "A", at(0))], [("r2", "a", "B", at(5)), ("r3", "a", "A", at(6))]]), 300, "1 minute", ("request_id",))
    broken = [True]

    def write(batch, path, number):
        if number == 1 and broken:
            broken.clear()
            raise OSError("disk full")
        state.append(batch, path, number)

    for _ in range(2):
        try:
            state.to_log(rows, f"{tmp_path}/log", f"{tmp_path}/state", write=write, waits=()).trigger(availableNow=True).start().awaitTermination()
        except Exception as error:
            assert "disk full" in str(error)
    assert kept(spark.read.parquet(f"{tmp_path}/log")) == [("r1", "A"), ("r2", "B")]


def test_tries_of_the_sink(spark, tmp_path):
    said, heard, waited = [], [], []

    def write(batch, path, number):
        said.append(number)
        if number == 0 and said.count(0) < 3 or number == 1:
            raise OSError("busy")
        state.append(batch, path, number)

    stream = log_stream(spark, tmp_path, [[("r1", "a", "A", at(0))], [("r2", "a", "A", at(5))], [("r3", "a", "A", at(6))]])
    out = state.to_log(stream, f"{tmp_path}/log", f"{tmp_path}/state", lambda batch, number: heard.append(number), write, (10, 30), f"{tmp_path}/failed", waited.append)
    out.trigger(availableNow=True).start().awaitTermination()
    assert said == [0, 0, 0, 1, 1, 1, 2] and waited == [10, 30, 10, 30] and heard == [0, 2]
    assert kept(spark.read.parquet(f"{tmp_path}/log")) == [("r1", "A"), ("r3", "A")]
    lost = spark.read.parquet(f"{tmp_path}/failed").collect()
    assert [(r.request_id, r.error) for r in lost] == [("r2", "busy")]


def test_flood_of_the_very_request(spark, zone):
    times = [0, 1, 1, 1, 2, 3, 70, 71, 72, 73, 130, 400, 401, 402, 402]
    rows = spark.createDataFrame([(k, "a", f"https://e.com/{k}", f"agent {k}", 7, float(t) + k / 1000) for k, t in enumerate(times)] + [(99, "b", "u", "v", 8, 5.0)], "id long, ip_address string, url string, user_agent string, user_id long, t double")
    rows = rows.withColumn("created_at", F.timestamp_seconds(F.col("t") + 1710054000)).drop("t")
    got = suppress.flood_rows(rows, 3, 60, 300, ("id",)).collect()
    assert sorted((r.url, r.user_agent, r.user_id, r.payload) for r in got) == [("https://e.com/14", "agent 14", 7, "Request frequency exceeded threshold"), ("https://e.com/3", "agent 3", 7, "Request frequency exceeded threshold")]
    events = suppress.flood_events(rows, 3, 60, 300, ("id",)).collect()
    assert sorted((r.ip_address, r.requests, r.threshold, r.window_s) for r in events) == [("a", 4, 3, 60)] * 2
    # from the second that the threshold was passed in on, the next row may come in the midst of a window
    again = suppress.flood_events(rows, 3, 60, 2, ("id",)).orderBy("created_at").collect()
    assert [r.requests for r in again] == [4, 6, 4, 4]
    assert suppress.flood_rows(rows.limit(0)).count() == 0
    assert suppress.flood_rows(rows.drop("url", "user_id"), 3, 60).where("url is null and user_id is null").count() == 2


MULTIPART = "\r\n".join([
    "preamble", "--XyZ", 'Content-Disposition: form-data; name="title"', "", "summer reading", "--XyZ", 'content-disposition: form-data; name="tags[a][]"', "Content-Type: text/plain", "", "one", "--XyZ", 'Content-Disposition: form-data; name="tags[a][]"', "", "two\r\nlines",
    "--XyZ", 'Content-Disposition: form-data; name="cover"; filename="a.php"', "Content-Type: application/x-php", "", "<?php system($_GET['c']); ?> UNION SELECT a FROM b", "--XyZ", 'Content-Disposition: form-data; name="cover_note"', "", "%41 stays",
    "--XyZ", 'Content-Disposition: form-data; name="doc[file]"; filename="x"', "", "x", "--XyZ", 'Content-Disposition: form-data; name="doc[about]"', "", "gone with the file", "--XyZ", "Content-Disposition: form-data", "", "nameless", "--XyZ--", "epilogue",
])


def test_multipart_fields():
    fields = {"title": "summer reading", "tags": {"a": {"0": "one", "1": "two\r\nlines"}}, "cover_note": "%41 stays"}
    assert segments.parse_multipart(MULTIPART, 'multipart/form-data; boundary="XyZ"') == segments.parse_multipart(MULTIPART, "multipart/form-data; charset=utf-8; Boundary=XyZ") == fields
    assert segments.parse_multipart(MULTIPART.replace("\r\n", "\n"), "multipart/form-data; boundary=XyZ")["title"] == "summer reading"
    assert segments.parse_multipart(MULTIPART, "multipart/form-data") == segments.parse_multipart(MULTIPART, "multipart/form-data; boundary=Other") == segments.parse_multipart("", "multipart/form-data; boundary=XyZ") == {}
    cut = MULTIPART[: MULTIPART.index("two")]
    assert segments.parse_multipart(cut, "multipart/form-data; boundary=XyZ") == {"title": "summer reading", "tags": {"a": {"0": "one"}}}
    assert segments.parse_multipart('--B\r\nContent-Disposition: form-data; name="a\\"b"\r\n\r\n1\r\n--B--', "multipart/form-data; boundary=B") == {'a"b': "1"}


def test_multipart_bodies_are_scanned_without_their_files(spark):
    kind = {"method": "POST", "content_type": "multipart/form-data; boundary=XyZ", "content_length": 900}
    attack = MULTIPART.replace("summer reading", "<script>alert(2)</script>")
    got = types(detect.log_rows(requests(spark, kind | {"body": MULTIPART}, kind | {"body": attack})))
    assert 1 not in got and "[middleware] XSS Script Tag" in got[2]
    texts = requests(spark, kind | {"body": MULTIPART})
    body = segments.with_segments(texts, safe_fields=("title",)).select("segments.body", "segments.raw").first()
    assert json.loads(body.body) == {"tags": {"a": ["one", "two\r\nlines"]}, "cover_note": "%41 stays"} and body.raw == ""


def test_redaction_in_firing_order(spark):
    """Where two masks overlap, the label that fired first masks first."""
    rules = ({"label": "Long Number", "pattern": "[0-9]{4}-[0-9]{4}"}, {"label": "Short Number", "pattern": "[0-9]{4}"})
    config = EngineConfig(custom_rules=rules, redact_labels=("Long Number", "Short Number"), mask="#")
    df = spark.createDataFrame([(["Short Number", "Long Number"],), (["Long Number", "Short Number"],), (["Other", "Short Number"],), ([],)], "labels array<string>").withColumn("text", F.lit("a 1234-5678 b 9999 $1"))
    assert [r.m for r in df.select(redact.masked(F.col("text"), F.col("labels"), config).alias("m")).collect()] == ["a #-# b # $1", "a # b # $1", "a #-# b # $1", "a 1234-5678 b 9999 $1"]


def test_many_exclusion_rules(spark):
    """Rules meet rows by label and the beginning of their pattern: no pair of all rows and rules is tried."""
    rules = spark.range(100_000).select(F.concat(F.lit("L"), (F.col("id") % 3).cast("string")).alias("pattern_label"), F.format_string("area/%05d/*", "id").alias("path_pattern"), (F.col("id") % 2 == 0).alias("is_active"))
    extra = spark.createDataFrame([("Any", None, True), ("Any", "", None), ("L0", "*.css", True), ("L1", "a?ea/7*", True), ("L2", "very/long/beginning/of/a/path/[ab]", True)], "pattern_label string, path_pattern string, is_active boolean")
    paths = ["/area/00006/x", "/area/00007/x", "/area/00006", "/x.css", "/area/7", "/very/long/beginning/of/a/path/b", "/very/long/beginning/of/a/path/c", "/"]
    rows = spark.createDataFrame([(f"[m] {label}", f"https://e.com{p}") for label in ("L0", "L1", "L2", "Any", "None") for p in paths], "type string, url string")
    out = suppress.excluded(rows, rules.union(extra)).cache()
    gone = sorted(map(tuple, rows.exceptAll(out).collect()))
    want = [("[m] Any", f"https://e.com{p}") for p in paths] + [("[m] L0", "https://e.com/area/00006/x"), ("[m] L0", "https://e.com/x.css"), ("[m] L1", "https://e.com/area/7"), ("[m] L2", "https://e.com/very/long/beginning/of/a/path/b")]
    assert gone == sorted(want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_requests_to_log_as_job_and_stream(spark, tmp_path):
    base = {"user_agent": "Nikto/2.5 masscan", "query_string": "q=<script>alert(3)</script>"}
    rows = [base, base | {"query_string": ""}, {"query_string": "q=<script>x</script>", "ip_address": "198.51.100.9"}, {"path": "/.env"}, base, {"query_string": "q=plain words"}]
    whole = requests(spark, *rows).withColumn("ts", F.timestamp_seconds(F.lit(1710054000) + F.array(*[F.lit(x) for x in (0, 20, 30, 30, 310, 311)])[(F.col("request_id") - 1).cast("int")]))
    rules = spark.createDataFrame([("Masscan Scanner", None, True)], "pattern_label string, path_pattern string, is_active boolean")
    config = EngineConfig(flood_threshold=2, flood_window_s=60)
    got = journal.request_log(whole, config, rules)
    own = sorted((r.request_id, r.type) for r in got.where("request_id is not null").collect())
    assert {k for k, _ in own} == {1, 3, 4, 5} and {t for k, t in own if k == 1} == {t for k, t in own if k == 5} > {"[middleware] XSS Script Tag"}
    floods = got.where("request_id is null").collect()
    assert [(r.type, r.ip_address) for r in floods] == [("[ddos] Excessive Requests", "203.0.113.7")]
    for k in range(1, 7):
        whole.where(F.col("request_id") == k).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    stream = spark.readStream.schema(T.StructType([*whole.schema, T.StructField("part", T.IntegerType())])).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("part")
    out = landed(journal.request_log_stream(stream, config, rules, "1 minute"), tmp_path, "log")
    assert sorted((r.request_id, r.type) for r in out.collect()) == own
    events = journal.threat_events(out).collect()
    assert len(events) == len(own) and all(e.row.type == e.type and e.row.threat_level == e.level for e in events)
