import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reqwatch.config import EngineConfig
from reqwatch.functions import checksums, network, normalize, patterns, scoring
from reqwatch.operators import correlate, detect, export, segments, suppress
from reqwatch.sources import schema


def requests(spark, *rows):
    base = {"request_id": 1, "ip_address": "203.0.113.7", "method": "GET", "path": "/shop", "query_string": "", "content_type": "", "content_length": 0, "body": "", "headers": {}, "user_agent": "Mozilla/5.0 Gecko Firefox", "user_id": None, "url": "https://example.com/shop", "ts": None}
    rows = [base | {"request_id": k + 1} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([[r[f.name] for f in schema.REQUESTS] for r in rows], schema.REQUESTS)


def types(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.request_id, set()).add(r.type)
    return out


def test_whole_requests(spark):
    df = requests(
        spark,
        {"query_string": "q=UNION/**/SELECT+*+FROM+users"},
        {"path": "/.env"},
        {"path": "/wp-admin", "query_string": "q=UNION SELECT 1"},
        {"query_string": "q=hello"},
        {"path": "/shop", "content_type": "application/json", "body": '{"pan":"ABCDE1234F","name":"Jane Doe"}', "content_length": 40},
        {"path": "/api/x", "query_string": "u=http://169.254.169.254/latest"},
        {"content_type": "text/plain", "body": "x" * 70000 + "%00", "content_length": 70003},
        {"query_string": "file=image.php%00.jpg"},
        {"user_agent": "sqlmap/1.7"},
    )
    rows = detect.log_rows(df).cache()
    got = types(rows)
    assert {"[middleware] SQL Comment Evasion", "[middleware] SQL Injection UNION"} <= got[1]
    assert got[2] == {"[probe] Environment File"}
    assert {"[probe] WordPress Admin", "[middleware] SQL Injection UNION"} <= got[3]
    assert 4 not in got and 6 not in got and 7 not in got
    assert "[custom] PAN Number Detected" in got[5]
    assert "[middleware] Null Byte Injection" in got[8]
    assert got[9] == {"[user-agent] SQLMap Scanner"}
    payload = rows.where("request_id = 5").first().payload
    assert "[REDACTED]" in payload and "Jane Doe" in payload and "ABCDE1234F" not in payload
    assert {r.confidence_label for r in rows.where("request_id = 9").collect()} == {"high"}  # 20 + 15 + 25


def test_admission_and_settings(spark):
    df = requests(spark, {"path": "/assets/a.js", "query_string": "q=UNION SELECT 1"}, {"path": "/login", "query_string": "password=abcdefghij"})
    assert types(detect.log_rows(df)) == {}
    assert detect.log_rows(df, EngineConfig(enabled=False)).count() == 0
    assert 1 in types(detect.log_rows(df, EngineConfig(skip_paths=())))
    with pytest.raises(ValueError):
        EngineConfig(mode="odd")


def test_scores(spark):
    cases = [(0, 0, 0, 0, 0, 0, "low"), (1, 1, 0, 0, 0, 35, "medium"), (3, 1, 0, 0, 0, 65, "high"), (5, 1, 0, 0, 0, 80, "very_high"), (1, 0, 1, 0, 0, 30, "medium"), (1, 0, 0, 1, 0, 45, "medium"), (1, 0, 0, 0, 10, 30, "medium"), (1, 0, 0, 0, -10, 10, "low")]
    for n, high, heavy, tool, bonus, want, label in cases:
        value = scoring.score(F.lit(n), F.lit(bool(high)), F.lit(bool(heavy)), F.lit(bool(tool)), bonus)
        r = spark.range(1).select(value.alias("s"), scoring.score_label(value).alias("l")).first()
        assert (r.s, r.l) == (want, label)


def test_checksums(spark):
    good = {"verhoeff": ["2363", "234123412346", "2341 2341 2346", "234567890124"], "luhn": ["4111111111111111", "4111-1111-1111-1111"]}
    bad = {"verhoeff": ["2364", "234123412347", "134123412346", "none"], "luhn": ["4111111111111112", "79927398713"]}
    for name, f in checksums.VALIDATORS.items():
        df = spark.createDataFrame([(v, True) for v in good[name]] + [(v, False) for v in bad[name]], "v string, want boolean")
        assert df.where(f(F.col("v")) != F.col("want")).count() == 0
    assert spark.range(1).select(checksums.passes("unknown", F.lit("x"), "x").alias("p")).first().p


def test_address_lists(spark):
    df = spark.createDataFrame([("203.0.113.7",), ("203.0.113.200",), ("2001:db8::1",), ("",), (None,), ("odd",)], "ip string")
    nets = ["203.0.113.0/24", "2001:db8::/32", " 198.51.100.1 ", None, 42, "", "   "]
    got = [r.h for r in df.select(network.in_networks(F.col("ip"), nets).alias("h")).collect()]
    assert got == [True, True, True, False, False, False]
    assert [r.h for r in df.select(network.in_v4(F.col("ip"), nets).alias("h")).collect()] == [True, True, False, False, False, False]
    assert not spark.range(1).select(network.blocked(F.lit("203.0.113.7"), nets, ["203.0.113.7"]).alias("b")).first().b


def test_looked_up(spark):
    want = {"8.8.8.8": True, "203.0.113.7": True, "10.1.2.3": False, "172.20.0.1": False, "192.168.1.1": False, "127.0.0.1": False, "169.254.169.254": False, "0.1.2.3": False, "250.1.1.1": False, "2606:4700::1": True, "fd00::1": False, "::1": False, "fe80::1": False, "odd": False, "": False, None: False}
    df = spark.createDataFrame([(v,) for v in want], "ip string").select("ip", network.looked_up(F.col("ip")).alias("h"))
    assert {r.ip: bool(r.h) for r in df.collect()} == want


def test_flood_count(spark):
    times = [0, 10, 59, 60, 61, 200]
    df = spark.createDataFrame([("a", t) for t in times] + [("b", 5)], "ip_address string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    shown = lambda at: {r.ip_address: r.requests for r in suppress.flood_count(df, at).collect()}
    assert shown(9) == {"a": 1, "b": 1} and shown(59) == {"a": 3, "b": 1} and shown(61) == {"a": 2, "b": 1}
    assert shown(65) == {"a": 2} and shown(130) == {} and shown(200) == {"a": 1}


def test_correlation_kinds(spark):
    rows = spark.createDataFrame([(k, f"10.0.0.{k % 4}", "https://e.com/x", "[m] T") for k in range(12)], "id long, ip_address string, url string, type string").withColumn("created_at", F.to_timestamp(F.lit("2024-01-30 23:59:30")))
    got = correlate.correlation(rows, "2024-01-31 00:00:00")
    assert list(got) == ["coordinated_attacks", "attack_campaigns", "rapid_attackers"] and got["coordinated_attacks"].first().unique_ips == 4
    assert list(correlate.correlation(rows, "2024-01-31 00:00:00", "rapid")) == ["rapid_attackers"]
    with pytest.raises(ValueError):
        correlate.correlation(rows, "2024-01-31 00:00:00", "odd")


def test_normalisation():
    n = normalize.normalize_bytes
    assert n(b"UNION/* x */SELECT") == b"UNION SELECT"
    assert n(b"%2527%20a+b") == b"' a b" and n(b"%zz") == b"%zz"
    assert n(b"&lt;script&gt; \\u003cb \\x41 &#60; &lt") == b"<script> <b A < &lt"
    assert len(n(b"a" * 9000)) == 8000 and n(b"") == b""


def test_trees():
    assert json.loads(segments.tree_text("a[b]=1&a[c][]=2&a[c][]=3&x.y=4&x.y=5", "form")) == {"a": {"b": "1", "c": ["2", "3"]}, "x_y": "5"}
    assert segments.tree_text('{"filters":{"x":{"value":1,"k":2}}}', "json", (), ("filters.*.value",)) == '{"filters":{"x":{"k":2}}}'
    assert segments.tree_text('{"a":1,"b":2}', "json", ("a",)) == '{"b":2}'
    assert segments.tree_text("", "form") == segments.tree_text("{odd", "json") == segments.tree_text(None, "json") == ""
    assert segments.tree_text('{"n":"é"}', "json") == '{"n":"\\u00e9"}'


def test_patterns(spark):
    assert len(patterns.default_rules()) == 73 and len(patterns.evasion_rules()) == 8
    rules, said = patterns.custom_rules([{"label": "A", "pattern": "a", "contexts": ["path", "odd"], "level": "odd"}, {"pattern": "x"}, {"label": "B", "pattern": "("}])
    assert [r.label for r in rules] == ["A"] and rules[0].contexts == ("path",) and len(said) == 4
    got = lambda v, g: spark.range(1).select(F.lit(v).rlike(patterns.glob_to_regex(g)).alias("m")).first().m
    assert got("a/b/c", "a/*") and got("abc", "a?c") and got("a1", "a[0-9]") and not got("ax", "a[!x]") and not got("a\n", "a") and got("a*", r"a\*")
    hit = lambda t, e, f="": spark.range(1).select(F.lit(t).rlike(patterns.to_java(e, f)).alias("m")).first().m
    assert hit("éselect", r"\bselect\b") and hit("a\rb", "a.b") and not hit("xselect", r"\bselect")
    for t in ("|", "||((=", "x(a=", ")y(=", "(((", "=(|", ""):
        e = r"[)(|*\\].*\(.*="
        assert hit(t, e, "s") == spark.range(1).select(F.lit(t).rlike(patterns.to_java_existence(e, "s")).alias("m")).first().m


def test_user_agents_and_probes(spark):
    agents = {"Mozilla/5.0 HeadlessChrome/120.0": ["Headless Chrome"], "Mozilla/5.0 Gecko HeadlessChrome/1": ["Headlesschrome detected"], "Mozilla/5.0 gecko GPTBot": ["GPTBot AI Scraper"], "": ["Empty User Agent"], None: ["Empty User Agent"], "Mozilla/5.0 Gecko Firefox": []}
    df = spark.createDataFrame([(a,) for a in agents], "a string").select("a", F.transform(detect.user_agent_matches(F.col("a")), lambda m: m["label"]).alias("l"))
    assert {r.a: r.l for r in df.collect()} == agents
    paths = {"/.ENV": "Environment File", "wp-content/x": "WordPress Content", "/a/b.aspx": "ASPX Probe", "/fine": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", detect.probe_label(F.col("p")).alias("l"))
    assert {r.p: r.l for r in df.collect()} == paths


def test_windows(spark):
    times = [0, 100, 299, 300, 599, 600]
    df = spark.createDataFrame([(k, "10.0.0.1", "[x] T", t) for k, t in enumerate(times)], "id long, ip_address string, type string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    kept = suppress.first_in_window(df, ["ip_address", "type"])
    assert sorted(r.t for r in kept.collect()) == [0, 300, 600]
    assert [tuple(r) for r in suppress.floods(df, 2, 300).orderBy("sec").collect()] == [("10.0.0.1", 299, 3, 1)]
    assert suppress.flood_rows(df, 2, 300).count() == 1


def test_windows_of_batches():
    """Against a walk through the seconds, however they are cut into batches; one key holds most of them."""
    r, window = random.Random(8), 60
    seconds = {("a" if k < 300 else r.choice("bcdefgh"), r.randrange(20_000 if k < 300 else 900)) for k in range(500)}
    pdf = pd.DataFrame(sorted((k, t, r.randint(1, 5)) for k, t in seconds), columns=["key", "sec", "n"])
    opened, before, state = [], [], {}
    for k, t, n in pdf.itertuples(index=False):
        start, count = state.get(k, (t - window, 0))
        opened.append(t >= start + window)
        start, count = (t, 0) if opened[-1] else (start, count)
        before.append(count)
        state[k] = start, count + n
    for size in (1, 2, 7, 100, len(pdf)):
        cuts = (pdf[k : k + size] for k in range(0, len(pdf), size))
        got = pd.concat(suppress.windowed(cuts, ["key"], window))
        assert got["opened"].tolist() == opened and got["before"].tolist() == before
    assert not list(suppress.windowed(iter([pdf[:0]]), ["key"], window))


def test_windows_without_time_or_key(spark):
    rows = [(1, "a", None), (2, "a", 100), (3, "a", 130), (4, None, 100), (5, "a", 400), (6, "a", None), (7, "b", None)]
    df = spark.createDataFrame(rows, "id long, ip_address string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    assert sorted(x.id for x in suppress.first_in_window(df, ["ip_address"]).collect()) == [2, 5]
    none = df.limit(0)
    assert suppress.first_in_window(none, ["ip_address"]).count() == suppress.floods(none).count() == 0


def test_exclusions(spark):
    rows = spark.createDataFrame([(1, "[query] XSS Script Tag", "https://e.com/blog/post-1"), (2, "[query] XSS Script Tag", "https://e.com/admin/users"), (3, "[q] SQL Injection UNION", "https://e.com/a"), (4, "[q] Other", None)], "id long, type string, url string")
    rules = spark.createDataFrame([("XSS Script Tag", "blog/*", True), ("SQL", None, True), ("Other", "", False)], "pattern_label string, path_pattern string, is_active boolean")
    assert sorted(r.id for r in suppress.excluded(rows, rules).collect()) == [2, 3, 4]


def test_exports(spark):
    df = spark.createDataFrame([("=1+1",), ("@x",), ("ok",), (None,)], "c string").select(export.formula_safe(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == ["'=1+1", "'@x", "ok", None]
    assert spark.range(1).select(export.defanged(F.lit("HTTPS://a.b/c.d")).alias("u")).first().u == "hxxp://a[.]b/c[.]d"
    with pytest.raises(ValueError):
        export.blocklist_lines(df, "odd")
