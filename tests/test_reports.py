import datetime as dt

import pytest
from pyspark.sql import functions as F

from reqwatch.config import EngineConfig
from reqwatch.functions import fixed
from reqwatch.operators import correlate, enrich, health, reports
from reqwatch.sources import schema

NOW = "2024-03-01 12:00:00"


@pytest.fixture(scope="module")
def logs(spark):
    now = dt.datetime(2024, 3, 1, 12)
    seed = [("10.0.0.1", "high", "[middleware] SQL Injection UNION", k, 0) for k in range(5)] + [("10.0.0.2", "medium", "[middleware] Directory Traversal", k, 0) for k in range(2)]
    seed += [("10.0.0.3", "low", "[user-agent] Python Script", 0, 0)] + [("10.0.0.4", "high", "[middleware] RCE Shell Function", 0, 48) for _ in range(3)]
    rows = [(k, ip, f"https://e.com/{k % 2}", t, level, now - dt.timedelta(minutes=m, hours=h)) for k, (ip, level, t, m, h) in enumerate(seed)]
    return spark.createDataFrame(rows, "id long, ip_address string, url string, type string, threat_level string, created_at timestamp")


def addresses(df):
    return [r.ip_address for r in df.collect()]


def test_blocklist(logs):
    assert addresses(reports.blocklist(logs, NOW)) == ["10.0.0.1", "10.0.0.2", "10.0.0.3"]
    assert addresses(reports.blocklist(logs, NOW, level="high")) == ["10.0.0.1"]
    assert addresses(reports.blocklist(logs, NOW, min_hits=3)) == ["10.0.0.1"]
    assert sorted(addresses(reports.fail2ban(logs, NOW, "7d"))) == [f"10.0.0.{k}" for k in (1, 2, 3, 4)]
    assert reports.blocklist(logs.limit(0), NOW).count() == 0
    assert [reports.parse_since(x) for x in ("3h", "2d", "1w", "odd", "")] == [10800, 172800, 604800, 86400, 86400]


def test_correlation(logs):
    assert [r.type for r in correlate.campaigns(logs, NOW, least=1).collect()][0] == "[middleware] SQL Injection UNION"
    assert correlate.coordinated_attacks(logs, NOW).first().attacker_ips == "10.0.0.1,10.0.0.2,10.0.0.3"
    assert addresses(correlate.rapid_attackers(logs, NOW, least=5)) == ["10.0.0.1"]
    assert tuple(correlate.correlation_summary(logs, NOW).first()) == (1, 0, 0)


def test_bounds(logs):
    for call in (lambda: reports.page(logs, 1, 101), lambda: reports.top_ips(logs, 0), lambda: reports.timeline(logs, NOW, 366), lambda: reports.threats(logs, level="odd")):
        with pytest.raises(ValueError):
            call()


def test_enrichment(spark, logs):
    geo = spark.createDataFrame([("10.0.0.1", "FR", "France", "Lyon", "Amazon.com", ""), ("10.0.0.2", "IN", "India", "Pune", "Local", "")], "ip_address string, country_code string, country_name string, city string, isp string, org string")
    got = {r.ip_address: (r.cloud_provider, r.is_foreign, r.is_cloud_ip) for r in enrich.enriched(logs, geo).collect()}
    assert got == {"10.0.0.1": ("AWS", True, True), "10.0.0.2": (None, False, False), "10.0.0.3": (None, False, False), "10.0.0.4": (None, False, False)}
    assert sorted(addresses(enrich.candidates(enrich.enriched(logs, geo), NOW))) == ["10.0.0.3", "10.0.0.4"]


def test_retention(spark, logs):
    rules = spark.createDataFrame([(1, 0), (2, 9), (3, None)], "id long, created_from_threat_id long")
    kept = enrich.purged(logs, NOW, 1)
    assert kept.count() == 8 and sorted(r.id for r in enrich.purged_rules(rules, kept).collect()) == [1, 3]
    made = enrich.rules_from_marks(logs, spark.createDataFrame([(0,)], "id long")).first()
    assert (made.pattern_label, made.path_pattern) == ("SQL Injection UNION", "0")


def test_rule_list(spark):
    rules = spark.createDataFrame([(1, True), (2, False), (3, True)], "id long, is_active boolean")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(enrich.listed_rules(rules)) == [3, 2, 1] and ids(enrich.listed_rules(rules, active_only=True)) == [3, 1]
    assert ids(enrich.listed_rules(enrich.without_rule(rules, 3))) == [2, 1] and enrich.without_rule(rules, 9).count() == 3


def test_health(spark):
    good = schema.empty(spark, schema.THREAT_LOGS)
    assert not health.failed(health.health(spark, good, schema.empty(spark, schema.EXCLUSION_RULES)))
    assert health.failed(health.health(spark, good.drop("confidence_score"), None))
    assert health.health(spark, good, settings={"odd": 1}).where(F.col("title").contains("odd is unknown")).count() == 1
    shadowing = lambda *rules: {r.title for r in health.health(spark, good, config=EngineConfig(custom_rules=rules)).where("title like 'custom rule%'").collect()}
    same = next(r for r in fixed.DEFAULT_RULES if r[0] == "XSS Script Tag")
    assert shadowing(same, ("Mine", None, "x+", "")) == set()  # the same expression shadows nothing
    assert shadowing({"label": "XSS Script Tag", "pattern": "<script"}) == {"custom rule shadows XSS Script Tag"}
    assert any("Broken" in t for t in shadowing({"label": "Broken", "pattern": "("}))
    with pytest.raises(ValueError):
        schema.require(good.drop("type"), schema.THREAT_LOGS, "log")


def test_addresses_are_checked(spark):
    logs = spark.createDataFrame([], "id long, ip_address string, created_at timestamp, threat_level string, type string")
    for report in (reports.ip_stats, reports.ip_recent, reports.ip_levels):
        for bad in ("", "10.0.0", "10.0.0.256", "10.0.0.5 ", "x' OR 1=1", "fe80::zz"):
            with pytest.raises(ValueError):
                report(logs, bad)
    assert reports.ip_recent(logs, "2001:db8::1").count() == 0
