"""Rules held against the log, the log's values in the health check, rules made of marked rows."""

from __future__ import annotations

import datetime as dt

from reqwatch.functions import patterns
from reqwatch.operators import enrich, health, reports
from reqwatch.sources import schema

NOON = dt.datetime(2024, 1, 1, 12)


def _logs(spark, rows):
    return schema.completed(spark.createDataFrame(rows, "id long, ip_address string, type string, threat_level string, confidence_score int, created_at timestamp"), schema.THREAT_LOGS)


def test_catalogue_counts_rows_of_each_label(spark):
    rows = [(1, "a", "[middleware] XSS Script Tag", "high", 50, NOON), (2, "a", "[custom]  XSS Script Tag", "low", 50, NOON), (3, "a", None, "low", 1, NOON), (4, "a", "XSS Script Tag", None, 1, NOON), (5, "a", "[x] no such rule", "low", 1, NOON)]
    rules = patterns.catalogue(spark)
    got = {r.ord: r for r in reports.catalogue_use(rules, _logs(spark, rows)).collect()}
    assert len(got) == rules.count()
    for r in got.values():
        assert (r.n_rows, r.n_other_level) == ((3, 2) if r.label == "XSS Script Tag" else (0, 0))
    assert {r.n_rows for r in reports.catalogue_use(rules, _logs(spark, [])).collect()} == {0}


def _said(spark, rows):
    return [(r.status, r.title) for r in health.health(spark, _logs(spark, rows), schema.empty(spark, schema.EXCLUSION_RULES), values=True).collect() if "log rows" in r.title]


def test_health_reads_the_log(spark):
    sound = [(1, "a", "t", "high", 0, NOON), (2, "a", "t", "low", 100, NOON)]
    odd = [(3, None, "t", "high", 1, NOON), (4, "a", None, "high", 1, NOON), (5, "a", "t", "grave", 1, NOON), (6, "a", "t", None, 1, NOON), (7, "a", "t", "low", 101, NOON), (8, "a", "t", "low", None, NOON), (9, "a", "t", "low", 1, None)]
    assert _said(spark, sound) == [("ok", "values of 2 log rows are sound")]
    assert _said(spark, sound + odd) == [("warning", "7 of 9 log rows hold odd values")]
    assert _said(spark, []) == [("ok", "values of 0 log rows are sound")]
    lacking = health.health(spark, _logs(spark, sound).drop("type"), schema.empty(spark, schema.EXCLUSION_RULES), values=True)
    assert health.failed(lacking)


def test_a_log_is_completed_to_its_schema(spark):
    df = spark.createDataFrame([(7, "x", 1)], "id int, url string, own int")
    row = schema.completed(df, schema.THREAT_LOGS)
    assert not schema.missing(row, schema.THREAT_LOGS) and "own" not in row.columns
    assert (row.first().id, row.first().url, row.first().threat_level, row.first().city) == (7, "x", "medium", None)


def test_rules_of_marked_rows_are_listed_newest_first(spark):
    logs = spark.createDataFrame([(1, "[m] A", "https://h/p/q"), (2, "[m] B", None), (3, "[m] C", "https://h/")], "id long, type string, url string")
    made = enrich.rules_from_marks(logs, logs.where("id <> 1").unionByName(logs.where("id = 2")))
    rows = enrich.listed_rules(made.withColumn("id", made.created_from_threat_id), active_only=True).collect()
    assert [(r.id, r.pattern_label, r.path_pattern) for r in rows] == [(3, "C", None), (2, "B", None)]
