import hashlib
import re

import pytest

from reqwatch.config import EngineConfig
from reqwatch.functions import checksums, fixed, patterns
from reqwatch.plans.registry import QUERIES

TEXTS = [
    "plain words", None, "", "aadhaar 2341 2341 2346 and 2341 2341 2341", "account no 123456789012 a/c 987654321098", "GET /admin/login url=http://localhost:80/x", "a; cat /etc/passwd && whoami | id",
    "ABCDE1234F 9876543210 HDFC0001234", "password=hunter2secret api_key=abcdef0123456789abcdef access_token=abcdef0123456789", "Authorization: Bearer abcdef0123456789.abcdef", "PHPSESSID=abcdef0123456789abcdef01 session_id=abcdef0123456789abcd",
    "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N csrf_token=abcdef0123456789 _token=abcdef", "http://127.0.0.1/admin <script>alert(1)</script>", "../../etc/passwd UNION SELECT 1", "499118665246 4991 1866 5246",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("rules"))
    rows = list(enumerate(TEXTS))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{d}/pages.parquet")
    return d


def compiled(rule):
    return re.compile((f"(?{rule.flags})" if rule.flags else "") + rule.expression, re.ASCII)


def verhoeff(number):
    c = 0
    for i, x in enumerate(reversed(re.sub(r"\D", "", number))):
        c = checksums._TIMES[c][checksums._TURN[i % 8][int(x)]]
    return c == 0


@pytest.mark.parametrize("name", ["flat_scan_documents_all", "flat_scan_pages_all"])
def test_all_rules(spark, folder, name):
    config, want = EngineConfig(), {}
    rules = [("middleware", r) for r in patterns.default_rules()] + [("custom", r) for r in patterns.custom_rules(config.custom_rules, config.validators)[0]]
    for source, r in rules:
        for k, t in enumerate(TEXTS):
            found = [m.group() for m in compiled(r).finditer(t or "")] if t is not None else []
            if r.validator:
                found = [x for x in found if verhoeff(x)]
            if found:
                want.setdefault((r.label, r.level, source), []).append(k)
    got = {(r.label, r.level, r.source): (r.hits, r["first"], r["last"]) for r in QUERIES[name](spark, folder).collect()}
    assert got == {k: (len(v), v[0], v[-1]) for k, v in want.items()}
    portable = {r.label for r in QUERIES[name.removesuffix("_all")](spark, folder).collect()}
    assert {k[0] for k in got} > portable


def test_all_labels_masked(spark, folder):
    config = EngineConfig()
    rules = [*patterns.default_rules(), *patterns.custom_rules()[0]]
    got = {r.doc_id: r for r in QUERIES["redact_payload_all"](spark, folder).collect()}
    fired = set()
    for k, t in enumerate(TEXTS):
        if t is None:
            assert got[k].masked is None
            continue
        for label in fixed.REDACTED:
            for r in (r for r in rules if r.label == label):
                t, n = compiled(r).subn(config.mask, t)
                fired |= {label} if n else set()
        assert got[k].masked == hashlib.md5(t.encode()).hexdigest() and got[k].hit == (config.mask in t)
    assert len(fired) > 8
