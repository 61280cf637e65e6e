"""Whole requests to log rows and alerts, and normalisation, against plain Python that takes one rule after the other."""

import fnmatch
import html.entities
import random
import re

import pytest
from pyspark.sql import functions as F
from test_whole_rules import compiled, verhoeff

from reqwatch.config import EngineConfig
from reqwatch.functions import fixed, normalize, patterns
from reqwatch.operators import detect, export, segments
from reqwatch.plans.registry import QUERIES
from reqwatch.sources import adapters

CONTEXTS = ("path", "query", "body", "headers")


def without_comments(data):
    out = b""
    while (a := data.find(b"/*")) >= 0 and (b := data.find(b"*/", a + 2)) >= 0:
        out, data = out + data[:a] + b" ", data[b + 2 :]
    return out + data


def without_entities(data):
    out = b""
    while (a := data.find(b"&")) >= 0:
        out, data = out + data[:a], data[a:]
        name = data[1 : data.find(b";")].decode("latin-1") if b";" in data[:34] else ""
        plain = None
        if re.fullmatch("#[0-9]{1,7}", name, re.ASCII):
            plain = chr(int(name[1:]))
        elif re.fullmatch("#[xX][0-9a-fA-F]{1,6}", name):
            plain = chr(int(name[2:], 16))
        elif re.fullmatch("[A-Za-z][A-Za-z0-9]+", name):
            plain = html.entities.html5.get(name + ";")
        out, data = (out + b"&", data[1:]) if plain is None else (out + plain.encode(), data[len(name) + 2 :])
    return out + data


def with_escapes(data, lead, size, below):
    parts = data.split(lead)
    out = parts[0]
    for p in parts[1:]:
        ok = len(p) >= size and all(chr(c) in "0123456789abcdefABCDEF" for c in p[:size]) and int(p[:size], 16) < below
        out += bytes([int(p[:size], 16)]) + p[size:] if ok else lead + p
    return out


def normalized(text):
    data = without_entities(without_comments(text.encode()[:8000]))
    data = with_escapes(with_escapes(data, b"\\u", 4, 128), b"\\x", 2, 256)
    for _ in range(3):
        data = with_escapes(data.replace(b"+", b" "), b"%", 2, 256)
    data = re.sub(rb"[ \t\n\x0b\f\r]+", b" ", data).strip(b" \t\n\r\0\x0b")
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def test_normalisation(spark):
    own = random.Random(5)
    bits = ["%41", "%2541", "%25%34%31", "+", "&lt;", "&#x3c;", "&#60;", "&amp;", "&nosuch;", "&", ";", "\\u003c", "\\u20ac", "\\x3c", "\\xff", "\\", "/*", "*/", "/", "*", " ", "\t", "\n", "é", "€", "a", "<", "%", "%e9", "%zz", "u00", "x4"]
    texts = ["".join(own.choice(bits) for _ in range(own.randrange(30))) for _ in range(3000)] + ["", "a" * 9000, "é" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", normalize.normalize_segment(F.col("t")).alias("n"))
    got = {r.id: r.n for r in df.collect()}
    assert [t for k, t in enumerate(texts) if got[k] != normalized(t)] == []


def test_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.normalized for r in QUERIES["normalize_pages"](spark, sf_dir).collect()}
    assert got == {k: normalized(v) for k, v in pages.items()}


def holds_any(text, words):
    return any(w in text.lower() for w in words)


def cut(text):
    return text if len(text.encode()) <= 8000 else text.encode()[:8000].decode("utf-8", "replace")


def matches(parts, config, auth):
    """(label, level, source, context) of the patterns in the order of firing."""
    out = []
    for context in CONTEXTS:
        raw = cut(parts[context])
        if not raw:
            continue
        norm = normalized(parts[context])
        screened = context == "path" or holds_any(raw, fixed.PRESCREEN)
        gate = lambda r: r.category not in fixed.CATEGORY_KEYWORDS or screened and holds_any(norm, fixed.CATEGORY_KEYWORDS[r.category])  # noqa: B023, E731
        out += [(r.label, r.level, "middleware", context) for r in patterns.evasion_rules() if screened and compiled(r).search(raw)]
        out += [(r.label, r.level, "middleware", context) for r in patterns.default_rules() if gate(r) and compiled(r).search(norm)]
        for r in patterns.custom_rules(config.custom_rules, config.validators)[0]:
            if (r.contexts and context not in r.contexts) or not gate(r) or (auth and r.label in fixed.AUTH_SUPPRESSED):
                continue
            hits = [m.group() for m in compiled(r).finditer(norm)]
            if any(map(verhoeff, hits)) if r.validator else hits:
                out.append((r.label, r.level, "custom", context))
    raw, seen = cut(parts["raw"]), {m[0] for m in out}
    if holds_any(raw, fixed.PRESCREEN):
        out += [(r.label, r.level, "middleware", "raw") for r in patterns.evasion_rules() if r.label not in seen and compiled(r).search(raw)]
    return out


def agents(agent):
    low = (agent if agent is not None else "N/A").lower()
    if "mozilla/" in low and "gecko" in low and not any(s in low for s in fixed.SPOOFED):
        return [(f"{m.capitalize()} detected", "medium", "user-agent", "") for m in fixed.HEADLESS if m in low]
    return [(label, level, "user-agent", "") for s, label, level in fixed.USER_AGENTS if s in low] + [("Empty User Agent", "low", "user-agent", "")] * (low.strip() in ("", "0", "n/a", "-"))


def probe(path):
    low = "/" + path.lstrip("/").lower()
    exact = [label for p, label in fixed.PROBES if "*" not in p and p.lower() == low]
    return (exact or [label for p, label in fixed.PROBES if "*" in p and fnmatch.fnmatchcase(low, p.lower())] or [None])[0]


def mask(text, labels, config):
    rules = [*patterns.default_rules(), *patterns.custom_rules(config.custom_rules, config.validators)[0]]
    for label in labels:
        for r in (r for r in rules if r.label == label and label in config.redact_labels):
            text = compiled(r).sub(config.mask, text)
    return text


def logged(request, parts, config, rules):
    """(type, level, score, payload, url) in order of one request."""
    path = request.path.strip("/") or "/"
    fits = lambda globs: any(fnmatch.fnmatchcase(path, g) for g in globs)
    if fits(config.skip_paths):
        return []
    probed = probe(request.path)
    found = matches({**parts, "path": "" if probed else "/" + request.path.lstrip("/")}, config, fits(config.auth_paths))
    threats = [(probed, config.probe_level, "probe", "path")] * bool(probed) + agents(request.user_agent) + found
    if not threats:
        return []
    score = 20 + 15 * min(len(threats) - 1, 3) + 15 * any(t[1] == "high" for t in threats) + 10 * any(config.context_weights.get(m[3], 1) > 1 for m in found) + 25 * any(t in (request.user_agent or "").lower() for t in fixed.ATTACK_TOOLS)
    score = max(0, min(100, score))
    if score < config.least_score:
        return []
    labels = list(dict.fromkeys(t[0] for t in threats))
    whole = "\n".join(f"{n.upper()}: {parts[n]}" for n in ("query", "body", "headers") if parts[n])
    payload = mask(whole.encode()[:2000].decode("utf-8", "ignore"), labels, config)
    out = {}
    for label, level, source, _ in threats:
        kind = f"[{source}] {label}"
        hidden = any(r.is_active and r.pattern_label == label and (not r.path_pattern or fnmatch.fnmatchcase(request.path.lstrip("/"), r.path_pattern)) for r in rules)
        if kind not in out and not hidden and not (f"/{path.strip('/')}/".find("/api/") >= 0 and level in config.api_suppress_levels):
            out[kind] = (kind, level, score, payload, mask(request.url, labels, config))
    return list(out.values())


BITS = [
    "union select", "<script>", "../../", "password=hunter22", "9876543210", "ABCDE1234F", "%2541%2542", "é", "plain words", "&amp;", "&", "=", "onerror=alert(1)", "; cat /etc/passwd", "${jndi:ldap://x}", "http://127.0.0.1/", "2341 2341 2346", "UNION/**/SELECT", "%00",
    "eval(base64_decode('x'))", "api_key=abcdef0123456789abcdef", "or 1=1 --", "sleep(5)", "<iframe src=x>", "\\u003cscript\\u003e", "HDFC0001234", "{{7*7}}", "O:8:\"stdClass\":0:{}", "file:///etc/hosts", "\n", " ", "x" * 40,
]


@pytest.fixture(scope="module")
def mixed(spark, sf_dir, tmp_path_factory):
    """pages whose texts hold what rules look for, some longer than what is scanned, and the given pages."""
    own = random.Random(11)
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    paths = ["login", "api/v1/users", "view/1", "assets/app.js", "", "a//b/"]
    for k in range(150):
        text = " ".join(own.choice(BITS) for _ in range(own.choice([0, 1, 2, 5, 12])))
        rows.append((10_000 + k, f"http://own.example.com/{own.choice(paths)}?q={own.choice(['1', 'a+b', '%3Cscript%3E', 'union%20select%201'])}", text * own.choice([1, 1, 1, 400])))
    folder = str(tmp_path_factory.mktemp("mixed"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_request_pipeline(spark, mixed):
    config, rules = EngineConfig(), adapters.exclusion_rules(spark).collect()
    requests = adapters.page_requests(spark, mixed)
    parts = {r.request_id: r.segments.asDict() for r in segments.with_segments(requests).select("request_id", "segments").collect()}
    want, kinds = {}, set()
    for r in requests.collect():
        for k, row in enumerate(logged(r, parts[r.request_id], config, rules)):
            want.setdefault(r.request_id, []).append(row)
            kinds.add(row[0])
    assert len(kinds) > 30
    got = {}
    for r in QUERIES["request_pipeline"](spark, mixed).orderBy("request_id", "pos").collect():
        got.setdefault(r.request_id, []).append((r.type, r.threat_level, r.confidence_score, r.payload, r.url))
    assert sorted(got) == sorted(want)
    wrong = {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert len(wrong) == 0, next(iter(wrong.items()))
    alerts = {r.request_id: (r.type, r.threat_level, r.url) for r in QUERIES["request_alerts"](spark, mixed).collect()}
    plain = lambda url: re.sub("^https?://", "hxxp://", url).replace(".", "[.]")
    assert alerts == {k: (v[0][0], v[0][1], plain(v[0][4])) for k, v in want.items()}
