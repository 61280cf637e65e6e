"""SQL of the views in sources.adapters, for checking queries against another engine."""

from __future__ import annotations

from ..sources.adapters import AGENTS, AS_OF, LABELS, LEVELS, PATHS, PROVIDERS
from ..functions import fixed

NOW = f"TIMESTAMP '{AS_OF}'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def pick(values, number: str) -> str:
    return f"([{', '.join(map(text, values))}])[({number}) % {len(values)} + 1]"


def case(column: str, values: dict, other: str = "NULL") -> str:
    return f"CASE {column} {' '.join(f'WHEN {text(k)} THEN {text(v)}' for k, v in values.items())} ELSE {other} END"


_IP = "concat('10.0.', (user_id // 256)::BIGINT, '.', user_id % 256)"
LOGS = f"""SELECT event_id AS id, {_IP} AS ip_address, concat('https://shop.example.com/', event_type, '/', user_id % 20) AS url, {pick(AGENTS, "event_id")} AS user_agent,
 '[middleware] ' || {case("event_type", LABELS)} AS type, props AS payload, {case("event_type", LEVELS, "'low'")} AS threat_level, (20 + event_id % 6 * 15)::INTEGER AS confidence_score,
 CASE WHEN 20 + event_id % 6 * 15 >= 76 THEN 'very_high' WHEN 20 + event_id % 6 * 15 >= 51 THEN 'high' WHEN 20 + event_id % 6 * 15 >= 26 THEN 'medium' ELSE 'low' END AS confidence_label,
 event_id % 50 = 0 AS is_false_positive, 'logged' AS action_taken, user_id, ts AS created_at FROM events"""
_EVENT_PATH = f"CASE WHEN event_id % 10 = 3 THEN {pick(PATHS, '(event_id // 10)')} ELSE concat('/', event_type, '/', user_id % 20) END"
#: events as requests.
REQUESTS = f"SELECT event_id AS id, {_IP} AS ip_address, {_EVENT_PATH} AS path, 'https://shop.example.com' || {_EVENT_PATH} AS url, {pick(AGENTS, 'event_id')} AS user_agent, user_id, ts AS created_at FROM events"
_NAMES = "lower(isp || ' ')"
CLOUD = "coalesce(" + ", ".join([f"CASE WHEN contains({_NAMES}, {text(k.lower())}) THEN {text(p)} END" for k, p in fixed.CLOUD_KEYWORDS] + [f"CASE WHEN starts_with(ip_address, {text(k)}) THEN {text(p)} END" for k, p in fixed.CLOUD_PREFIXES]) + ")"
GEO = f"""SELECT {_IP} AS ip_address, substring(upper(n_name), 1, 2) AS country_code, n_name AS country_name, concat('City ', user_id % 9) AS city, {pick(PROVIDERS, "user_id")} AS isp
 FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 7 <> 0) JOIN nation ON user_id % 25 = n_nationkey"""
WITH = f"""WITH base AS ({LOGS}), geo AS ({GEO}), logs AS (SELECT base.*, country_code, country_name, city, isp, CASE WHEN isp IS NOT NULL THEN {CLOUD.replace("ip_address", "base.ip_address")} END AS cloud_provider,
 coalesce(country_code <> 'IN', false) AS is_foreign FROM base LEFT JOIN geo USING (ip_address)) """
RULES = "(VALUES ('XSS Script Tag', '.*'), ('Directory Traversal', 'click/1.*'), ('RCE Shell Function', 'purchase/.'), ('SQL', '.*')) AS r(label, path_glob)"
#: pages as requests.
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/')"
PAGES = f"SELECT page_id, url, html, CASE WHEN page_id % 10 = 3 THEN {pick(PATHS, '(page_id // 10)')} ELSE {_PATH} END AS path, {pick(AGENTS, 'page_id')} AS user_agent FROM pages"
