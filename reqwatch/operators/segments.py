"""A request's five texts to scan: path, query, body, headers and raw."""

from __future__ import annotations

import fnmatch
import json
import re
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = ("path", "query", "body", "headers", "raw")
#: Fixed values.  Headers that are never scanned.
UNSCANNED_HEADERS = ["cookie", "authorization", "x-xsrf-token", "accept-language", "accept-encoding", "connection", "host", "referer", "origin"]
RAW_CAP, RAW_READ = 65_536, 8_000


def place_field(root: dict, name: str, value: str) -> str | None:
    """Puts a field into the tree: a[b] nests, a[] appends, dots and spaces become underscores, the last wins; returns its first key."""
    name = name.lstrip(" ")
    if not name:
        return None
    head, _, rest = name.partition("[")
    head = re.sub(r"[. ]", "_", head)
    keys = re.findall(r"([^\]]*)\](?:\[|$|)", rest) if rest and "]" in rest else []
    if rest and not keys:
        head, keys = head + "_" + rest, []
    node, last = root, head
    for k in keys:
        child = node.get(last)
        if not isinstance(child, dict):
            child = node[last] = {}
        node, last = child, k if k != "" else str(1 + max((int(x) for x in child if str(x).isdigit()), default=-1))
    node[last] = value
    return head


def parse_form(text: str) -> dict:
    """Form or query text as a tree of its fields."""
    root: dict = {}
    for pair in text.split("&"):
        name, _, value = pair.partition("=")
        place_field(root, unquote_plus(name, errors="replace"), unquote_plus(value, errors="replace"))
    return root


_BOUNDARY = re.compile(r"""boundary\s*=\s*(?:"([^"]+)"|([^\s;,]+))""", re.IGNORECASE)
_DISPOSITION = re.compile(r"""^content-disposition\s*:\s*form-data\b(.*)$""", re.IGNORECASE | re.MULTILINE)
_PARAMETER = re.compile(r""";\s*([\w*-]+)\s*=\s*(?:"((?:\\.|[^"\\])*)"|([^\s;]*))""")


def parse_multipart(text: str, content_type: str) -> dict:
    """The fields of a multipart body as a tree.  File parts go, and with them all fields of the same first key.

    A part's header ends at the first empty line; what stands before the first and behind the closing boundary, parts
    without a name, and a last part that no boundary ends are no fields.  Without a boundary there are none.
    """
    found = _BOUNDARY.search(content_type or "")
    if not found:
        return {}
    mark = "--" + (found.group(1) or found.group(2))
    parts = re.split(r"(?:^|\r?\n)" + re.escape(mark) + r"(--)?[ \t]*(?=\r?\n|$)", text)
    root, files = {}, set()
    # parts: before, "--" or None, part, "--" or None, part ...
    for k in range(2, len(parts) - 1, 2):
        if parts[k - 1]:  # the closing boundary came before
            break
        head, gap, value = parts[k].lstrip("\r\n").partition("\r\n\r\n") if "\r\n\r\n" in parts[k] else parts[k].lstrip("\n").partition("\n\n")
        said = _DISPOSITION.search(head)
        if not said or not gap:
            continue
        own = {n.lower(): re.sub(r"\\(.)", r"\1", q) if q else t for n, q, t in _PARAMETER.findall(said.group(1))}
        if "filename" in own or "filename*" in own:
            files.add(place_field({}, own.get("name", ""), ""))
        elif "name" in own:
            place_field(root, own["name"], value)
    return {k: v for k, v in root.items() if k not in files}


def strip_safe(tree, safe_paths: tuple[str, ...], prefix: str = ""):
    """Drops nodes whose dotted path matches; containers left empty go too."""
    items = tree.items() if isinstance(tree, dict) else enumerate(tree)
    kept = {}
    for k, v in items:
        path = f"{prefix}.{k}" if prefix else str(k)
        if any(fnmatch.fnmatchcase(path, p) for p in safe_paths):
            continue
        if isinstance(v, (dict, list)):
            v = strip_safe(v, safe_paths, path)
            if not v:
                continue
        kept[k] = v
    return kept if isinstance(tree, dict) else list(kept.values()) if len(kept) == len(tree) else kept


def encode_tree(tree) -> str:
    """JSON with escaped non-ASCII characters and plain slashes; lists by position stay lists."""

    def lists(x):
        if isinstance(x, dict):
            x = {str(k): lists(v) for k, v in x.items()}
            return list(x.values()) if x and list(x) == [str(i) for i in range(len(x))] else x
        return [lists(v) for v in x] if isinstance(x, list) else x

    return json.dumps(lists(tree), ensure_ascii=True, separators=(",", ":"))


def tree_text(text: str | None, kind: str, safe_fields: tuple[str, ...] = (), safe_paths: tuple[str, ...] = ()) -> str:
    """kind: json, form, or the content type of a multipart body (whose files and their fields go)."""
    if not text:
        return ""
    if kind == "json":
        try:
            tree = json.loads(text)
        except ValueError:
            return ""
        tree = tree if isinstance(tree, (dict, list)) else [tree]
    else:
        tree = parse_form(text) if kind == "form" else parse_multipart(text, kind)
    if isinstance(tree, list):
        tree = dict(enumerate(tree))
    tree = {k: v for k, v in tree.items() if str(k) not in safe_fields}
    tree = strip_safe(tree, safe_paths) if safe_paths else tree
    return encode_tree(tree) if tree else ""


def _tree(kind: str | None, safe_fields: tuple[str, ...], safe_paths: tuple[str, ...]):
    @F.pandas_udf("string")
    def build(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([tree_text(t, kind or k, safe_fields, safe_paths) for t, k in zip(texts, kinds, strict=True)], dtype=object)

    return build


def headers_json(headers: Column) -> Column:
    """Scanned headers, their first two values joined, as JSON."""
    kept = F.map_filter(headers, lambda k, v: ~F.lower(k).isin(UNSCANNED_HEADERS))
    flat = F.transform_values(kept, lambda k, v: F.array_join(F.slice(v, 1, 2), "; "))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.to_json(flat)).otherwise("")


def raw_text(query_string: Column, body: Column, content_type: Column, content_length: Column) -> Column:
    """Undecoded query string and body, the body unless it is multipart, of unknown length or too long."""
    length = F.coalesce(content_length, F.lit(0))
    ok = (length > 0) & (length <= RAW_CAP) & ~F.coalesce(content_type, F.lit("")).contains("multipart/form-data")
    data = F.when(ok, F.substring(body.cast("binary"), 1, RAW_READ).cast("string"))
    return F.concat_ws("\n", F.when(query_string != "", query_string), F.when(data != "", data))


def with_segments(requests: DataFrame, probe: Column | None = None, safe_fields: tuple[str, ...] = (), safe_paths: tuple[str, ...] = ()) -> DataFrame:
    """requests with one more struct column, segments.  probe: the probe's label; where there is one, the path is not scanned."""
    content = F.lower(F.coalesce(F.col("content_type"), F.lit("")))
    kind = F.when(content.rlike("[/+]json"), "json").when(content.contains("multipart/form-data"), F.col("content_type")).otherwise("form")
    form = F.when(content.contains("json") | content.contains("form-urlencoded") | content.contains("multipart"), F.col("body"))
    path = F.concat(F.lit("/"), F.ltrim(F.col("path"), F.lit("/")))
    query = _tree("form", safe_fields, safe_paths)(F.coalesce("query_string", F.lit("")), kind)
    body = _tree(None, safe_fields, safe_paths)(F.coalesce(form, F.lit("")), kind)
    parts = [
        (F.when(probe.isNull(), path).otherwise("") if probe is not None else path).alias("path"), query.alias("query"), body.alias("body"),
        headers_json(F.col("headers")).alias("headers"), raw_text(F.col("query_string"), F.col("body"), F.col("content_type"), F.col("content_length")).alias("raw"),
    ]
    return requests.withColumn("segments", F.struct(*parts))


def payload_text(segments: Column) -> Column:
    """What a log row stores: query, body and headers, at most 2000 bytes, never cut within a character."""
    piece = lambda n: F.when(segments[n] != "", F.concat(F.lit(f"{n.upper()}: "), segments[n]))
    whole = F.concat_ws("\n", piece("query"), piece("body"), piece("headers"))
    cut = F.regexp_replace(F.substring(whole.cast("binary"), 1, 2000).cast("string"), "�+$", "")
    return F.when(F.octet_length(whole) <= 2000, whole).otherwise(cut)
