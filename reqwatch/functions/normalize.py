"""Text normalisation against evasive encodings, in one vectorised function on bytes."""

from __future__ import annotations

import html
import re
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEGMENT_BYTES = 8000
_COMMENT, _SPACE = re.compile(rb"/\*.*?\*/", re.S), re.compile(rb"[ \t\n\x0b\f\r]+")
_ENTITY, _UNICODE, _HEX = re.compile(rb"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"), re.compile(rb"\\u([0-9a-fA-F]{4})"), re.compile(rb"\\x([0-9a-fA-F]{2})")


def _entity(m: re.Match) -> bytes:
    text = m.group().decode("ascii")
    plain = html.unescape(text)
    return m.group() if plain == text or plain == "�" else plain.encode("utf-8", "surrogatepass")


def _ascii(m: re.Match) -> bytes:
    code = int(m.group(1), 16)
    return bytes([code]) if code < 128 else m.group()


def normalize_bytes(data: bytes) -> bytes:
    """Comments become spaces, entities, escapes and up to three layers of URL encoding are undone, white space shrinks."""
    data = _COMMENT.sub(b" ", data[:SEGMENT_BYTES])
    data = _ENTITY.sub(_entity, data)
    data = _UNICODE.sub(_ascii, data)
    data = _HEX.sub(lambda m: bytes([int(m.group(1), 16)]), data)
    for _ in range(3):
        plain = unquote_to_bytes(data.replace(b"+", b" "))
        if plain == data:
            break
        data = plain
    return _SPACE.sub(b" ", data).strip(b" \t\n\r\0\x0b")


def normalize_text(text: str) -> str:
    """Bytes that are no UTF-8 show as Latin-1 characters, one each, so byte expressions keep their meaning."""
    data = normalize_bytes(text.encode("utf-8", "surrogatepass"))
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


@F.pandas_udf(T.StringType())
def normalize_segment(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else normalize_text(t))
