"""Fill-in-middle transformation by a sparse checkpoint index.

A text is counted in units, a run of white space with the word behind it, or the white space at the end.  While the
units are counted, the byte and the code-point offset of every EVERY-th unit's end are recorded.  A cut after u units
is then found by a binary search among the checkpoints and a short rescan of the bytes behind the one below it.  Which
texts are transformed, and where they are cut, follows from the id alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the transformation's form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units between checkpoints, and bytes that are looked at together.
EVERY, BLOCK = 64, 1 << 16
SEED, RATE, SPM_RATE = 42, 50, 80

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _ends(raw: np.ndarray, at: int, to: int) -> np.ndarray:
    """Byte offsets behind the words that end within raw[at:to]."""
    word = ~_SPACE[raw[at : to + 1]]
    if to == len(raw):
        word = np.append(word, False)
    return at + 1 + np.flatnonzero(word[:-1] & ~word[1:])


def _points(raw: np.ndarray) -> np.ndarray:
    """Whether a code point begins at each byte."""
    return (raw & 0xC0) != 0x80


@dataclass
class Checkpoints:
    """The units of a text, counted: n, and the offsets at the end of every EVERY-th, the text's beginning first."""

    raw: np.ndarray
    n: int
    units: np.ndarray
    bytes: np.ndarray
    chars: np.ndarray

    @classmethod
    def count(cls, raw: np.ndarray, every: int = EVERY, block: int = BLOCK) -> Checkpoints:
        n, chars, last, marks = 0, 0, 0, [(np.zeros(1, np.int64),) * 3]
        for at in range(0, len(raw), block):
            to = min(at + block, len(raw))
            ends = _ends(raw, at, to)
            picked = np.arange(every - 1 - n % every, len(ends), every)
            begun = np.cumsum(_points(raw[at:to]))
            marks.append((n + 1 + picked, ends[picked], chars + begun[ends[picked] - 1 - at]))
            n, chars, last = n + len(ends), chars + int(begun[-1]), int(ends[-1]) if len(ends) else last
        units, places, points = (np.concatenate(x) for x in zip(*marks, strict=True))
        return cls(raw, n + (last < len(raw)), units, places, points)

    def cut(self, unit: int, block: int = BLOCK) -> tuple[int, int]:
        """(bytes, code points) before the end of the unit-th unit; 0 units end at 0."""
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        left, at, chars = unit - int(self.units[k]), int(self.bytes[k]), int(self.chars[k])
        begun = at
        while left and at < len(self.raw):
            to = min(at + block, len(self.raw))
            ends = _ends(self.raw, at, to)
            at = int(ends[left - 1]) if left <= len(ends) else to
            left -= min(left, len(ends))
            if not left:
                break
        # units that the words do not hold: the white space at the end
        return at, chars + int(np.count_nonzero(_points(self.raw[begun:at])))


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from seed and id; without an id, from the seed alone."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(h[k : k + 8], 16) for k in (0, 8, 16, 24))  # type: ignore[return-value]


def transform(text: str, doc_id: int | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = text.encode("utf-8", "surrogatepass")
    index = Checkpoints.count(np.frombuffer(data, np.uint8))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return index.n, "plain", None, None, text
    low, high = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_chars), (b, b_chars) = index.cut(low), index.cut(high)
    prefix, middle, suffix = (x.decode("utf-8", "surrogatepass") for x in (data[:a], data[a:b], data[b:]))
    form = "spm" if h4 % 100 < spm_rate else "psm"
    head = SUFFIX + suffix + PREFIX + prefix if form == "spm" else PREFIX + prefix + SUFFIX + suffix
    return index.n, form, a_chars, b_chars - a_chars, head + MIDDLE + middle


FIM_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _batches(batches, seed: int, rate: int, spm_rate: int):
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for at in range(0, len(ids), 256):  # outputs of a few texts are held at once
            texts = batch.column("text").slice(at, 256).to_pylist()
            rows = [transform(t or "", i, seed, rate, spm_rate) for t, i in zip(texts, ids[at : at + 256], strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids[at : at + 256], pa.int64()), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()), "prefix_chars": pa.array(prefix, pa.int64()),
                "middle_chars": pa.array(middle, pa.int64()), "output": pa.array(output, pa.string()),
            })


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output), one row per row of docs; nothing is shuffled.

    rate: per cent of texts that are transformed; spm_rate: per cent of these with the suffix first.  Empty texts and
    texts that hold a marker stay plain, with null in the two lengths.  A null text is empty; a null id draws from the
    seed alone; rows that repeat an id are cut by the same draws.  Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _batches(it, seed, rate, spm_rate), FIM_SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of.  No part holds a marker, so the first of each parts them."""
    size = len(PREFIX)
    body = F.substring(output, F.lit(size + 1), F.length(output))

    def parts(inner: str) -> tuple[Column, Column, Column]:
        """What stands before and behind the marker between the two first parts, and the middle."""
        one = F.substring_index(body, inner, 1)
        rest = F.substring(body, F.length(one) + size + 1, F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substring(rest, F.length(two) + size + 1, F.length(rest))

    prefix, suffix, middle = parts(SUFFIX)
    suffix_, prefix_, middle_ = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_, middle_, suffix_))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
ORACLE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u, sha256(concat('{SEED}:', doc_id)) AS h FROM documents),
 r AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS c4 FROM d),
 f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= {RATE} THEN 'plain' WHEN c4 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM r)
 SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM f"""
