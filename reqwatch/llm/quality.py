"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_BREAKS, fresh_name, table

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on was as at by this are or from "
    "der die das und ist nicht ein eine zu den von mit auf im dem des "
    "le la les de et un une que en du pour qui dans pas par sur "
    "el los las y del se con por lo su al como es"
).split()
STOP_WORDS = list(dict.fromkeys(STOP_WORDS))
#: Texts of more words than this order their windows as (hash, place) pairs and not as packed 64-bit keys.
PACKED_WORDS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Holds if low <= numerator / denominator <= high; a denominator of 0 passes."""

    name: str
    numerator: str
    denominator: str
    low: float = 0.0
    high: float = 1e18


RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 12.0),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.3),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.35),
    Rule("capitals", "n_capitals", "word_chars", high=0.3),
)


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def _count_without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _words(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(WORD_BREAKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def _covered(places: Column) -> Column:
    """Words that windows of three cover, from the sorted places of the windows."""
    steps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated_packed(windows: Column) -> Column:
    """Keys of 48 bits of the hash and the place; if two neighbours agree in these bits alone, whole hashes are ordered."""
    low = F.lit(PACKED_WORDS - 1).cast("long")
    keys = F.sort_array(F.transform(windows, lambda x, k: F.shiftleft(x, 16).bitwiseOR(k.cast("long"))))
    top, place = lambda x: F.shiftrightunsigned(x, 16), lambda x: x.bitwiseAND(low)
    twice = lambda s: F.filter(s, lambda x, k: F.coalesce(top(F.get(s, k - 1)) == top(x), F.lit(False)) | F.coalesce(top(F.get(s, k + 1)) == top(x), F.lit(False)))
    whole = lambda x: F.get(windows, place(x).cast("int"))
    clash = lambda t: F.size(F.filter(t, lambda x, k: F.coalesce((top(F.get(t, k + 1)) == top(x)) & (whole(F.get(t, k + 1)) != whole(x)), F.lit(False)))) > 0
    count = lambda t: F.when(clash(t), _repeated_paired(windows)).otherwise(_let(F.sort_array(F.transform(t, place)), _covered))
    return _let(keys, lambda s: _let(twice(s), count))


def _repeated_paired(windows: Column) -> Column:
    keys = F.sort_array(F.transform(windows, lambda x, k: F.struct(x.alias("h"), k.cast("long").alias("k"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    twice = lambda s: F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1))
    return _let(keys, lambda s: _let(F.sort_array(F.transform(twice(s), lambda x: x["k"])), _covered))


def _repeat_words(words: Column, packed_words: int) -> Column:
    n = F.size(words)
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.slice(h, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, k: F.xxhash64(x, F.get(h, k + 1), F.get(h, k + 2)))
    either = lambda w: F.when(F.size(w) <= packed_words, _repeated_packed(w)).otherwise(_repeated_paired(w))
    return _let(hashes, lambda h: _let(windows(h), either))


def measures(text: Column, packed_words: int = PACKED_WORDS) -> Column:
    """A struct of the counts that rules use; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WORD_BREAKS)) != "")
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    stop = lambda w: F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))
    of_words = _let(_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), stop(w).cast("long").alias("n_stop_words"), _repeat_words(w, packed_words).alias("n_repeat_words")))
    word_chars = F.length(F.translate(text, WORD_BREAKS, ""))
    counts = [(word_chars, "word_chars"), (_count_without(text, SYMBOLS), "n_symbols"), (_count_without(text, CAPITALS), "n_capitals")]
    return F.struct(of_words.alias("w"), of_lines.alias("l"), *(c.cast("long").alias(n) for c, n in counts))


def quality_table(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", column: str = "quality", packed_words: int = PACKED_WORDS) -> DataFrame:
    """docs with one more struct column: the counts, base_failed, failed_rules (names, in the table's order) and kept.

    A null or empty text has no words and fails the base rule.  Other columns, whatever their names, pass untouched;
    rows that repeat are judged each for itself.
    """
    raw, row = fresh_name([*docs.columns, column], "counts"), fresh_name([*docs.columns, column], "row")
    m = lambda n: F.col(raw)[n]
    value = {n: m("w")[n] for n in ("n_words", "n_stop_words", "n_repeat_words")} | {n: m("l")[n] for n in ("n_lines", "n_dup_lines")}
    value |= {n: m(n) for n in ("word_chars", "n_symbols", "n_capitals")}
    fails = []
    for r in rules:
        ratio = value[r.numerator] / F.nullif(value[r.denominator], F.lit(0))
        fails.append(F.when((ratio < r.low) | (ratio > r.high), F.lit(r.name)))
    base = (value["n_words"] < 50) | (100 * value["n_repeat_words"] > 50 * value["n_words"])
    failed = F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")
    verdict = F.struct(*(v.alias(n) for n, v in value.items()), base.alias("base_failed"), failed.alias("failed_rules"), (~base & (F.size(failed) == 0)).alias("kept"))
    # a row number keeps filters on the verdict above the counting, which the optimiser would else copy into each condition
    counted = docs.withColumn(raw, measures(F.col(text_col), packed_words)).withColumn(row, F.monotonically_increasing_id()).where(F.col(row) >= 0)
    return counted.withColumn(column, verdict).drop(raw, row)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules keep, with the columns they had, whatever their names.

    Null and empty texts have no words and go; rows without an id and rows that repeat are judged each for itself.
    """
    name = fresh_name(docs.columns, "quality")
    return quality_table(docs, column=name).where(F.col(name)["kept"]).select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = quality_table(docs).select("doc_id", "quality.*")
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def _sql_rule(r: Rule) -> str:
    return f"CASE WHEN {r.numerator}::DOUBLE / nullif({r.denominator}, 0) < {r.low} OR {r.numerator}::DOUBLE / nullif({r.denominator}, 0) > {r.high} THEN '{r.name}' END"


_STOP_LIST = ", ".join(f"'{w}'" for w in STOP_WORDS)
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM documents),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls)::BIGINT AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: lower(x) IN ({_STOP_LIST})))::BIGINT AS n_stop_words
      FROM d LEFT JOIN c USING (doc_id)),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, concat_ws(',', {", ".join(_sql_rule(r) for r in RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND failed_rules = '') AS kept, failed_rules FROM v
"""
