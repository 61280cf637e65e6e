"""Suppression: exclusion rules, windows anchored at the first event of a key, and flood counting.

The anchored windows are folds over a key's times in order.  A key's times are first thinned to one row per second and
key, with a count, so that a hot key grows with the seconds it covers and not with its events, and the fold runs over
batches in order, holding a few numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import glob_to_regex


def glob_column(column):
    """An anchored expression for each glob of a column: the translation of glob_to_regex, for rule tables."""

    @F.pandas_udf("string")
    def translate(globs: pd.Series) -> pd.Series:
        return globs.map(lambda g: None if g is None or g == "" else glob_to_regex(g))

    return translate(column)


#: Lengths of the literal beginnings that rules are indexed by, and the parts that a label's rows are dealt to.
PREFIXES, SALTS = (0, 4, 12, 24), 8


def literal_prefix(glob_col) -> F.Column:
    """What a glob's matches all begin with; of one without special characters, the whole."""
    return F.regexp_extract(glob_col, r"^[^*?\[\\]*", 0)


def excluded(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (type, url or path) less those that an active rule's label equals and whose path its pattern, if any, fits.

    Rules go by label and the longest of PREFIXES characters that their pattern begins with; rows meet them by equality
    of both, and a pattern is only tried on rows that begin like it.  A label's rows are dealt to SALTS parts.
    """
    label = F.regexp_replace("type", r"^\[[^\]]*\]\s*", "")
    path = F.ltrim(F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")), F.lit("/"))
    rules = rules.where(F.coalesce("is_active", F.lit(True))).select(F.col("pattern_label").alias("_label"), F.coalesce("path_pattern", F.lit("")).alias("_pattern")).distinct()
    rules = rules.withColumn("_glob", glob_column(F.col("_pattern"))).withColumn("_begins", literal_prefix(F.col("_pattern")))
    rules = rules.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    out = rows.withColumns({"_own": label, "_path": path}).withColumn("_part", F.pmod(F.xxhash64("_path"), F.lit(SALTS)))
    for k, size in enumerate(PREFIXES):
        longer = F.length("_begins") >= size
        own = rules.where(longer & (F.length("_begins") < PREFIXES[k + 1]) if k + 1 < len(PREFIXES) else longer).select("_label", "_glob", "_salt", F.substring("_begins", 1, size).alias("_head"))
        on = (out["_own"] == own["_label"]) & (out["_part"] == own["_salt"]) & (F.substring(out["_path"], 1, size) == own["_head"]) & (own["_glob"].isNull() | F.expr("_path rlike _glob"))
        out = out.join(own, on, "left_anti")
    return out.drop("_own", "_path", "_part")


def windowed(batches: Iterator[pd.DataFrame], keys: list[str], window_s: int) -> Iterator[pd.DataFrame]:
    """Adds to each key's seconds, sorted, whether one opens a window, and how many events its window held before it.

    From the second that opens a window the next one is found by a search, so steps are taken per window, not per row.
    The window that a batch ends in goes on in the next.
    """
    key, start, held = None, 0, 0
    for pdf in batches:
        if pdf.empty:
            continue
        names, sec, n = pdf[keys].to_numpy(), pdf["sec"].to_numpy(), pdf["n"].to_numpy()
        group = np.cumsum(np.append(False, (names[1:] != names[:-1]).any(axis=1)))
        low = sec.min()
        line = group * (sec.max() - low + window_s + 1) + sec - low  # keys one after the other, more than a window apart
        after = np.searchsorted(line, line + window_s).tolist()
        at, opens = int(np.searchsorted(line, start + window_s - low)) if names[0].tolist() == key else 0, []
        while at < len(sec):
            opens.append(at)
            at = after[at]
        opened = np.zeros(len(sec), bool)
        opened[opens] = True
        total = np.cumsum(n) - n
        before = total - np.append(total[opens], -held)[np.cumsum(opened) - 1]
        key, held = names[-1].tolist(), before[-1] + n[-1]
        start = sec[opens[-1]] if opens else start
        yield pdf.assign(opened=opened, before=before)


def _windows(rows: DataFrame, keys: list[str], time_col: str, window_s: int) -> DataFrame:
    """(keys, sec, n, opened, before) of each key and second with events; rows without a time or a key are in no window."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", sec long, n long, opened boolean, before long"
    per = rows.groupBy(*keys, F.unix_timestamp(time_col).alias("sec")).agg(F.count("*").alias("n")).dropna(subset=[*keys, "sec"])
    per = per.repartition(*keys).sortWithinPartitions(*keys, "sec")
    return per.mapInPandas(lambda it: windowed(it, keys, window_s), schema)


def _orderable(rows: DataFrame, names: list[str]) -> list[str]:
    kinds = {f.name: f.dataType for f in rows.schema}
    return [c for c in names if "map<" not in kinds[c].simpleString() and "variant" not in kinds[c].simpleString()]


def first_in_window(rows: DataFrame, keys: list[str], time_col: str = "created_at", window_s: int = 300, order_cols: tuple[str, ...] | None = None) -> DataFrame:
    """Rows that are not within window_s seconds after the last row kept of their key.  Dropped rows do not extend it.

    Of a key's rows in one second the least stands, by order_cols if they are given, else by time and then by all other
    columns: rows need no id of their own.  Rows without a time or without one of the keys go.
    """
    kept = _windows(rows, keys, time_col, window_s).where("opened").select(*keys, "sec")
    order = list(order_cols or [time_col, *_orderable(rows, [c for c in rows.columns if c not in (*keys, time_col)])])
    least = F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_row")
    firsts = rows.groupBy(*keys, F.unix_timestamp(time_col).alias("sec")).agg(least).join(kept, [*keys, "sec"])
    return firsts.select(*(c if c in keys else F.col(f"_row.`{c}`").alias(c) for c in rows.columns))


def flood_windows(rows: DataFrame, key: str = "ip_address", time_col: str = "created_at", window_s: int = 60) -> DataFrame:
    """(key, sec, n, before): events of each key and second, and how many its window held before that second.

    A window begins with the first event after the last one's end and lasts window_s seconds.
    """
    return _windows(rows, [key], time_col, window_s).select(key, "sec", "n", "before")


def floods(rows: DataFrame, threshold: int = 300, window_s: int = 60, key: str = "ip_address", time_col: str = "created_at") -> DataFrame:
    """(key, sec, requests, over): seconds in which a key's window goes beyond the threshold, and by how many requests."""
    w = flood_windows(rows, key, time_col, window_s).withColumn("requests", F.col("before") + F.col("n"))
    return w.where(F.col("requests") > threshold).select(key, "sec", "requests", (F.col("requests") - F.greatest("before", F.lit(threshold))).alias("over"))


def flood_count(rows: DataFrame, as_of, window_s: int = 60, key: str = "ip_address", time_col: str = "created_at") -> DataFrame:
    """(key, requests): what each key's counter shows at as_of, a time in seconds; none where the last window is over.

    A look at the past: events after as_of do not count, and looking counts nothing.
    """
    w = flood_windows(rows.where(F.unix_timestamp(time_col) <= as_of), key, time_col, window_s)
    began = F.max(F.when(F.col("before") == 0, F.col("sec")))
    held = w.groupBy(key).agg(began.alias("began"), F.max_by(F.col("before") + F.col("n"), "sec").alias("requests"))
    return held.where(F.col("began") + window_s > as_of).select(key, "requests")


#: Fixed values of a flood's log row.
FLOOD_TYPE, FLOOD_PAYLOAD = "[ddos] Excessive Requests", "Request frequency exceeded threshold"


def flood_requests(rows: DataFrame, threshold: int = 300, window_s: int = 60, dedup_s: int = 300, order_cols: tuple[str, ...] | None = None) -> DataFrame:
    """The very requests that a flood is logged for, with the count of their window so far, requests.

    That is the first request beyond the threshold of an address, and from then on the first beyond it after each
    dedup_s seconds.  Requests of one second count in the order of time and order_cols (all other columns, if not given).
    """
    w = flood_windows(rows, "ip_address", "created_at", window_s).where(F.col("before") + F.col("n") > threshold)
    nth = F.greatest(F.lit(threshold) - F.col("before"), F.lit(0)) + 1
    w = w.select("ip_address", "sec", nth.alias("n"), F.greatest("before", F.lit(threshold)).alias("passed"))
    # a key's seconds still lie together and in order
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"ip_address {types['ip_address']}, sec long, n long, passed long, opened boolean, before long"
    found = w.mapInPandas(lambda it: windowed(it, ["ip_address"], dedup_s), schema).where("opened").select("ip_address", "sec", F.col("n").alias("_nth"), (F.col("passed") + 1).alias("requests"))
    order = order_cols or _orderable(rows, [c for c in rows.columns if c not in ("ip_address", "created_at")])
    near = rows.withColumn("sec", F.unix_timestamp("created_at")).join(found, ["ip_address", "sec"])
    # the rank's bound is a constant, so each task sends at most so many rows of a second
    place = F.row_number().over(Window.partitionBy("ip_address", "sec").orderBy("created_at", *order))
    return near.withColumn("_place", place).where(F.col("_place") <= threshold + 1).where(F.col("_place") == F.col("_nth")).drop("sec", "_nth", "_place")


def flood_rows(rows: DataFrame, threshold: int = 300, window_s: int = 60, dedup_s: int = 300, order_cols: tuple[str, ...] | None = None) -> DataFrame:
    """The log row of each flood, once per de-duplication window and address, with the url and agent of its request."""
    kept = flood_requests(rows, threshold, window_s, dedup_s, order_cols)
    own = [F.col(c) if c in kept.columns else F.lit(None).cast(t).alias(c) for c, t in (("url", "string"), ("user_agent", "string"), ("user_id", "long"))]
    return kept.select("ip_address", "created_at", *own, F.lit(FLOOD_TYPE).alias("type"), F.lit("high").alias("threat_level"), F.lit(90).alias("confidence_score"), F.lit("very_high").alias("confidence_label"), F.lit(FLOOD_PAYLOAD).alias("payload"))


def flood_events(rows: DataFrame, threshold: int = 300, window_s: int = 60, dedup_s: int = 300, order_cols: tuple[str, ...] | None = None) -> DataFrame:
    """What listeners hear of each logged flood: the address, its count, and the bounds that it went beyond."""
    kept = flood_requests(rows, threshold, window_s, dedup_s, order_cols)
    return kept.select("ip_address", "created_at", "requests", F.lit(threshold).alias("threshold"), F.lit(window_s).alias("window_s"))
