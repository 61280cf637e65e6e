"""The correlation reports as streams: at each slide's end, what the batch reports say of the rows before it.

Rows are counted by pane (as long as the slide), key and member before they meet a window, so the state holds a row for
each member of a key and window and not for each log row, and a hot key's rows are summed before the shuffle.  A window
is complete, and its state goes, once the watermark has passed its end; all its members then come in one micro-batch,
which is written before it is ranked.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.correlate import span
from .state import append, to_log


def members(rows: DataFrame, key: str, member: str, window_s: int, slide_s: int, watermark: str = "10 minutes") -> DataFrame:
    """(as_of, key, member, n, first_seen, last_seen): the members of each key in the window_s seconds before as_of.

    as_of: each multiple of slide_s since 1970 in UTC whose window holds a row.  Nulls are a key, and a member, of their
    own; rows without a time, or later than the watermark allows, go.
    """
    if slide_s <= 0 or window_s % slide_s:
        raise ValueError("the window must be a multiple of the slide")
    own = rows.where("created_at IS NOT NULL").select(F.col(key), F.col(member), "created_at").withWatermark("created_at", watermark)
    pane = F.window("created_at", f"{slide_s} seconds").alias("pane")
    panes = own.groupBy(pane, key, member).agg(F.count("*").alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    whole = F.window("pane", f"{window_s} seconds", f"{slide_s} seconds").alias("whole")
    out = panes.groupBy(whole, key, member).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.select(F.col("whole.end").alias("as_of"), key, member, "n", "first_seen", "last_seen")


def _groups(found: DataFrame, key: str, unique: str, total: str, member: str) -> DataFrame:
    ends = (F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return found.groupBy("as_of", key).agg(F.count(member).alias(unique), F.sum("n").alias(total), *ends)


def _ranked(groups: DataFrame, order: list, limit: int) -> DataFrame:
    """The first of each as_of.  The rank's bound is a constant, so each task sends at most so many rows of one."""
    place = F.row_number().over(Window.partitionBy("as_of").orderBy(*order))
    return groups.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def _top(found: DataFrame, key: str, least: int, limit: int) -> DataFrame:
    groups = _groups(found, key, "unique_ips", "attempts", "ip_address")
    return _ranked(groups.where(F.col("unique_ips") >= least), [F.desc("unique_ips"), F.desc("attempts"), key], limit)


def coordinated(found: DataFrame, least: int = 3, limit: int = 20) -> DataFrame:
    """correlate.coordinated_attacks of each as_of."""
    top = _top(found, "url", least, limit)
    ips = found.join(top.select("as_of", "url"), ["as_of", "url"]).groupBy("as_of", "url")
    ips = ips.agg(F.array_join(F.array_sort(F.collect_list("ip_address")), ",").alias("attacker_ips"))
    return top.join(ips, ["as_of", "url"]).withColumn("duration_minutes", span(60))


def campaigns(found: DataFrame, least: int = 5, limit: int = 15, sample: int = 10) -> DataFrame:
    """correlate.campaigns of each as_of."""
    top = _top(found, "type", least, limit)
    few = lambda c: F.slice(F.array_sort(c), 1, sample)
    own = found.join(top.select("as_of", "type"), ["as_of", "type"])
    part = own.groupBy("as_of", "type", F.pmod(F.xxhash64("ip_address"), F.lit(64)).alias("salt")).agg(few(F.collect_set("ip_address")).alias("ips"))
    ips = part.groupBy("as_of", "type").agg(F.array_join(few(F.flatten(F.collect_list("ips"))), ",").alias("sample_ips"))
    return top.join(ips, ["as_of", "type"]).withColumn("duration_hours", span(3600))


def rapid(found: DataFrame, least: int = 10, limit: int = 20) -> DataFrame:
    """correlate.rapid_attackers of each as_of."""
    out = _groups(found, "ip_address", "attack_types", "attack_count", "type").where(F.col("attack_count") >= least)
    minutes = F.greatest((F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / 60, F.lit(1.0))
    out = _ranked(out, [F.desc("attack_count"), "ip_address"], limit)
    return out.withColumn("attacks_per_minute", F.round(F.col("attack_count") / minutes, 2))


@dataclass(frozen=True)
class Kind:
    """A report, what it groups and counts, and its usual window and slide in seconds."""

    report: Callable[..., DataFrame]
    key: str
    member: str
    window_s: int
    slide_s: int


KINDS = {
    "coordinated": Kind(coordinated, "url", "ip_address", 900, 60),
    "campaigns": Kind(campaigns, "type", "ip_address", 86400, 3600),
    "rapid": Kind(rapid, "ip_address", "type", 300, 60),
}


def to_reports(rows: DataFrame, kind: str, path: str, checkpoint: str, window_s: int | None = None, slide_s: int | None = None, watermark: str = "10 minutes", **bounds):
    """A writer that keeps, of a stream of log rows, path/members and the reports of each as_of at path/reports.

    bounds: least, limit and, of campaigns, sample.  A micro-batch that runs again replaces what it left before.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {sorted(KINDS)}")
    own = KINDS[kind]
    found = members(rows, own.key, own.member, window_s or own.window_s, slide_s or own.slide_s, watermark)
    return to_log(found, f"{path}/members", checkpoint, lambda batch, number: append(own.report(batch, **bounds), f"{path}/reports", number))
