"""Correlation of log rows: coordinated attacks, campaigns and bursts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .reports import since


def _top_groups(rows: DataFrame, key: str, least: int, limit: int) -> DataFrame:
    out = rows.groupBy(key).agg(F.countDistinct("ip_address").alias("unique_ips"), F.count("*").alias("attempts"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return out.where(F.col("unique_ips") >= least).orderBy(F.desc("unique_ips"), F.desc("attempts"), key).limit(limit)


def span(unit: int):
    """Time between first_seen and last_seen, in units of so many seconds."""
    return F.round((F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / unit, 2)


def coordinated_attacks(logs: DataFrame, as_of: str, seconds: int = 900, least: int = 3, limit: int = 20) -> DataFrame:
    """Urls that at least so many addresses tried lately.  The addresses are gathered for the reported urls only."""
    rows = since(logs, as_of, seconds)
    top = _top_groups(rows, "url", least, limit)
    ips = rows.join(F.broadcast(top.select("url")), "url").select("url", "ip_address").distinct()  # at most `limit` urls
    ips = ips.groupBy("url").agg(F.array_join(F.array_sort(F.collect_list("ip_address")), ",").alias("attacker_ips"))
    return top.join(ips, "url").withColumn("duration_minutes", span(60)).orderBy(F.desc("unique_ips"), F.desc("attempts"), "url")


def coordinated_addresses(logs: DataFrame, as_of: str, seconds: int = 900, least: int = 3, limit: int = 20) -> DataFrame:
    """(url, ip_address, attempts): the addresses of those urls as rows, for urls that more of them try than fit in one text.

    Attempts without an address are the row whose address is null; a null url is none.
    """
    rows = since(logs, as_of, seconds)
    top = _top_groups(rows, "url", least, limit).select("url")  # at most `limit` urls
    return rows.groupBy("url", "ip_address").agg(F.count("*").alias("attempts")).join(F.broadcast(top), "url")


def campaigns(logs: DataFrame, as_of: str, seconds: int = 86400, least: int = 5, limit: int = 15, sample: int = 10) -> DataFrame:
    """Types that at least so many addresses used in the last day, with the first few addresses."""
    rows = since(logs, as_of, seconds)
    top = _top_groups(rows, "type", least, limit)
    own = rows.join(F.broadcast(top.select("type")), "type").select("type", "ip_address").distinct()
    ranked = own.withColumn("salt", F.pmod(F.xxhash64("ip_address"), F.lit(64)))
    few = lambda c: F.slice(F.array_sort(c), 1, sample)
    part = ranked.groupBy("type", "salt").agg(few(F.collect_set("ip_address")).alias("ips"))
    ips = part.groupBy("type").agg(F.array_join(few(F.flatten(F.collect_list("ips"))), ",").alias("sample_ips"))
    return top.join(ips, "type").withColumn("duration_hours", span(3600)).orderBy(F.desc("unique_ips"), F.desc("attempts"), "type")


def rapid_attackers(logs: DataFrame, as_of: str, seconds: int = 300, least: int = 10, limit: int = 20) -> DataFrame:
    """Addresses with many rows lately, and their rows a minute."""
    out = since(logs, as_of, seconds).groupBy("ip_address").agg(F.count("*").alias("attack_count"), F.countDistinct("type").alias("attack_types"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    span = F.greatest((F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen")) / 60, F.lit(1.0))
    out = out.where(F.col("attack_count") >= least).withColumn("attacks_per_minute", F.round(F.col("attack_count") / span, 2))
    return out.orderBy(F.desc("attack_count"), "ip_address").limit(limit)


def correlation_summary(logs: DataFrame, as_of: str, windows: tuple[int, int, int] = (900, 86400, 300), least: tuple[int, int, int] = (3, 5, 10)) -> DataFrame:
    """Sizes of the three reports."""
    parts = [
        _top_groups(since(logs, as_of, windows[0]), "url", least[0], 20).agg(F.count("*").alias("coordinated_attacks")),
        _top_groups(since(logs, as_of, windows[1]), "type", least[1], 15).agg(F.count("*").alias("attack_campaigns")),
        rapid_attackers(logs, as_of, windows[2], least[2]).agg(F.count("*").alias("rapid_attackers")),
    ]
    return parts[0].crossJoin(F.broadcast(parts[1])).crossJoin(F.broadcast(parts[2]))  # one row each


KINDS = {"coordinated": (coordinated_attacks, "coordinated_attacks"), "campaigns": (campaigns, "attack_campaigns"), "rapid": (rapid_attackers, "rapid_attackers")}


def correlation(logs: DataFrame, as_of: str, kind: str = "all") -> dict[str, DataFrame]:
    """The reports that kind asks for, by name, with their usual bounds."""
    if kind != "all" and kind not in KINDS:
        raise ValueError(f"kind must be all or one of {sorted(KINDS)}")
    return {name: report(logs, as_of) for k, (report, name) in KINDS.items() if kind in ("all", k)}
