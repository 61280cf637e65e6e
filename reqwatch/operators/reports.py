"""Reports over the log: one function each, with the time that counts as now given."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("high", "medium", "low")


def _at(as_of: str) -> Column:
    return F.to_timestamp(F.lit(as_of))


def since(logs: DataFrame, as_of: str, seconds: int) -> DataFrame:
    """Rows of the last seconds before as_of."""
    return logs.where(F.col("created_at") >= F.timestamp_seconds(F.unix_timestamp(_at(as_of)) - seconds))


def checked(name: str, value: int, low: int, high: int) -> int:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def checked_ip(ip: str) -> str:
    """An address of either version, as it was written."""
    ipaddress.ip_address(ip)  # a ValueError says what is wrong
    return ip


def parse_since(text: str) -> int:
    """Seconds of Nh, Nd or Nw; a day for anything else."""
    unit = {"h": 3600, "d": 86400, "w": 604800}.get(text[-1:], 0)
    return int(text[:-1]) * unit if unit and text[:-1].isdigit() else 86400


def threats(logs: DataFrame, *, keyword: str | None = None, ip: str | None = None, type_like: str | None = None, level: str | None = None, country: str | None = None, is_foreign: bool | None = None, cloud_provider: str | None = None, is_false_positive: bool | None = None, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Rows that all given filters keep.  Keywords match in either case anywhere in address, type or url."""
    if level is not None and level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    out = logs
    if keyword is not None:
        like = f"%{keyword}%"
        out = out.where(F.col("ip_address").ilike(like) | F.col("type").ilike(like) | F.col("url").ilike(like))
    if type_like is not None:
        out = out.where(F.col("type").ilike(f"%{type_like}%"))
    for name, value in (("ip_address", ip), ("threat_level", level), ("country_code", country), ("is_foreign", is_foreign), ("cloud_provider", cloud_provider), ("is_false_positive", is_false_positive)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if date_from is not None:
        out = out.where(F.col("created_at") >= _at(date_from))
    if date_to is not None:
        out = out.where(F.col("created_at") <= _at(date_to))
    return out


def page(logs: DataFrame, number: int = 1, per_page: int = 20) -> DataFrame:
    """A page of rows, newest first."""
    checked("per_page", per_page, 1, 100)
    return logs.orderBy(F.desc("created_at"), "id").offset((number - 1) * per_page).limit(per_page)


def _covering(counts: list[tuple], skip: int, take: int) -> tuple[list, int]:
    """Of (bucket, rows), in order, the buckets that hold the rows skip to skip + take, and how many rows of them to skip."""
    found, before = [], 0
    for bucket, n in counts:
        if before + n > skip and before < skip + take:
            found.append((bucket, before))
        before += n
    return [b for b, _ in found], skip - found[0][1] if found else 0


def deep_page(logs: DataFrame, number: int = 1, per_page: int = 20) -> DataFrame:
    """The same page as page(), however deep, without sorting what comes before it.

    Counts by day, then by second within the days that the page touches, say in which seconds it lies; only their rows
    are read and sorted.  The driver sees a count for each day of the log and each second of two days at most (days
    between hold no more rows than the page).  Rows without a time come last, as in page().
    """
    checked("per_page", per_page, 1, 100)
    skip, rows = (number - 1) * per_page, logs
    for unit in ("day", "second"):
        bucket = F.unix_timestamp(F.date_trunc(unit, "created_at"))
        counts = sorted(((r.b, r.n) for r in rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
        held, skip = _covering(counts, skip, per_page)
        times = [b for b in held if b is not None]
        inside = F.col("created_at").isNull() if None in held else F.lit(False)
        if times:
            first, last = F.timestamp_seconds(F.lit(min(times))), F.timestamp_seconds(F.lit(max(times))) + F.expr(f"INTERVAL 1 {unit}")
            kind = logs.schema["created_at"].dataType
            inside = inside | (F.col("created_at") >= first.cast(kind)) & (F.col("created_at") < last.cast(kind))
        rows = rows.where(inside)
    return rows.orderBy(F.desc("created_at"), "id").offset(skip).limit(per_page)


def page_count(logs: DataFrame, per_page: int = 20) -> DataFrame:
    """(total, last_page)."""
    n = F.count("*")
    return logs.agg(n.alias("total"), F.greatest(F.lit(1), F.ceil(n / per_page)).cast("long").alias("last_page"))


def by_id(logs: DataFrame, id_: int) -> DataFrame:
    return logs.where(F.col("id") == id_)


def stats(logs: DataFrame, as_of: str) -> DataFrame:
    """Totals in one pass: rows are counted by address first, so both numbers of addresses come of one small shuffle."""
    day, hour = F.to_date(_at(as_of)), _at(as_of) - F.expr("INTERVAL 1 HOUR")
    sums = {x: F.col("threat_level") == x for x in LEVELS} | {"cloud_attacks": F.col("cloud_provider").isNotNull(), "today": F.to_date("created_at") == day, "last_hour": F.col("created_at") >= hour}
    per = logs.groupBy("ip_address").agg(F.count("*").alias("total"), F.max("is_foreign").alias("foreign"), *(F.count_if(c).alias(x) for x, c in sums.items()))
    whole = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x)
    own = F.col("ip_address")
    return per.agg(
        whole("total"), *map(whole, LEVELS), F.count(own).alias("unique_ips"), F.count(F.when(F.col("foreign"), own)).alias("foreign_ips"), *map(whole, list(sums)[len(LEVELS) :]),
    )


def live_count(logs: DataFrame, as_of: str, seconds: int = 3600) -> DataFrame:
    return since(logs, as_of, seconds).agg(F.count("*").alias("live"))


def counted(logs: DataFrame, keys: list[str], limit: int | None = None, name: str = "count") -> DataFrame:
    """Rows by keys, most first, ties by key."""
    out = logs.groupBy(*keys).agg(F.count("*").alias(name)).orderBy(F.desc(name), *keys)
    return out if limit is None else out.limit(limit)


def by_type(logs: DataFrame) -> DataFrame:
    return counted(logs, ["type"], 10)


def by_level(logs: DataFrame) -> DataFrame:
    return counted(logs, ["threat_level"])


def by_ip(logs: DataFrame) -> DataFrame:
    return counted(logs, ["ip_address", "country_name", "cloud_provider"], 10)


def by_country_top(logs: DataFrame) -> DataFrame:
    return counted(logs.where("country_name is not null"), ["country_name"], 10)


def by_cloud_top(logs: DataFrame) -> DataFrame:
    return counted(logs.where("cloud_provider is not null"), ["cloud_provider"], 50)


def by_date(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    return since(logs, as_of, days * 86400).groupBy(F.to_date("created_at").alias("date")).agg(F.count("*").alias("count")).orderBy("date")


def _with_ips(logs: DataFrame, keys: list[str]) -> DataFrame:
    return logs.where(f"{keys[0]} is not null").groupBy(*keys).agg(F.count("*").alias("count"), F.countDistinct("ip_address").alias("unique_ips"))


def by_country(logs: DataFrame, limit: int = 20) -> DataFrame:
    return _with_ips(logs, ["country_code", "country_name"]).orderBy(F.desc("count"), "country_code", "country_name").limit(limit)


def by_cloud_provider(logs: DataFrame) -> DataFrame:
    return _with_ips(logs, ["cloud_provider"]).orderBy(F.desc("count"), "cloud_provider")


def top_ips(logs: DataFrame, limit: int = 20) -> DataFrame:
    return counted(logs, ["ip_address", "country_name", "cloud_provider", "is_foreign"], checked("limit", limit, 1, 100), "threat_count")


def timeline(logs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    checked("days", days, 1, 365)
    return since(logs, as_of, days * 86400).groupBy(F.to_date("created_at").alias("date"), "threat_level").agg(F.count("*").alias("count")).orderBy("date", "threat_level")


def timeline_pivot(logs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """A row per date with a column per level; 0 for none."""
    return timeline(logs, as_of, days).groupBy("date").pivot("threat_level", list(LEVELS)).agg(F.sum("count")).na.fill(0).orderBy("date")


def country_share(logs: DataFrame) -> DataFrame:
    """by_country with each count as a percentage of the largest.  At most twenty rows meet in the window's one task."""
    rows = by_country(logs)
    most = rows.agg(F.greatest(F.max("count"), F.lit(1)).alias("most"))
    return rows.crossJoin(F.broadcast(most)).select("country_code", "country_name", "count", F.round(F.col("count") / F.col("most") * 100).cast("long").alias("percent"))


def ip_stats(logs: DataFrame, ip: str) -> DataFrame:
    own = logs.where(F.col("ip_address") == checked_ip(ip))
    types = own.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(5)
    top = types.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "type"))), lambda x: x["type"]), "|").alias("top_types"))
    base = own.agg(F.count("*").alias("total"), F.coalesce(F.sum((F.col("threat_level") == "high").cast("long")), F.lit(0)).alias("high"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return base.crossJoin(F.broadcast(top))  # a row each


def ip_recent(logs: DataFrame, ip: str, limit: int = 10) -> DataFrame:
    return logs.where(F.col("ip_address") == checked_ip(ip)).orderBy(F.desc("created_at"), "id").limit(limit)


def ip_levels(logs: DataFrame, ip: str) -> DataFrame:
    """One row with a count per level."""
    own = logs.where(F.col("ip_address") == checked_ip(ip))
    return own.agg(*(F.coalesce(F.sum((F.col("threat_level") == x).cast("long")), F.lit(0)).alias(x) for x in LEVELS))


def blocklist(logs: DataFrame, as_of: str, since_text: str = "24h", level: str | None = None, min_hits: int = 1) -> DataFrame:
    """(ip_address, hits, last_seen, threat_level): addresses with enough hits, and their worst level."""
    rows = since(logs, as_of, parse_since(since_text))
    rows = rows if level is None else rows.where(F.col("threat_level") == level)
    rank = F.max(F.when(F.col("threat_level") == "high", 3).when(F.col("threat_level") == "medium", 2).otherwise(1))
    out = rows.groupBy("ip_address").agg(F.count("*").alias("hits"), F.max("created_at").alias("last_seen"), rank.alias("rank")).where(F.col("hits") >= min_hits)
    return out.select("ip_address", "hits", "last_seen", F.when(F.col("rank") == 3, "high").when(F.col("rank") == 2, "medium").otherwise("low").alias("threat_level")).orderBy(F.desc("hits"), "ip_address")


def fail2ban(logs: DataFrame, as_of: str, since_text: str = "24h", level: str | None = None, min_hits: int = 1) -> DataFrame:
    return blocklist(logs, as_of, since_text, level, min_hits).drop("threat_level")


def cli_stats(logs: DataFrame, as_of: str) -> DataFrame:
    """(metric, value) of the totals, then of the five busiest addresses and types."""
    s = stats(logs, as_of)
    names = ["total", "high", "medium", "low", "unique_ips", "today", "last_hour"]
    totals = s.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("r")).select("r.*")
    top = lambda k: counted(logs, [k], 5, "value").select(F.concat(F.lit(f"{k}:"), k).alias("metric"), "value")
    return totals.union(top("ip_address")).union(top("type"))


def catalogue_use(catalogue: DataFrame, logs: DataFrame) -> DataFrame:
    """The rules with the log rows that bear their label (n_rows), and those of them logged at another level (n_other_level).

    Rows are counted by label and level first, so that what meets the rules does not grow with the log.
    """
    label = F.regexp_replace("type", r"^\[[^\]]*\]\s*", "")
    seen = logs.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col("threat_level") == x).alias(f"_{x}") for x in ("high", "medium", "low")))
    own = F.when(F.col("level") == "high", F.col("_high")).when(F.col("level") == "medium", F.col("_medium")).otherwise(F.col("_low"))
    rules = catalogue.join(seen, "label", "left").fillna(0, ["n_rows", "_high", "_medium", "_low"])
    return rules.select(*catalogue.columns, "n_rows", (F.col("n_rows") - own).alias("n_other_level"))
