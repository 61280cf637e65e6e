"""Geo and cloud enrichment, retention, false positives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.network import looked_up
from .reports import since


def cloud_provider(isp: Column, org: Column, ip: Column) -> Column:
    """The first keyword's provider in the names, else the first prefix's, else null."""
    names = F.lower(F.concat_ws(" ", isp, org))
    words = [F.when(names.contains(k.lower()), p) for k, p in fixed.CLOUD_KEYWORDS]
    starts = [F.when(ip.startswith(k), p) for k, p in fixed.CLOUD_PREFIXES]
    return F.coalesce(*words, *starts)


def candidates(logs: DataFrame, as_of: str, days: int = 7, force: bool = False) -> DataFrame:
    """Addresses that still want a place."""
    rows = since(logs, as_of, days * 86400)
    rows = rows if force else rows.where("country_code is null")
    return rows.select("ip_address").distinct()


def lookups(logs: DataFrame, as_of: str, days: int = 7, force: bool = False) -> DataFrame:
    """Candidates that a geo service is asked for: private, reserved and odd addresses are skipped."""
    return candidates(logs, as_of, days, force).where(looked_up(F.col("ip_address")))


def enriched(logs: DataFrame, geo: DataFrame, home_country: str = "IN", force: bool = False) -> DataFrame:
    """logs with the geo columns of geo (ip_address, country_code, country_name, city, isp, org).

    Known places stay unless force is set.  The join side is left to the optimiser, which knows geo's size.
    """
    names = ["country_code", "country_name", "city", "isp"]
    found = geo.select("ip_address", *(F.col(c).alias(f"_{c}") for c in names), F.col("org").alias("_org"))
    base = logs.withColumns({c: F.lit(None).cast("string") for c in [*names, "cloud_provider"] if c not in logs.columns})
    out = base.join(found, "ip_address", "left")
    fresh = F.lit(True) if force else F.col("country_code").isNull()
    hit = F.col("_country_code").isNotNull() & fresh
    cloud = F.when(hit, cloud_provider(F.col("_isp"), F.col("_org"), F.col("ip_address"))).otherwise(F.col("cloud_provider"))
    out = out.withColumn("_cloud", cloud).withColumns({c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in names}).withColumn("cloud_provider", F.col("_cloud"))
    foreign = F.coalesce(F.col("country_code") != home_country, F.lit(False))
    return out.withColumn("is_foreign", foreign).withColumn("is_cloud_ip", F.col("cloud_provider").isNotNull()).drop("_cloud", "_org", *(f"_{c}" for c in names))


def purged(logs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Rows that retention keeps."""
    return since(logs, as_of, days * 86400)


def purged_rules(rules: DataFrame, kept_logs: DataFrame) -> DataFrame:
    """Rules less those made from a row that is gone."""
    gone = rules.where("created_from_threat_id is not null").join(kept_logs.select(F.col("id").alias("created_from_threat_id")), "created_from_threat_id", "left_anti")
    return rules.join(gone.select("id"), "id", "left_anti")


def marked_false_positives(logs: DataFrame, marks: DataFrame) -> DataFrame:
    """logs with is_false_positive set for the marked ids (id)."""
    m = marks.select("id").distinct().withColumn("_marked", F.lit(True))
    return logs.join(m, "id", "left").withColumn("is_false_positive", F.coalesce("_marked", "is_false_positive")).drop("_marked")


def rules_from_marks(logs: DataFrame, marks: DataFrame) -> DataFrame:
    """An active exclusion rule for each marked row: its label without the tag, and its url's path."""
    own = logs.join(marks.select("id").distinct(), "id", "left_semi")
    path = F.nullif(F.ltrim(F.coalesce(F.try_parse_url(F.col("url"), F.lit("PATH")), F.lit("")), F.lit("/")), F.lit(""))
    return own.select(F.regexp_replace("type", r"^\[[^\]]*\]\s*", "").alias("pattern_label"), path.alias("path_pattern"), F.col("id").alias("created_from_threat_id"), F.lit(True).alias("is_active"))


def listed_rules(rules: DataFrame, active_only: bool = False) -> DataFrame:
    """Rules, newest first."""
    return (rules.where("is_active") if active_only else rules).orderBy(F.desc("id"))


def without_rule(rules: DataFrame, id_: int) -> DataFrame:
    return rules.where(F.col("id") != id_)
