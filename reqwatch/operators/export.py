"""What leaves the engine: CSV rows, block lists, text lines and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reports import threats

CSV_LIMIT = 10_000


def formula_safe(value: Column) -> Column:
    """A cell that a spreadsheet does not take for a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def csv_rows(logs: DataFrame, keyword: str | None = None, level: str | None = None) -> DataFrame:
    """The export's eleven columns, newest first, at most CSV_LIMIT rows."""
    rows = threats(logs, keyword=keyword or None, level=level).orderBy(F.desc("created_at"), "id").limit(CSV_LIMIT)
    cell = lambda c: formula_safe(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(
        F.col("id").alias("ID"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("Time"), cell("ip_address").alias("IP Address"), cell("url").alias("URL"), cell("type").alias("Type"), cell("threat_level").alias("Level"),
        F.concat(F.col("confidence_score").cast("string"), F.lit("%")).alias("Confidence"), F.when(F.col("is_false_positive"), "Yes").otherwise("No").alias("False Positive"), cell("action_taken").alias("Action"), cell("country_name").alias("Country"), cell("cloud_provider").alias("Cloud Provider"),
    )


def blocklist_lines(rows: DataFrame, form: str = "plain", jail: str = "reqwatch") -> DataFrame:
    """(line) for each row of a block list, in the form plain, nginx, apache, csv or fail2ban."""
    ip, hits = F.col("ip_address"), F.col("hits").cast("string")
    last = F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss")
    forms = {
        "plain": ip, "nginx": F.concat(F.lit("deny "), ip, F.lit(";  # hits: "), hits), "apache": F.concat(F.lit("Deny from "), ip, F.lit("  # hits: "), hits),
        "csv": F.concat_ws(",", ip, hits, last, F.col("threat_level") if "threat_level" in rows.columns else F.lit("")),
        "fail2ban": F.concat(F.lit(f"fail2ban-client set {jail} banip "), ip, F.lit("  # hits: "), hits, F.lit(", last: "), last),
    }
    if form not in forms:
        raise ValueError(f"form must be one of {sorted(forms)}")
    return rows.select(forms[form].alias("line"))


def defanged(url: Column) -> Column:
    """A url that no client makes a link."""
    return F.replace(F.regexp_replace(url, "(?i)^https?://", "hxxp://"), F.lit("."), F.lit("[.]"))


def log_line(level: Column, type_: Column, ip: Column, url: Column, score: Column) -> Column:
    text = F.concat(F.lit("["), level, F.lit("] Threat Detected: "), type_, F.lit(" from "), ip, F.lit(" ("), url, F.lit(") [confidence: "), score.cast("string"), F.lit("%]"))
    return F.translate(text, "\n\r\t", "   ")


def alerts(rows: DataFrame) -> DataFrame:
    """One alert for each request: its first row's address, defanged url, type, level and action."""
    first = rows.groupBy("request_id").agg(F.min_by(F.struct("ip_address", "url", "type", "threat_level", "action_taken"), "pos").alias("r")).select("request_id", "r.*")
    return first.withColumn("url", defanged(F.col("url")))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
