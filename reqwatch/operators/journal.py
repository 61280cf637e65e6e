"""From requests to the log: detection, floods, and each type of an address once per window, as one job or one stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .detect import admitted, log_rows
from .suppress import first_in_window, flood_rows

KEYS = ["ip_address", "type"]
#: What of a request stands in its log rows, and tells rows of one second apart.
COLUMNS = ["request_id", "created_at", "ip_address", "url", "user_agent", "type", "payload", "threat_level", "confidence_score", "confidence_label", "is_false_positive", "action_taken", "user_id", "pos"]


def _floods(requests: DataFrame, config: EngineConfig, environment: str) -> DataFrame:
    seen = admitted(requests, config, environment).select("request_id", F.col("ts").alias("created_at"), "ip_address", "url", "user_agent", "user_id")
    rows = flood_rows(seen, config.flood_threshold, config.flood_window_s, config.dedup_window_s, ("request_id",))
    return rows.withColumns({"request_id": F.lit(None).cast("long"), "is_false_positive": F.lit(False), "action_taken": F.lit("logged"), "pos": F.lit(-1)}).select(COLUMNS)


def request_log(requests: DataFrame, config: EngineConfig | None = None, rules: DataFrame | None = None, source: str = "middleware", environment: str = "production") -> DataFrame:
    """The rows that requests leave in the log: those of floods, and of each address and type the first in its window.

    Of rows of one second the first by time and request stands.  A request's types are suppressed each for itself, so of
    a request with several types some may be logged and some not.
    """
    config = config or EngineConfig()
    rows = log_rows(requests, config, rules, source, environment).select(COLUMNS)
    kept = first_in_window(rows, KEYS, "created_at", config.dedup_window_s, ("created_at", "request_id", "pos"))
    return kept.unionByName(_floods(requests, config, environment))


def request_log_stream(requests: DataFrame, config: EngineConfig | None = None, rules: DataFrame | None = None, watermark: str = "10 minutes", source: str = "middleware", environment: str = "production") -> DataFrame:
    """The same of a stream of requests, floods apart (streaming.state.flood_alerts): what is first in its window by event time."""
    from ..streaming.state import deduplicated

    config = config or EngineConfig()
    rows = log_rows(requests, config, rules, source, environment).select(COLUMNS)
    return deduplicated(rows, config.dedup_window_s, watermark, ("request_id", "pos"))


def threat_events(rows: DataFrame) -> DataFrame:
    """What listeners hear of each row kept: its address, level and type, and the row itself."""
    return rows.select("ip_address", F.col("threat_level").alias("level"), "type", F.struct(*rows.columns).alias("row"))
