"""Health check: schemas, settings, shadowed rules and the folder that streams keep their state in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import patterns
from ..sources import schema


def health(spark: SparkSession, logs: DataFrame | None = None, rules: DataFrame | None = None, config: EngineConfig | None = None, settings: dict | None = None, values: bool = False) -> DataFrame:
    """(status, title, fix).  settings: a user's own settings by name, held against the engine's for drift.

    values: whether to read the log as well and count rows without an address, type or time, of an unknown level or with
    a score beyond 0 to 100.
    """
    config, out = config or EngineConfig(), []
    out.append(("ok", "detection is on", "") if config.enabled else ("warning", "detection is off", "set enabled"))
    for df, want, what in ((logs, schema.THREAT_LOGS, "threat_logs"), (rules, schema.EXCLUSION_RULES, "exclusion rules")):
        lack = ["table"] if df is None else schema.missing(df, want)
        out.append(("failure", f"{what} lacks {', '.join(lack)}", "migrate the table") if lack else ("ok", f"{what} has its schema", ""))
    if values and logs is not None and not schema.missing(logs, schema.THREAT_LOGS):
        sound = F.expr("ip_address is not null and type is not null and created_at is not null and threat_level in ('high', 'medium', 'low') and confidence_score between 0 and 100")
        n, odd = logs.agg(F.count(F.lit(1)), F.count_if(~F.coalesce(sound, F.lit(False)))).first()
        out.append(("warning", f"{odd} of {n} log rows hold odd values", "mend or purge them") if odd else ("ok", f"values of {n} log rows are sound", ""))
    known = set(EngineConfig.__dataclass_fields__)
    for name in sorted(set(settings or known) ^ known):
        out.append(("warning", f"setting {name} is {'unknown' if name not in known else 'missing'}", "bring the settings up to date"))
    built_in = {r.label: (r.expression, r.flags) for r in patterns.default_rules()}
    found, said = patterns.custom_rules(config.custom_rules, config.validators)
    out += [("warning", f"custom rule {what}", "mend the rule") for what in said]
    for r in found:
        if r.label in built_in and (r.expression, r.flags) != built_in[r.label]:  # the same expression shadows nothing
            out.append(("warning", f"custom rule shadows {r.label}", "rename it"))
    if spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.master", "local").startswith("local"):
        out.append(("ok", "streams have a shared folder for their state", ""))
    else:
        out.append(("warning", "streams have no shared folder for their state", "set spark.checkpoint.dir"))
    return spark.createDataFrame(out, "status string, title string, fix string")


def failed(report: DataFrame) -> bool:
    return not report.where("status = 'failure'").isEmpty()
