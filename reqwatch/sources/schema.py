"""Table schemas, and the check that a table has them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L, _B, _I, _TS = T.StringType(), T.LongType(), T.BooleanType(), T.IntegerType(), T.TimestampType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


REQUESTS = _struct(request_id=_L, ts=_TS, ip_address=_S, method=_S, path=_S, query_string=_S, content_type=_S, content_length=_L, body=_S, headers=T.MapType(_S, T.ArrayType(_S)), user_agent=_S, user_id=_L, url=_S)
THREAT_LOGS = _struct(
    id=_L, ip_address=_S, url=_S, user_agent=_S, type=_S, payload=_S, threat_level=_S, confidence_score=_I, confidence_label=_S, is_false_positive=_B, action_taken=_S, user_id=_L,
    country_code=_S, country_name=_S, city=_S, isp=_S, cloud_provider=_S, is_foreign=_B, is_cloud_ip=_B, created_at=_TS, updated_at=_TS,
)
EXCLUSION_RULES = _struct(id=_L, pattern_label=_S, path_pattern=_S, source_context=_S, created_from_threat_id=_L, created_by_user_id=_L, reason=_S, is_active=_B, created_at=_TS, updated_at=_TS)
DEFAULTS = {"threat_level": "medium", "confidence_score": 0, "confidence_label": "low", "is_false_positive": False, "action_taken": "logged", "is_foreign": False, "is_cloud_ip": False}


def missing(df: DataFrame, schema: T.StructType) -> list[str]:
    """Fields that df lacks or has with another type."""
    own = {f.name: f.dataType for f in df.schema}
    return [f.name for f in schema if own.get(f.name) != f.dataType]


def require(df: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    if lack := missing(df, schema):
        raise ValueError(f"{what} lacks {', '.join(lack)}")
    return df


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def completed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the fields of schema alone, in their types; what df lacks has its default, or is null."""
    given = lambda f: F.col(f.name) if f.name in df.columns else F.lit(DEFAULTS.get(f.name))
    return df.select(*(given(f).cast(f.dataType).alias(f.name) for f in schema))
