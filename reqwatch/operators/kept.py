"""Changes of a kept log: a table of Parquet files by day, of which a change writes only the days that it touches.

A change first says which rows it alters; their days are read, altered, written to a scratch table, and then put in
place of the old ones.  A change that alters nothing writes nothing.  A run that dies amid the last step is repeated
from the log as it is: changes are the same when made twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import delete, scratch_dir
from .enrich import enriched, rules_from_marks

DAY = "day"


def write(rows: DataFrame, path: str) -> None:
    """A log's first writing, by the day of created_at; rows without a time have a part of their own."""
    rows.withColumn(DAY, F.to_date("created_at")).write.mode("overwrite").partitionBy(DAY).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path)


def _days(rows: DataFrame) -> list:
    """The days of rows; a log has one partition for each."""
    return [r[0] for r in rows.select(DAY).distinct().collect()]


def _on(days: list) -> Column:
    known = [d for d in days if d is not None]
    out = F.col(DAY).isin(known) if known else F.lit(False)
    return out | F.col(DAY).isNull() if None in days else out


def _put(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Puts rows in place of the days that they have."""
    root = scratch_dir(spark, "kept")
    rows.write.parquet(f"{root}/days")
    spark.read.schema(rows.schema).parquet(f"{root}/days").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(path)
    delete(spark, root)


def mark_false_positives(spark: SparkSession, path: str, marks: DataFrame, as_of: str) -> DataFrame:
    """Sets is_false_positive and updated_at of the marked ids that are not marked yet; their new exclusion rules."""
    ids = marks.select("id").distinct()
    fresh = read(spark, path).where("not coalesce(is_false_positive, false)").join(ids, "id", "left_semi")
    days, root = _days(fresh), scratch_dir(spark, "marks")
    rules_from_marks(fresh, ids).write.parquet(f"{root}/rules")
    if days:
        touched = read(spark, path).where(_on(days)).join(ids.withColumn("_marked", F.lit(True)), "id", "left")
        hit = F.coalesce("_marked", F.lit(False)) & ~F.coalesce("is_false_positive", F.lit(False))
        kind = touched.schema["updated_at"].dataType
        now = F.when(hit, F.to_timestamp(F.lit(as_of)).cast(kind)).otherwise(F.col("updated_at"))
        _put(spark, path, touched.withColumn("updated_at", now).withColumn("is_false_positive", hit | F.col("is_false_positive")).drop("_marked"))
    return spark.read.parquet(f"{root}/rules")


def enrich(spark: SparkSession, path: str, geo: DataFrame, home_country: str = "IN") -> list:
    """Fills the places of rows that have none yet, from geo; the days that were written."""
    log = read(spark, path)
    days = _days(log.where("country_code is null").join(geo.where("country_code is not null").select("ip_address"), "ip_address", "left_semi"))
    if days:
        _put(spark, path, enriched(log.where(_on(days)), geo, home_country).select(log.columns))
    return days


def purge(spark: SparkSession, path: str, as_of: str, days: int = 30) -> list:
    """Takes rows older than so many days out: whole days by their folders, and the day of the bound by its rows."""
    bound = F.unix_timestamp(F.to_timestamp(F.lit(as_of))) - days * 86400
    log = read(spark, path)
    old = F.unix_timestamp("created_at") < bound
    per = log.groupBy(DAY).agg(F.count_if(old).alias("old"), F.count("*").alias("n")).where("old > 0").collect()  # a row a day
    part = [r[DAY] for r in per if r.old < r.n]
    if part:
        _put(spark, path, log.where(_on(part) & ~F.coalesce(old, F.lit(False))))
    for r in per:
        if r.old == r.n:
            delete(spark, f"{path}/{DAY}={r[DAY]}")
    return [r[DAY] for r in per]
