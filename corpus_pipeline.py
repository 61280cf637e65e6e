"""The corpus pipeline: each stage takes what its predecessor kept, as Parquet, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqwatch.llm.common import Scratch, fresh_name, table, with_row_key
from reqwatch.llm.minhash import near_duplicates
from reqwatch.llm.mixing import mixing_stage
from reqwatch.llm.packing import packing_stage
from reqwatch.llm.quality import quality_filter
from reqwatch.llm.secrets import redaction_stage


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: that of the smallest id, then of the smallest text hash, then any one.

    Rows are told apart by a written row key, so rows that repeat an id, or have none, are documents of their own; one
    without an id stays only in a group where none has one.  Rows of empty or null texts are no copies of each other.
    Other columns, whatever their names, pass untouched; an empty table gives an empty one.
    """
    scratch, near = Scratch(spark, "dropped"), Scratch(spark, "near")
    key = fresh_name(docs.columns, "row_key")
    keyed = scratch.save(with_row_key(docs, key), "keyed")
    slim = keyed.select(F.col(key).alias("row"), "doc_id", "text")
    groups = near_duplicates(slim, id_col="row", scratch=near).select(F.col("doc_id").alias("row"), "component_id")
    groups = scratch.save(groups, "groups")
    near.drop()
    many = groups.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id")
    ids = slim.select("row", F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("tie"))
    members = scratch.save(groups.join(many, "component_id").join(ids, "row"), "members")
    best = members.groupBy("component_id").agg(F.min(F.struct("no_id", "doc_id", "tie", "row")).alias("best")).select(F.col("best.row").alias("row"))
    dropped = scratch.save(members.join(best, "row", "left_anti").select(F.col("row").alias(key)), "ids")
    scratch.drop("groups", "members")
    return keyed.join(dropped, key, "left_anti").select(*docs.columns)


STAGES = [
    ("quality_rules", quality_filter),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redaction_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: Near-duplicate components and trained spans have no plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            if k:
                scratch.drop(STAGES[k - 1][0])
    return docs
