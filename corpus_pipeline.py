"""The corpus pipeline: language ID, line dedup, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and reads again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.llm.decontaminate import decontamination_stage
from webloom.llm.langid import language_stage
from webloom.llm.line_dedup import line_stage
from webloom.llm.near_dup import near_dup_stage
from webloom.llm.packing import packing_stage
from webloom.llm.work import Workspace, tidied

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

#: Language ID and near-duplicates are not expressible in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table: the batches of what is kept."""
    ws = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with tidied():
            out = ws.save(stage(spark, docs, sf_dir), name)
        if k:
            ws.drop(docs)
        docs = out
    return docs
