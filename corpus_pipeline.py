"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagwell.llm.lines import dedup_docs
from lagwell.llm.near import keep_first
from lagwell.llm.packing import pack_docs
from lagwell.llm.privacy import redact_docs
from lagwell.llm.quality import keep_good
from lagwell.plans.lineage import materialize

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality rules", keep_good),
    ("line dedup", dedup_docs),
    ("near dedup", keep_first),
    ("personal data", redact_docs),
    ("packing", pack_docs),
]

#: The stages run fuzzy joins, message passing and greedy packing, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``, each result written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
