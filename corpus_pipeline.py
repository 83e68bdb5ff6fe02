"""The corpus pipeline: five stages, each one of the operators of `flowguard.llm`.

Every stage but the last returns the columns it got. Rows it decides on keep all their values; names that a stage adds
inside never clash with columns of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.llm import decontaminate, mixing, quality, sharding, simhash
from flowguard.llm.common import attach, table
from flowguard.session import cut_lineage

SHARDS = 24
_WORD = r"[^\x20\x09-\x0D]+"


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table under names of its own (c0, c1, ...), and the name of its text."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), f"c{docs.columns.index('text')}"


def _identity(docs: DataFrame) -> dict[str, Column]:
    return {"doc_id": F.col("doc_id"), "source": F.col("source"), "digest": F.xxhash64(F.col("text"))}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    model = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    rows, text = _numbered(docs)
    judged = quality.judge(rows, model, text, tuple(rows.columns))
    return judged.where("kept").select(*rows.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of every group of SimHash near-duplicates."""
    return simhash.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    rows, text = _numbered(docs)
    found = decontaminate.find(rows, table(spark, sf_dir, "benchmark"), text, tuple(rows.columns))
    hit = decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))
    return found.where(~hit).select(*rows.columns).toDF(*docs.columns)


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times."""
    identity = _identity(docs)
    words = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    rows = cut_lineage(docs.select(*[v.alias(k) for k, v in identity.items()], words.alias("size")))
    return mixing.repeat_rows(docs, mixing.mix(rows, identity=("doc_id", "digest")), identity)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with `shard` and `slot`; columns of those names are replaced."""
    docs = docs.drop("shard", "slot")
    identity = _identity(docs)
    rows = docs.select(*[v.alias(k) for k, v in identity.items()])
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy(*identity).orderBy(*identity)))
    placed = sharding.assign_shards(rows, SHARDS, identity=("doc_id", "digest", "copy"))
    return attach(docs, placed, identity, ["shard", "slot"]).select("row.*", "shard", "slot")


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", benchmark_free),
          ("mixing sources to target weights", target_mix), ("sharding", shards)]
#: The first stage's classifier has no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = cut_lineage(docs)
    return docs
