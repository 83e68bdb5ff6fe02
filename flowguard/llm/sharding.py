"""Proportional stratified interleaving: every shard carries the mixture of the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import key_of, plain_names, small_join
from flowguard.operators.distributed import running_totals
from flowguard.session import cut_lineage

#: Rows that one task sorts.
ROWS_PER_TASK = 1_000_000


def assign_shards(rows: DataFrame, shards: int, stratum: str = "source", identity: tuple[str, ...] = ("doc_id",),
                  seed: str = "shards", rows_per_task: int = ROWS_PER_TASK, slices: int | None = None) -> DataFrame:
    """Adds `shard` (0 to shards - 1) and `slot` (gapless from 0 within the shard) to every row.

    Rows are shuffled by a seeded hash of their identity and ranked within their stratum; the table is ordered by the
    fractional rank (2 * rank - 1) / (2 * rows of the stratum) and cut into shards whose row counts differ by at most one.
    Each stratum is spread evenly, so any shard has its share of every stratum but for rounding at its two ends.

    Null strata form one stratum. Equal identities are ordered by their remaining columns; rows that agree in all
    columns are interchangeable. An empty table gives an empty result. Columns named `shard` or `slot` are replaced.
    Neither a stratum nor an identity meets in one task: ranks are running counts over slices of the sort order, whose
    bounds are chosen by rows (about `rows_per_task` each, or `slices` of them), and equal rows are parted by a number. Rows are written between the steps, so they should
    be slim (no texts).
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    rows, names, of = plain_names(rows, ["shard", "slot"])
    order = F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(of[c]).cast("string"), F.lit("")) for c in identity]))
    packed = cut_lineage(rows.select(F.struct(*rows.columns).alias("row"), key_of(F.col(of[stratum])).alias("stratum"), order.alias("order"),
                                     F.monotonically_increasing_id().alias("tie")))
    total = packed.count()
    rows_per_task = max(1, -(-total // slices)) if slices else rows_per_task
    ranked = running_totals(packed, ["stratum"], ["order", "row", "tie"], {"rank": F.lit(1)}, rows_per_task)
    sizes = packed.groupBy("stratum").agg(F.count("*").alias("n"))
    odd = 2 * F.col("rank") - 1
    placed = small_join(ranked, sizes, ["stratum"], ["tie"]).withColumn("fraction", odd / (2 * F.col("n")))
    placed = running_totals(cut_lineage(placed.select("row", "order", "tie", "fraction")), [], ["fraction", "order", "row", "tie"], {"upto": F.lit(1)}, rows_per_task)
    return (placed.withColumn("place", F.col("upto") - 1)
            .withColumn("shard", F.expr(f"place * {shards} div {max(1, total)}").cast("int"))
            .withColumn("slot", F.expr(f"place - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}"))
            .select("row.*", "shard", "slot").toDF(*names, "shard", "slot"))
