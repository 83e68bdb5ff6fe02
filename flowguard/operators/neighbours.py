"""Mutual information between numeric features and a class by the distances to nearest neighbours (FE-13)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowguard.functions.numbers import quoted
from flowguard.operators.distributed import running_totals
from flowguard.session import cut_lineage

# Minus Euler's constant plus harmonic numbers, the digamma function at 1 to 9.
DIGAMMA = [-0.5772156649015329, 0.42278433509846713, 0.9227843350984671, 1.2561176684318005, 1.5061176684318005, 1.7061176684318005, 1.872784335098467,
           2.0156414779556, 2.1406414779556]


def digamma(n: Column) -> Column:
    """At whole numbers: a table, and from ten on the asymptotic series."""
    x = n.cast("double")
    series = F.log(x) - 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    return F.when(n < 10, F.get(F.array(*[F.lit(d) for d in DIGAMMA]), (n - 1).cast("int"))).otherwise(series)


def kth_distance(values: np.ndarray, k: int) -> np.ndarray:
    """Distance of each of the sorted values to its k-th nearest other one; infinite where there are fewer."""
    n, best = len(values), np.full(len(values), np.inf)
    for below in range(k + 1):
        above = k - below
        left, right = np.full(n, np.inf), np.full(n, np.inf)
        if below < n:
            left[below:] = values[below:] - values[:n - below]
        if above < n:
            right[:n - above] = values[above:] - values[:n - above]
        best = np.minimum(best, np.maximum(left, right))
    return best


def neighbour_information(df: DataFrame, columns: list[str], label: str, neighbours: int = 3) -> DataFrame:
    """`feature`, `mi_score`: Ross's estimate between each feature and the class, over rows where the feature is finite.

    Within its class a value has a distance to its k-th nearest value (k at most the class size less one; classes of one
    row are left out); all rows nearer than that are counted, the row itself included, or the equal ones where the
    distance is zero. The score is psi(rows) + mean psi(k) - mean psi(class size) - mean psi(count), at least 0. No noise is
    added to equal values, so the result repeats. Rows without a class are left out.

    Equal values of a class are one row with a count. The sort order is cut into ranges; a range needs only the k values
    next to it on either side, which are few enough to be sent to all. The counts are differences of running totals.
    """
    cells = df.select(F.col(label).cast("string").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(i).alias("i"), (quoted(c).cast("double") + F.lit(0.0)).alias("v")) for i, c in enumerate(columns)]))).where(
        "y IS NOT NULL AND abs(v) < double('infinity')")
    counted = cells.groupBy("i", "y", "v").agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(counted.repartitionByRange(parts, "i", "y", "v").sortWithinPartitions("i", "y", "v").withColumn("slice", F.spark_partition_id()))
    sizes = {(r["i"], r["y"]): r["n"] for r in ranged.groupBy("i", "y").agg(F.sum("n").alias("n")).collect()}  # one row per feature and class
    edges = _edges(ranged, neighbours)
    spread = ranged.mapInArrow(_radii(edges, sizes, neighbours), "i int, y string, v double, n bigint, radius double")
    spread = cut_lineage(spread)
    near = F.col("radius") > 0
    # Order at equal places: values, then who counts what is not above. Sides: 1 adds what is below the upper bound.
    asked = spread.select("i", F.inline(F.array(
        F.struct(F.col("v").alias("x"), F.lit(1).alias("kind"), "n", F.lit(0).alias("side"), "y", "v"),
        F.struct((F.col("v") + F.col("radius")).alias("x"), F.when(near, 0).otherwise(2).alias("kind"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("side"), "y", "v"),
        F.struct((F.col("v") - F.col("radius")).alias("x"), F.when(near, 2).otherwise(0).alias("kind"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).alias("side"), "y", "v"))))
    upto = running_totals(asked, ["i"], ["x", "kind", "y", "v", "side"], {"upto": F.col("n")}).where("side <> 0")
    inside = upto.groupBy("i", "y", "v").agg(F.sum(F.col("upto") * F.col("side")).alias("m"))
    scored = inside.join(spread, ["i", "y", "v"]).groupBy("i", "y").agg(F.sum(F.col("n") * digamma(F.col("m"))).alias("psi"), F.sum("n").alias("rows"))
    k = F.least(F.lit(neighbours).cast("bigint"), F.col("rows") - 1)
    total = scored.groupBy("i").agg(F.sum("rows").alias("rows"), F.sum("psi").alias("inner"), F.sum(F.col("rows") * digamma(k)).alias("k"),
                                    F.sum(F.col("rows") * digamma(F.col("rows"))).alias("classes"))
    score = digamma(F.col("rows")) + (F.col("k") - F.col("classes") - F.col("inner")) / F.col("rows")
    names = F.array(*[F.lit(c) for c in columns])
    listed = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("i"))
    return listed.join(F.broadcast(total), "i", "left").select(F.get(names, F.col("i")).alias("feature"), F.coalesce(F.greatest(F.lit(0.0), score), F.lit(0.0)).alias("mi_score"))


def _edges(ranged: DataFrame, k: int) -> dict[tuple[int, str], list[tuple[int, np.ndarray, np.ndarray]]]:
    """Per feature and class the first and last values of each slice, with counts; a slice holds few features and classes."""
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, values, n in _groups(batches):
            for first, some in ((True, slice(0, k)), (False, slice(max(0, len(values) - k), len(values)))):
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([part], pa.int32()), pa.array([first]),
                                                  pa.array([values[some]]), pa.array([n[some]])], names=["i", "y", "slice", "first", "values", "n"])
    found: dict = {}
    for r in ranged.mapInArrow(ends, "i int, y string, slice int, first boolean, values array<double>, n array<bigint>").collect():
        found.setdefault((r["i"], r["y"]), []).append((r["slice"], r["first"], np.array(r["values"]), np.array(r["n"])))
    return found


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str], int, np.ndarray, np.ndarray]]:
    """(feature, class), slice, sorted values and counts of one slice's sorted rows."""
    held = list(batches)  # one slice
    if not sum(map(len, held)):
        return
    table = pa.Table.from_batches(held).to_pandas()
    for (part, i, y), rows in table.groupby(["slice", "i", "y"], sort=False):
        order = np.argsort(rows["v"].to_numpy(), kind="stable")
        yield (int(i), y), int(part), rows["v"].to_numpy()[order], rows["n"].to_numpy()[order]


def _radii(edges: dict, sizes: dict, neighbours: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, part, values, n in _groups(batches):
            k = min(neighbours, sizes[key] - 1)
            if k < 1:
                continue
            beside = []
            for before in (True, False):
                near = sorted((e for e in edges[key] if (e[0] < part if before else e[0] > part) and e[1] is not before), key=lambda e: e[0], reverse=before)
                v, c, have = [], [], 0
                for _, _, some, counts in near:
                    v.append(some)
                    c.append(counts)
                    have += len(some)
                    if have >= k:
                        break
                order = slice(None, None, -1) if before else slice(None)
                beside.append((np.concatenate(v[order]) if v else np.zeros(0), np.concatenate(c[order]) if c else np.zeros(0, np.int64)))
            every = np.concatenate([beside[0][0], values, beside[1][0]])
            copies = np.minimum(np.concatenate([beside[0][1], n, beside[1][1]]), k + 1).astype(np.int64)
            spread = np.repeat(every, copies)
            first = np.concatenate([[0], copies.cumsum()[:-1]])[len(beside[0][0]):len(beside[0][0]) + len(values)]
            radius = kth_distance(spread, k)[first]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), key[0], np.int32)), pa.array([key[1]] * len(values)), pa.array(values), pa.array(n), pa.array(radius)],
                                             names=["i", "y", "v", "n", "radius"])
    return measure
