"""Encoding, splitting, scaling, selection and resampling of feature tables (FE-01 to FE-20, AGG-11)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.functions.numbers import quoted, text_columns
from flowguard.operators.distributed import count_below, exact_percentiles, group_counts, pick_lowest, pick_several
from flowguard.operators.profiling import duplicate_columns, pearson_matrix
from flowguard.session import cut_lineage

# ---- encoding ---------------------------------------------------------------------------------


def categories(df: DataFrame, label: str | None = None, most: int = 1000) -> dict[str, list[str]]:
    """FE-01: the values of each text column, sorted; refuses a column with too many values to one-hot."""
    names = text_columns(df.schema, {label} if label else set())
    if not names:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("c"), quoted(c).alias("v")) for c in names])
    found = df.select(F.inline(cells)).where("v IS NOT NULL").distinct().limit(most * len(names) + 1).collect()
    result: dict[str, list[str]] = {c: [] for c in names}
    for c, v in found:
        result[c].append(v)
    wide = [c for c, values in result.items() if len(values) > most]
    if wide:
        raise ValueError(f"columns {wide} have more than {most} values")
    return {c: sorted(values) for c, values in result.items()}


def one_hot(df: DataFrame, values: dict[str, list[str]]) -> DataFrame:
    """FE-01: one column per known value; an unknown value is all zeros, the source column goes."""
    kept = [quoted(c) for c in df.columns if c not in values]
    made = [F.when(quoted(c) == v, 1.0).otherwise(0.0).alias(f"{c}_{v}") for c, known in values.items() for v in known]
    return df.select(*kept, *made)


def label_indexer(df: DataFrame, label: str, output: str = "label_index") -> StringIndexerModel:
    """FE-02: classes in sorted order; an unseen label is an error."""
    return StringIndexer(inputCol=label, outputCol=output, stringOrderType="alphabetAsc", handleInvalid="error").fit(df)


# ---- splitting and sampling --------------------------------------------------------------------


def split_quotas(counts: dict, share: float) -> dict:
    return {c: math.floor(share * n + 0.5) for c, n in counts.items()}


def sample_quotas(counts: dict, size: int) -> dict:
    """FE-04: proportional quotas by largest remainder, name as tie-break; they add up to `size`."""
    total = sum(counts.values())
    if size >= total:
        return dict(counts)
    exact = {c: size * n / total for c, n in counts.items()}
    quotas = {c: math.floor(x) for c, x in exact.items()}
    order = sorted(counts, key=lambda c: (quotas[c] - exact[c], str(c)))
    for c in order[: size - sum(quotas.values())]:
        quotas[c] += 1
    return quotas


def stratified_split(df: DataFrame, label: str, mixed: Column, ties: list[str], test_share: float = 0.2, max_groups: int = 10_000, **limits) -> DataFrame:
    """FE-03: adds `split` = train/test. Stratified unless there is one class or a class of one row."""
    counts = group_counts(df, label, max_groups)
    group = label
    if len(counts) < 2 or min(counts.values()) < 2:
        df = df.withColumn("_all", F.lit("all"))
        counts, group = {"all": sum(counts.values())}, "_all"
    marked = pick_lowest(df, group, split_quotas(counts, test_share), mixed, ties, "_test", sum(counts.values()), **limits)
    return marked.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test", "_all")


def stratified_sample(df: DataFrame, label: str, size: int, mixed: Column, ties: list[str], max_groups: int = 10_000, **limits) -> DataFrame:
    """FE-04: exactly `size` rows with the class shares of the table."""
    counts = group_counts(df, label, max_groups)
    return pick_lowest(df, label, sample_quotas(counts, size), mixed, ties, "_keep", sum(counts.values()), **limits).where("_keep").drop("_keep")


def stratified_samples(df: DataFrame, label: str, sizes: dict[str, int], mixed: Column, ties: list[str], max_groups: int = 10_000, **limits) -> DataFrame:
    """FE-04 for several sizes at once: every row with a mark per size, true where `stratified_sample` of that size keeps it."""
    counts = group_counts(df, label, max_groups)
    return pick_several(df, label, {name: sample_quotas(counts, size) for name, size in sizes.items()}, mixed, ties, sum(counts.values()), **limits)


def undersample(df: DataFrame, label: str, mixed: Column, ties: list[str], max_groups: int = 10_000, **limits) -> DataFrame:
    """FE-19: every class cut to the size of the smallest."""
    counts = group_counts(df, label, max_groups)
    least = min(counts.values())
    return pick_lowest(df, label, dict.fromkeys(counts, least), mixed, ties, "_keep", sum(counts.values()), **limits).where("_keep").drop("_keep")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """AGG-11: n / (classes * n_c); the window runs over one row per class."""
    counted = df.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("rows"))
    everything = Window.partitionBy(F.lit(1))
    return counted.select("class", "rows", (
        F.sum("rows").over(everything) / (F.count("*").over(everything) * F.col("rows"))).alias("weight"))


def with_sample_weight(df: DataFrame, label: str, output: str = "weight", max_groups: int = 10_000) -> DataFrame:
    """JOIN-05: the class weight on every row. There is one weight per class, so the lookup is a literal map."""
    counts = group_counts(df, label, max_groups)
    total = sum(counts.values())
    pairs = [F.lit(x) for c, n in counts.items() if c is not None for x in (c, total / (len(counts) * n))]
    return df.withColumn(output, F.try_element_at(F.create_map(*pairs), F.col(label)))


def balance_table(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    """FE-20: class counts before and after resampling."""
    left = before.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("before_rows"))
    right = after.groupBy(F.col(label).alias("class")).agg(F.count("*").alias("after_rows"))
    return left.join(right, "class", "left").select("class", "before_rows", F.coalesce("after_rows", F.lit(0).cast("bigint")).alias("after_rows"))


# ---- scaling -----------------------------------------------------------------------------------


def fit_scaler(df: DataFrame, columns: list[str], method: str = "standard") -> dict[str, tuple[float, float]]:
    """FE-05 to FE-07: (centre, scale) per column; a zero scale counts as 1."""
    if method == "robust":
        cuts = exact_percentiles(df, columns, [0.25, 0.5, 0.75])
        found = {c: (mid, hi - lo) for c, (lo, mid, hi) in cuts.items() if mid is not None}
    elif method in ("standard", "minmax"):
        centre, spread = (F.avg, F.stddev_pop) if method == "standard" else (F.min, lambda c: F.max(c) - F.min(c))
        row = df.agg(*[F.struct(centre(quoted(c).cast("double")).alias("a"), spread(quoted(c).cast("double")).alias("b")).alias(f"x{i}") for i, c in enumerate(columns)]).first()
        found = {c: (row[f"x{i}"]["a"], row[f"x{i}"]["b"]) for i, c in enumerate(columns) if row[f"x{i}"]["a"] is not None}
    else:
        raise ValueError(f"unknown scaling method {method!r}")
    return {c: (*found.get(c, (0.0, 1.0))[:1], found.get(c, (0.0, 1.0))[1] or 1.0) for c in columns}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[
        ((quoted(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias(c) if c in scaler else quoted(c) for c in df.columns])


def unscale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    """FE-08."""
    return df.select(*[
        (quoted(c) * F.lit(scaler[c][1]) + F.lit(scaler[c][0])).alias(c) if c in scaler else quoted(c) for c in df.columns])


# ---- selection ---------------------------------------------------------------------------------


def variance_filter(df: DataFrame, columns: list[str], threshold: float = 1e-4) -> tuple[list[str], list[str]]:
    """FE-09: constant columns, then columns of low variance."""
    row = df.agg(*[F.var_samp(quoted(c).cast("double")).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    variances = {c: row[f"v{i}"] for i, c in enumerate(columns)}
    constant = [c for c, v in variances.items() if v == 0.0]
    return constant, [c for c, v in variances.items() if v is not None and v != 0.0 and v < threshold]


def correlation_filter(matrix: dict[tuple[str, str], float | None], columns: list[str], threshold: float = 0.90) -> list[str]:
    """FE-11: a column goes when it correlates with any earlier one, dropped ones included."""
    return [
        c for j, c in enumerate(columns)
        if any(matrix[e, c] is not None and abs(matrix[e, c]) > threshold for e in columns[:j])]


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 20) -> DataFrame:
    """FE-13: information between each feature, cut at equal-frequency edges, and the label.

    Rows shrink to (feature, bin, label) counts before anything is shuffled.
    """
    edges = exact_percentiles(df, columns, [i / bins for i in range(1, bins)])
    binned, cells = df, []
    for i, c in enumerate(columns):
        cuts = sorted({e for e in edges[c] if e is not None})
        bounds = F.array(*[F.lit(e) for e in cuts]) if cuts else F.array().cast("array<double>")
        binned = count_below(binned, bounds, quoted(c).cast("double"), f"_bin{i}", len(cuts))
        cells.append(F.struct(F.lit(c).alias("feature"), F.when(quoted(c).isNotNull(), F.col(f"_bin{i}")).alias("bin")))
    joint = binned.select(F.col(label).alias("y"), F.inline(F.array(*cells))).where("bin IS NOT NULL").groupBy(
        "feature", "bin", "y").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    by_bin = F.sum("n").over(Window.partitionBy("feature", "bin"))
    by_label = F.sum("n").over(Window.partitionBy("feature", "y"))
    shares = joint.withColumn("t", total).withColumn("x", by_bin).withColumn("k", by_label)
    part = F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("x") * F.col("k")))
    return shares.groupBy("feature").agg(F.greatest(F.lit(0.0), F.sum(part)).alias("mi_score"))


def eliminate_features(df: DataFrame, columns: list[str], label_index: str, keep: int = 20, depth: int = 5, seed: int = 42) -> dict[str, int]:
    """FE-14: drop the least important feature of a depth-5 tree, one at a time; rank 1 = kept."""
    remaining, removed = list(columns), []
    while len(remaining) > keep:
        vectors = VectorAssembler(inputCols=remaining, outputCol="_v", handleInvalid="error").transform(df)
        tree = DecisionTreeClassifier(featuresCol="_v", labelCol=label_index, maxDepth=depth, seed=seed).fit(vectors)
        importances = tree.featureImportances.toArray()
        worst = min(range(len(remaining)), key=lambda i: (importances[i], -i))
        removed.append(remaining.pop(worst))
    ranks = dict.fromkeys(remaining, 1)
    return ranks | {c: 2 + i for i, c in enumerate(reversed(removed))}


@dataclass
class Selection:
    """What a selection run kept and why it dropped the rest (FE-12)."""
    constant: list[str] = field(default_factory=list)
    low_variance: list[str] = field(default_factory=list)
    duplicate: list[str] = field(default_factory=list)
    correlated: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    ranks: dict[str, int] = field(default_factory=dict)

    @property
    def selected(self) -> list[str]:
        return [c for c, r in self.ranks.items() if r == 1]

    def summary(self, spark) -> DataFrame:
        """FE-16: per feature the stage that dropped it (or `kept`), its score and rank; kept ones first, then by score."""
        stages = {"constant": self.constant, "low_variance": self.low_variance, "duplicate": self.duplicate, "correlated": self.correlated}
        dropped = {c: stage for stage in reversed(stages) for c in stages[stage]}
        names = dict.fromkeys([*dropped, *self.ranks, *self.scores])
        rows = [(c, c in self.selected, "kept" if c in self.selected else dropped.get(c, "eliminated"), float(self.scores.get(c, 0.0)), self.ranks.get(c))
                for c in names]
        table = spark.createDataFrame(rows, "feature string, selected boolean, stage string, mi_score double, rfe_rank int")
        return table.orderBy(F.col("selected").desc(), F.col("mi_score").desc(), "feature")


def select_features(df: DataFrame, columns: list[str], label: str, label_index: str, mixed: Column, ties: list[str],
                    variance_threshold: float = 1e-4, correlation_threshold: float = 0.90, keep: int = 20,
                    sample: int = 50_000) -> Selection:
    """FE-09 to FE-14 in order. The tree elimination works on a stratified sample, as it is meant to;
    every other stage reads the whole table."""
    found = Selection()
    found.constant, found.low_variance = variance_filter(df, columns, variance_threshold)
    left = [c for c in columns if c not in found.constant and c not in found.low_variance]
    found.duplicate = [b for _, b in duplicate_columns(df, left)]
    left = [c for c in left if c not in found.duplicate]
    found.correlated = correlation_filter(pearson_matrix(df, left), left, correlation_threshold)
    left = [c for c in left if c not in found.correlated]
    if not left:
        raise ValueError("every feature was removed by the variance, duplicate and correlation filters")
    found.scores = {r["feature"]: r["mi_score"] for r in mutual_information(df, left, label).collect()}
    part = cut_lineage(stratified_sample(df, label, sample, mixed, ties).select(label_index, *[quoted(c) for c in left]))
    found.ranks = eliminate_features(part, left, label_index, keep)
    return found


# ---- pipeline ----------------------------------------------------------------------------------


def _sql_name(name: str) -> str:
    return f"`{name}`"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fit_preprocessing(train: DataFrame, features: list[str], label: str, mixed: Column, ties: list[str],
                      method: str = "standard", keep: int = 20, carry: list[str] | None = None, most_values: int = 1000) -> tuple[PipelineModel, Selection]:
    """FE-17: encode, select, scale, assemble, fitted on the training rows only.

    The result is an ordinary PipelineModel of SQL projections, saved and loaded by Spark (SNK-10).
    """
    carried = carry or []
    known = categories(train.select(*[quoted(c) for c in features]), most=most_values)
    encoded = one_hot(train.withColumns({f"_tie{i}": F.col(c) for i, c in enumerate(ties)}), known)
    ties = [f"_tie{i}" for i in range(len(ties))]
    indexed = label_indexer(encoded, label).transform(encoded)
    numbers = [c for c in features if c not in known] + [f"{c}_{v}" for c, values in known.items() for v in values]
    selection = select_features(indexed, numbers, label, "label_index", mixed, ties, keep=keep)
    scaler = fit_scaler(encoded, selection.selected, method)
    hot = {f"{c}_{v}": f"CASE WHEN {_sql_name(c)} = {_sql_text(v)} THEN 1.0D ELSE 0.0D END" for c, values in known.items() for v in values}
    scaled = [f"(({hot.get(c, f'CAST({_sql_name(c)} AS DOUBLE)')}) - ({centre!r}D)) / {spread!r}D AS {_sql_name(c)}"
              for c, (centre, spread) in scaler.items()]
    kept = [_sql_name(c) for c in [*dict.fromkeys([*carried, label])]]
    stages = [SQLTransformer(statement=f"SELECT {', '.join(kept + scaled)} FROM __THIS__"),
              VectorAssembler(inputCols=list(scaler), outputCol="features", handleInvalid="error")]
    return Pipeline(stages=stages).fit(train), selection
