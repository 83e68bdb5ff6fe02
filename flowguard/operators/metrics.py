"""Classification metrics from predictions (MET-01 to MET-12), model ranking and outcome examples.

Input rows hold `model`, `y`, `pred` and, for curves, `probabilities` (an array indexed by class).
Everything but the curves works on the confusion counts, which are as small as classes squared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.operators.distributed import running_totals
from flowguard.session import cut_lineage

GRID = 200


def _safe(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def confusion_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("model", "y", "pred").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """MET-01: counts and their share of the true class."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("model", "y"))
    return confusion_counts(df).withColumn("share", share)


def class_table(counts: DataFrame) -> DataFrame:
    """Per model and class: true positives, support, predictions, total, and the derived rates."""
    sides = F.array(
        F.struct(F.col("y").alias("class"), F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0).alias("d"),
                 F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("bigint").alias("d"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")))
    sums = counts.select("model", F.inline(sides)).groupBy("model", "class").agg(F.sum("d").alias("d"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    base = sums.withColumn("n", F.sum("t").over(Window.partitionBy("model")))
    precision, recall = _safe(F.col("d"), F.col("p")), _safe(F.col("d"), F.col("t"))
    negatives = F.col("n") - F.col("t")
    false_alarms = F.col("p") - F.col("d")
    rated = base.withColumns({
        "precision": precision, "recall": recall, "fpr": _safe(false_alarms, negatives),
        "fnr": _safe(F.col("t") - F.col("d"), F.col("t")), "specificity": _safe(negatives - false_alarms, negatives)})
    return rated.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def _weighted(name: str) -> Column:
    return F.sum(F.col("t") * F.col(name)) / F.sum("t")


def metric_suite(df: DataFrame) -> DataFrame:
    """MET-02, MET-03, MET-06 and MET-07: one row per model (MET-12 when there are several)."""
    return suite_of_counts(confusion_counts(df))


def suite_of_counts(counts: DataFrame) -> DataFrame:
    """`metric_suite` of rows that are counted already, by `model`, `y` and `pred` in `n`."""
    n = F.first("n").cast("double")
    hits = F.sum("d").cast("double")
    cross = F.sum(F.col("t").cast("double") * F.col("p"))
    spread = F.sqrt((n * n - F.sum(F.col("p").cast("double") * F.col("p"))) * (n * n - F.sum(F.col("t").cast("double") * F.col("t"))))
    return class_table(counts).groupBy("model").agg(
        (hits / n).alias("accuracy"),
        F.coalesce(F.avg(F.when(F.col("t") > 0, F.col("recall"))), F.lit(0.0)).alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), _weighted("precision").alias("precision_weighted"),
        F.avg("recall").alias("recall_macro"), _weighted("recall").alias("recall_weighted"),
        F.avg("f1").alias("f1_macro"), _weighted("f1").alias("f1_weighted"),
        _safe(n * hits - cross, spread).alias("mcc"), _safe(n * hits - cross, n * n - cross).alias("kappa"),
        F.avg("fpr").alias("fpr"), F.avg("fnr").alias("fnr"), F.avg("specificity").alias("specificity"))


def class_report(df: DataFrame) -> DataFrame:
    """MET-08: a row per class plus accuracy, macro and weighted rows."""
    table = class_table(confusion_counts(df))
    per_class = table.select("model", F.col("class").cast("string").alias("class"), "precision", "recall", "f1", F.col("t").cast("double").alias("support"))
    totals = table.groupBy("model").agg(
        (F.sum("d") / F.sum("t")).alias("accuracy"), F.sum("t").cast("double").alias("support"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        *[_weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])

    def line(name: str, precision: str, recall: str, f1: str, support: str) -> Column:
        return F.struct(F.lit(name).alias("class"), F.col(precision).alias("precision"), F.col(recall).alias("recall"),
                        F.col(f1).alias("f1"), F.col(support).alias("support"))
    extra = totals.select("model", F.inline(F.array(
        line("accuracy", "accuracy", "accuracy", "accuracy", "accuracy"),
        line("macro avg", "macro_precision", "macro_recall", "macro_f1", "support"),
        line("weighted avg", "weighted_precision", "weighted_recall", "weighted_f1", "support"))))
    return per_class.unionByName(extra)


def score_steps(df: DataFrame, rows_per_task: int = 1_000_000) -> DataFrame:
    """Per model and class, the cumulative true and false positives at each distinct score, best first.

    Rows with equal scores are merged before the ordering, which is itself split into slices, so neither
    a frequent score nor a frequent class lands in one task. A class must occur in `y` to be counted;
    with two classes only class 1 is.
    """
    by_class = F.transform("probabilities", lambda p, i: F.struct(i.alias("class"), p.alias("score")))
    cells = df.select("model", "y", F.inline(by_class))
    merged = cut_lineage(cells.groupBy("model", "class", (-F.col("score")).alias("order")).agg(
        F.count_if(F.col("y") == F.col("class")).alias("pos"), F.count_if(F.col("y") != F.col("class")).alias("neg")))
    totals = merged.groupBy("model", "class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where("P > 0")
    present = F.count("*").over(Window.partitionBy("model"))
    wanted = totals.withColumn("_classes", present).where("_classes <> 2 OR class = 1").drop("_classes")
    summed = running_totals(merged, ["model", "class"], ["order"], {"tp": F.col("pos"), "fp": F.col("neg")}, rows_per_task)
    return summed.join(wanted, ["model", "class"])


def area_scores(steps: DataFrame) -> DataFrame:
    """MET-04 and MET-05: rank-based ROC area and average precision per class, then their mean per model."""
    before = F.col("tp") - F.col("pos")
    per_class = steps.groupBy("model", "class").agg(
        _safe(F.sum(F.col("neg") * (before + F.col("pos") / 2.0)), F.first("P").cast("double") * F.first("N")).alias("roc_auc"),
        (F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))) / F.first("P")).alias("pr_auc"))
    return per_class.groupBy("model").agg(F.avg("roc_auc").alias("roc_auc"), F.avg("pr_auc").alias("pr_auc"))


def _on_grid(steps: DataFrame, done: Column, step: Column, total: Column, before: Column, after: Column, last: Column, points: int) -> DataFrame:
    """Linear interpolation on an even grid in [0, 1].

    A step covers the grid points in [done - step, done) / total; every step knows its own start, so no
    neighbouring row is needed. The point 1.0 takes the value at the end of the curve.
    """
    cells = points - 1
    first = F.ceil((done - step) * cells / total)
    upto = F.ceil(done * cells / total) - 1
    inside = steps.where(step > 0).withColumns({"_a": first, "_b": upto}).where("_a <= _b")
    g = F.col("point")
    value = before + (g / cells * total - (done - step)) / step * (after - before)
    body = inside.withColumn("point", F.explode(F.sequence("_a", "_b"))).select("model", "class", "point", value.alias("value"))
    end = steps.select("model", "class", "P", "N").distinct().select(
        "model", "class", F.lit(cells).cast("bigint").alias("point"), last.alias("value"))
    return body.unionByName(end).groupBy("model", "point").agg(F.avg("value").alias("value")).withColumn("x", g / cells)


def roc_points(steps: DataFrame, points: int = GRID) -> DataFrame:
    """MET-09: mean true-positive rate over classes at each false-positive rate of the grid."""
    before, after = (F.col("tp") - F.col("pos")) / F.col("P"), F.col("tp") / F.col("P")
    table = _on_grid(steps.where("N > 0"), F.col("fp"), F.col("neg"), F.col("N"), before, after, F.lit(1.0), points)
    return table.select("model", "point", F.col("x").alias("fpr"), F.col("value").alias("tpr"))


def pr_points(steps: DataFrame, points: int = GRID) -> DataFrame:
    """MET-10: mean precision over classes at each recall of the grid; the curve starts at precision 1."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp + fp > 0, F.try_divide(tp, tp + fp)).otherwise(1.0)
    after = F.col("tp") / (F.col("tp") + F.col("fp"))
    table = _on_grid(steps, F.col("tp"), F.col("pos"), F.col("P"), before, after, F.col("P") / (F.col("P") + F.col("N")), points)
    return table.select("model", "point", F.col("x").alias("recall"), F.col("value").alias("precision"))


def calibration(df: DataFrame, bins: int = 10, positive: int = 0) -> DataFrame:
    """MET-11: mean predicted probability and observed share per probability bin; empty bins are left out."""
    p = F.element_at("probabilities", positive + 1)
    place = F.least(F.lit(bins - 1).cast("bigint"), F.floor(p * bins))
    return df.groupBy("model", place.alias("bin")).agg(
        F.avg(p).alias("mean_predicted"), F.avg((F.col("y") == positive).cast("double")).alias("fraction_positive"), F.count("*").alias("rows"))


# ---- ranking and comparison --------------------------------------------------------------------

# Sort order of the model ranking, true = ascending.
RANK_ORDER = [("f1_macro", False), ("recall_macro", False), ("fpr", True)]
# Leader title, metric, true = smallest wins.
LEADERS = [
    ("Best Accuracy", "accuracy", False),
    ("Best Recall", "recall_macro", False),
    ("Best Precision", "precision_macro", False),
    ("Best F1", "f1_macro", False),
    ("Lowest FPR", "fpr", True),
    ("Lowest Prediction Time", "prediction_seconds", True),
    ("Best ROC-AUC", "roc_auc", False),
    ("Best MCC", "mcc", False),
]


def rank_models(metrics: DataFrame) -> DataFrame:
    """WIN-02 over one row per model; sort columns that are missing are skipped, name as tie-break."""
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in RANK_ORDER if c in metrics.columns]
    if not order:
        return metrics
    window = Window.partitionBy(F.lit(1)).orderBy(*order, "model")
    return metrics.withColumn("rank", F.row_number().over(window))


def model_leaders(ranked: DataFrame) -> DataFrame:
    """AGG-17: the model that leads each metric; the better-ranked one on equal values."""
    known = [(title, c, up) for title, c, up in LEADERS if c in ranked.columns]
    lines = F.array(*[F.struct(F.lit(title).alias("title"), (-F.col(c) if up else F.col(c)).cast("double").alias("value")) for title, c, up in known])
    tall = ranked.select("model", "rank", F.inline(lines)).where("value IS NOT NULL AND NOT isnan(value)")
    return tall.groupBy("title").agg(F.max_by("model", F.struct("value", -F.col("rank"))).alias("model"))


# Thresholds of the remarks as (code, metric, comparison, bound, value when the metric is absent).
STRENGTHS = [("recall_at_least_0.9", "recall_macro", ">=", 0.90, 0.0), ("fpr_at_most_0.001", "fpr", "<=", 0.001, 1.0),
             ("scored_within_1_s", "prediction_seconds", "<=", 1.0, 99.0)]
WEAKNESSES = [("f1_below_0.7", "f1_macro", "<", 0.70, 0.0), ("fpr_above_0.01", "fpr", ">", 0.01, 0.0),
              ("scored_after_5_s", "prediction_seconds", ">", 5.0, 0.0), ("recall_below_0.85", "recall_macro", "<", 0.85, 1.0)]


def model_remarks(ranked: DataFrame) -> DataFrame:
    """AGG-18: per model the titles it leads, then the codes of the thresholds it meets or misses; empty lists when there are none."""
    compare = {">=": Column.__ge__, "<=": Column.__le__, "<": Column.__lt__, ">": Column.__gt__}
    has = set(ranked.columns)

    def codes(table: list[tuple]) -> Column:
        return F.array_compact(F.array(*[
            F.when(compare[sign](F.col(metric) if metric in has else F.lit(absent), F.lit(bound)), F.lit(code)) for code, metric, sign, bound, absent in table]))
    leads = model_leaders(ranked).groupBy("model").agg(F.sort_array(F.collect_list("title")).alias("led"))
    joined = ranked.join(leads, "model", "left")
    return joined.select("model", F.concat(F.coalesce("led", F.array().cast("array<string>")), codes(STRENGTHS)).alias("strengths"), codes(WEAKNESSES).alias("weaknesses"))


def compare_tuned(original: DataFrame, tuned: DataFrame, measures: list[str], duration: str = "fit_seconds") -> DataFrame:
    """JOIN-06: original and tuned metrics side by side with their differences; a missing duration is 0.0."""
    left = original.select("model", *[F.col(m).alias(f"original_{m}") for m in measures], F.coalesce(F.col(duration), F.lit(0.0)).alias(f"original_{duration}"))
    right = tuned.select("model", *[F.col(m).alias(f"tuned_{m}") for m in measures], F.coalesce(F.col(duration), F.lit(0.0)).alias(f"tuned_{duration}"))
    joined = left.join(right, "model", "left")
    return joined.select(*joined.columns, *[(F.col(f"tuned_{m}") - F.col(f"original_{m}")).alias(f"delta_{m}") for m in measures])


def outcome(y: Column, pred: Column, benign: int = 0) -> Column:
    """FIL-11: the four outcomes worth an example; any other error is null."""
    return (
        F.when((y == benign) & (pred == benign), "normal").when((y != benign) & (pred == y), "attack")
        .when((y == benign) & (pred != benign), "false_positive").when((y != benign) & (pred == benign), "false_negative"))


def outcome_examples(df: DataFrame, key: list[str], carry: list[str]) -> DataFrame:
    """FIL-11: the first row, by key, of each outcome."""
    tagged = df.withColumn("outcome", outcome(F.col("y"), F.col("pred"))).where("outcome IS NOT NULL")
    first = tagged.groupBy("outcome").agg(F.min_by(F.struct(*dict.fromkeys([*key, "y", "pred", *carry])), F.struct(*key)).alias("e"))
    return first.select("outcome", "e.*")
