"""Training, search, evaluation and scoring with Spark ML (ML-01 to ML-15, MET-12, UDF-01, UDF-02)."""

from __future__ import annotations

import random
import time
import uuid
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowguard.functions.constants import ATTACK_NAMES
from flowguard.functions.risk import risk_level, risk_score, round_half_even
from flowguard.operators import metrics
from flowguard.operators.distributed import running_totals
from flowguard.operators.features import stratified_sample, stratified_samples
from flowguard.plans import boosting, forest
from flowguard.plans.extra import ExtraTrees
from flowguard.session import cut_lineage, scratch_folder

FEATURES, LABEL, WEIGHT = "features", "label_index", "weight"

# ---- registry ----------------------------------------------------------------------------------


def _common(seed: int, weighted: bool, **given) -> dict:
    return {"featuresCol": FEATURES, "labelCol": LABEL, "seed": seed} | ({"weightCol": WEIGHT} if weighted else {}) | given


class SummedLogistic(LogisticRegression):
    """Logistic regression with the inverse strength C of a summed loss. Spark minimises the mean loss, whose penalty is
    1 / (C * weight of all rows); the rows are counted when the model is fitted."""

    def __init__(self, c: float = 1.0, **settings):
        super().__init__(**settings)
        self.c = c

    def _fit(self, dataset: DataFrame) -> Model:
        weighted = self.isDefined(self.weightCol) and self.getWeightCol()
        mass = dataset.agg(F.sum(self.getWeightCol()) if weighted else F.count(F.lit(1))).first()[0]
        return super(SummedLogistic, self.copy({self.regParam: 1.0 / (self.c * max(mass or 0, 1))}))._fit(dataset)


def logistic_regression(seed: int, weighted: bool, c: float = 1.0, **given) -> Estimator:
    """ML-02. A penalty that is given as `regParam` is taken as it is."""
    settings = _common(seed, weighted, maxIter=100, family="multinomial") | given
    settings.pop("seed")
    return LogisticRegression(**settings) if "regParam" in settings else SummedLogistic(c, **settings)


def decision_tree(seed: int, weighted: bool, **given) -> Estimator:
    """ML-03."""
    return DecisionTreeClassifier(**(_common(seed, weighted, maxDepth=15) | given))


class FewTaskForest(RandomForestClassifier):
    """Spark's forest, fitted in few tasks. In every pass a task sets up, sends and merges the statistics of all open nodes,
    however few rows it holds, so partitions beyond `PER_CORE` for a core are joined."""
    PER_CORE = 2

    def _fit(self, dataset: DataFrame) -> Model:
        return super()._fit(dataset.coalesce(self.PER_CORE * dataset.sparkSession.sparkContext.defaultParallelism))


def random_forest(seed: int, weighted: bool, **given) -> Estimator:
    """ML-04. Spark's `cacheNodeIds` stays off: it is quicker only while the executors' memory holds 30 numbers a row."""
    return FewTaskForest(**(_common(seed, weighted, numTrees=30, maxDepth=15) | given))


def extra_trees(seed: int, weighted: bool, **given) -> Estimator:
    """ML-05."""
    return ExtraTrees(**(_common(seed, weighted, numTrees=30, maxDepth=15, bootstrap=False, featureSubsetStrategy="sqrt") | given))


class BoostedTrees(Estimator):
    """ML-06 and ML-09: boosted trees for all classes together, grown round by round.

    Every row has a margin per class. A round grows one regression tree per class to the Newton step of the softmax loss
    (residual over p(1 - p), weighted by it, cut at `boosting.MOST_STEP`) and adds `stepSize` of it. The trees are those of a
    `RandomForestRegressor` of one tree, grown for all classes by the same passes over packed rows (`boosting.py`). Features
    are taken as numbers. With `early_stopping` a row whose `is_validation` is true only watches the loss: once `patience`
    rounds brought no lower one, no further tree is grown and the rounds after the lowest are dropped. Margins are kept in
    the executors from round to round, as a round reads the rows in a handful of jobs, and written every few rounds.
    The fitted model is a pipeline of one boosted ensemble per class, which add up to the columns `margin_0`, `margin_1`, ...
    """
    WRITTEN_EVERY = 5

    def __init__(self, seed: int, weighted: bool, early_stopping: bool = False, patience: int = 10, parallelism: int = 4,
                 maxIter: int = 50, stepSize: float = 0.1, **given):
        super().__init__()  # `parallelism` has no effect any more: the same passes serve all classes
        self.rounds, self.step, self.seed, self.weighted = maxIter, stepSize, seed, weighted
        self.tree = RandomForestRegressor(**({"maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "all"} | given | {"numTrees": 1, "bootstrap": False}))
        self.early_stopping, self.patience = early_stopping, patience

    def _seeds(self, number: int, classes: int) -> list[int]:
        return [self.seed + 1000 * number + k for k in range(classes)]

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        side = F.when(F.expr("NOT is_validation"), boosting.LEARNED).when(F.col("is_validation"), boosting.WATCHED).otherwise(boosting.NEITHER) if self.early_stopping else F.lit(boosting.LEARNED)
        found = dataset.agg(F.max(LABEL).alias("last"), F.count_if(side == boosting.LEARNED).alias("learned")).first()
        classes, learned = int(found["last"] or 0) + 1, found["learned"]
        if not learned:
            raise ValueError("there are no rows to learn from")
        margins, rate = [f"margin_{k}" for k in range(classes)], self.tree.getSubsamplingRate()
        rows = boosting.pack(dataset, FEATURES, LABEL, WEIGHT if self.weighted else None, side, classes)
        rows = cut_lineage(boosting.advance(rows, [], self.step, self._seeds(0, classes), rate))
        features = rows.select(F.octet_length("ends")).first()[0] // 8
        bins = min(self.tree.getMaxBins(), learned)
        share = min(1.0, max(bins * bins, 10_000) / learned)
        limits = boosting.Limits(self.tree.getMaxDepth(), bins, boosting.features_of_a_node(self.tree.getFeatureSubsetStrategy(), features),
                                 self.tree.getMinInstancesPerNode(), self.tree.getMinWeightFractionPerNode(), self.tree.getMinInfoGain())
        grown: list[list[boosting.Tree]] = []
        losses: list[float] = []
        with _kept() as held:
            surveyed = boosting.survey(rows, classes, features, self._seeds(0, classes), share)
            while len(grown) < self.rounds and len(losses) - best_round(losses, self.patience) < self.patience:
                together = boosting.grow(rows, surveyed, features, self._seeds(len(grown), classes), limits)
                grown.append([self._tree(together, margins, k, len(grown)) for k in range(classes)])
                seeds = self._seeds(len(grown), classes)
                rows = boosting.advance(rows, grown[-1], self.step, seeds, rate)
                if len(grown) % self.WRITTEN_EVERY == 0:
                    rows = cut_lineage(rows)
                    _release(held)
                else:
                    # The rows of the round before are read while these are made.
                    _release(held, 1)
                    held.append(rows := rows.persist())
                if self.early_stopping or len(grown) < self.rounds:
                    surveyed = boosting.survey(rows, classes, features, seeds, share)
                if self.early_stopping:
                    losses.append(surveyed.loss)
        keep = best_round(losses, self.patience) if losses else len(grown)
        return PipelineModel([self._ensemble([trees[k] for trees in grown[:keep]], margins[k], features) for k in range(classes)])

    def _tree(self, together: list[boosting.Tree], margins: list[str], k: int, number: int) -> boosting.Tree:
        """The tree of one class among those of a round."""
        return together[k]

    def _ensemble(self, trees: list[boosting.Tree], margin: str, features: int) -> GBTRegressionModel:
        context = SparkSession.active().sparkContext
        jvm, gateway = context._jvm, context._gateway
        kinds = jvm.org.apache.spark.ml.regression
        members = gateway.new_array(kinds.DecisionTreeRegressionModel, len(trees))
        weights = gateway.new_array(gateway.jvm.double, len(trees))
        for i, tree in enumerate(trees):
            members[i], weights[i] = kinds.DecisionTreeRegressionModel(f"boosted_tree_{uuid.uuid4().hex[:12]}", boosting.as_spark(tree, context), features), self.step
        made = GBTRegressionModel(kinds.GBTRegressionModel(f"boosted_{uuid.uuid4().hex[:12]}", members, weights))
        return made.setFeaturesCol(FEATURES).setPredictionCol(margin)


@contextmanager
def _kept() -> Iterator[list[DataFrame]]:
    """Frames that are kept in the executors; they are let go at the end, also after an error."""
    held: list[DataFrame] = []
    try:
        yield held
    finally:
        _release(held)


def _release(held: list[DataFrame], last: int = 0) -> None:
    """Lets go of kept frames but the last ones."""
    while len(held) > last:
        held.pop(0).unpersist()


def _share(margins: list[str], k: Column) -> Column:
    """The softmax share of one class."""
    most = F.greatest(*margins) if len(margins) > 1 else F.col(margins[0])
    parts = F.array(*[F.exp(F.col(m) - most) for m in margins])
    return F.greatest(F.get(parts, k) / sum((F.exp(F.col(m) - most) for m in margins[1:]), F.exp(F.col(margins[0]) - most)), F.lit(1e-12))


def best_round(losses: list[float], patience: int) -> int:
    """How many rounds to keep: up to the lowest loss seen before `patience` rounds passed without a lower one."""
    if not losses:
        return 0
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


REGISTRY: dict[str, Callable[..., Estimator]] = {
    "logistic_regression": logistic_regression,
    "decision_tree": decision_tree,
    "random_forest": random_forest,
    "extra_trees": extra_trees,
    "boosted_trees": BoostedTrees,
}


def build(name: str, seed: int = 42, weighted: bool = False, **settings) -> Estimator:
    """ML-01: an estimator by name; an unknown name is an error. Users add their own to REGISTRY (UDF-01)."""
    return _entry(name, REGISTRY)(seed, weighted, **settings)


def _entry(name: str, table: dict):
    """The entry of a table that a user means, whatever the case and outer spaces."""
    found = table.get(name.strip().lower())
    if found is None:
        raise ValueError(f"{name!r} is none of {sorted(table)}")
    return found


# ---- scoring -----------------------------------------------------------------------------------


def with_probabilities(scored: DataFrame) -> DataFrame:
    """Add `probabilities` (array by class) and `pred`. Margins of boosted trees give softmax shares; shares of older
    one-against-rest models are scaled to sum 1; a model without probabilities leaves them null."""
    margins = sorted((c for c in scored.columns if c.startswith("margin_")), key=lambda c: int(c.rsplit("_", 1)[1]))
    if margins:
        scored = scored.withColumn("probabilities", F.array(*[_share(margins, F.lit(k)) for k in range(len(margins))]))
        return scored.withColumn("pred", F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1)
    shares = [c for c in scored.columns if c.startswith("probability_")]
    if shares:
        ordered = sorted(shares, key=lambda c: int(c.rsplit("_", 1)[1]))
        raw = F.array(*[vector_to_array(c)[1] for c in ordered])
        total = F.aggregate("_raw", F.lit(0.0), lambda a, x: a + x)
        one_of = scored.withColumn("_raw", raw).withColumn("probabilities", F.transform("_raw", lambda p: F.try_divide(p, total))).drop("_raw")
        return one_of.withColumn("pred", F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1)
    if "probability" in scored.columns:
        scored = scored.withColumn("probabilities", vector_to_array("probability"))
    elif "probabilities" not in scored.columns:
        scored = scored.withColumn("probabilities", F.lit(None).cast("array<double>"))
    return scored.withColumn("pred", F.col("prediction").cast("int"))


def predict(model: Transformer, df: DataFrame) -> DataFrame:
    """Class probabilities and the predicted class; trees and forests are walked on whole batches."""
    if isinstance(model, PipelineModel) and forest.is_tree(model.stages[-1]):
        return predict(model.stages[-1], PipelineModel(model.stages[:-1]).transform(df))
    scored = forest.predict(model, df)
    return with_probabilities(model.transform(df)) if scored is None else scored


def external_model(scorer: Callable[[pd.DataFrame], tuple], columns: list[str], carry_schema: str) -> Callable[[DataFrame], DataFrame]:
    """UDF-01: a scorer from outside Spark, called on Arrow batches inside the tasks.

    `scorer` returns (class indices, probability matrix or None); carried columns pass through.
    """
    def apply(df: DataFrame) -> DataFrame:
        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                labels, shares = scorer(part[columns])
                yield part.assign(prediction=[float(x) for x in labels], probabilities=[None] * len(part) if shares is None else [list(map(float, s)) for s in shares])
        return with_probabilities(df.mapInPandas(batches, f"{carry_schema}, prediction double, probabilities array<double>"))
    return apply


def prediction_table(scored: DataFrame, model_name: str, names: list[str] | None = None, keep: list[str] | None = None, latency_ms: float = 0.0) -> DataFrame:
    """ML-11 with EXP-01 to EXP-03 and JOIN-03: the seven prediction columns per row."""
    known = names or ATTACK_NAMES
    table = F.array(*[F.lit(n) for n in known])

    def named(index: Column) -> Column:
        return F.coalesce(F.get(table, index), index.cast("string"))
    attack = named(F.col("pred"))
    shares = F.col("probabilities")
    confidence = F.coalesce(F.array_max(shares), F.lit(1.0))
    by_class = F.map_from_arrays(F.transform(shares, lambda p, i: named(i)), F.transform(shares, lambda p: round_half_even(p, 4)))
    base = scored.select(*(keep or []), attack.alias("Attack_Type"), confidence.alias("Prediction_Confidence"),
                         F.coalesce(by_class, F.create_map(attack, F.lit(1.0))).alias("Class_Probabilities"))
    risked = base.withColumn("Risk_Score", risk_score(F.col("Attack_Type"), F.col("Prediction_Confidence")))
    return risked.withColumn("Risk_Level", risk_level(F.col("Risk_Score"))).select(
        *(keep or []), "Attack_Type", "Prediction_Confidence", "Risk_Score", "Risk_Level", "Class_Probabilities",
        F.lit(model_name).alias("Model_Name"), F.lit(float(latency_ms)).alias("Prediction_Time_ms"))


# ---- training and comparison -------------------------------------------------------------------


@dataclass
class Trained:
    name: str
    model: Model
    fit_seconds: float
    settings: dict = field(default_factory=dict)


def _seconds(action: Callable[[], object]) -> tuple[object, float]:
    start = time.perf_counter()
    return action(), time.perf_counter() - start


def train(names: list[str], rows: DataFrame, seed: int = 42, weighted: bool = False, settings: dict[str, dict] | None = None,
          skip_failed: bool = False) -> tuple[list[Trained], dict[str, str]]:
    """ML-07: fit each model in turn. A name that is not registered is left out and its error returned.

    An error of a registered model ends the run, as a table without that model would look whole; with `skip_failed` the
    run goes on with the other models and the error is returned as well.
    """
    done, failed = [], {}
    for name in names:
        try:
            estimator = build(name, seed, weighted, **(settings or {}).get(name, {}))
            model, seconds = _seconds(lambda: estimator.fit(rows))
            done.append(Trained(name, model, seconds, (settings or {}).get(name, {})))
        except Exception as e:
            if not skip_failed and name.strip().lower() in REGISTRY:
                raise RuntimeError(f"model {name!r} failed: {type(e).__name__}: {e}") from e
            failed[name] = f"{type(e).__name__}: {e}"
    return done, failed


def evaluate(models: list[Trained], test: DataFrame, curves: bool = True) -> DataFrame:
    """MET-12: one metric row per model with timings; all models share one grouping."""
    spark = test.sparkSession
    parts, times = [], []
    for m in models:
        scored = predict(m.model, test).select(F.lit(m.name).alias("model"), F.col(LABEL).cast("int").alias("y"), "pred", "probabilities")
        _, seconds = _seconds(lambda: scored.write.format("noop").mode("overwrite").save())
        parts.append(scored)
        times.append((m.name, m.fit_seconds, seconds))
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    table = metrics.metric_suite(union)
    if curves:
        table = table.join(metrics.area_scores(metrics.score_steps(union.where("probabilities IS NOT NULL"))), "model", "left").fillna(0.0, ["roc_auc", "pr_auc"])
    return table.join(spark.createDataFrame(times, "model string, fit_seconds double, prediction_seconds double"), "model")


def train_and_rank(names: list[str], train_rows: DataFrame, test_rows: DataFrame, **options) -> tuple[Trained, DataFrame]:
    """ML-07: the best model by rank, and the ranked table. A model that `train` left out is told by a warning."""
    models, failed = train(names, train_rows, **options)
    if not models:
        raise RuntimeError(f"every model failed: {failed}")
    if failed:
        warnings.warn(f"models that are not ranked: {failed}", stacklevel=2)
    ranked = metrics.rank_models(evaluate(models, test_rows))
    best = ranked.where("rank = 1").first()["model"]
    return next(m for m in models if m.name == best), ranked


def run_metadata(best: Trained, rows: DataFrame, features: list[str]) -> DataFrame:
    """ML-14."""
    return rows.sparkSession.createDataFrame(
        [(best.name, rows.count(), len(rows.columns), len(features), best.fit_seconds)],
        "model string, rows bigint, columns int, features int, fit_seconds double")


# ---- search ------------------------------------------------------------------------------------

# Search grid per model; 30 stands for unlimited depth, which is Spark's deepest tree.
SEARCH_SPACES = {
    "random_forest": {
        "numTrees": [10, 30, 50],
        "maxDepth": [10, 15, 20, 30],
        "minInstancesPerNode": [1, 2, 4],
        "bootstrap": [True, False],
    },
    "extra_trees": {
        "numTrees": [10, 30, 50],
        "maxDepth": [10, 15, 20, 30],
        "impurity": ["gini", "entropy"],
        "minInstancesPerNode": [1, 2, 4],
    },
    "boosted_trees": {
        "maxIter": [30, 50, 100],
        "maxDepth": [4, 6, 8],
        "stepSize": [0.05, 0.1, 0.2],
        "subsamplingRate": [0.7, 0.8, 0.9],
        "featureSubsetStrategy": ["0.7", "0.8", "0.9"],
        "minInstancesPerNode": [10, 20, 30],
    },
}


def candidates(space: dict[str, list], method: str = "random", draws: int = 5, seed: int = 42) -> list[dict]:
    """The whole grid, or a repeatable draw of settings from it without repetition."""
    names = list(space)
    total = 1
    for n in names:
        total *= len(space[n])
    picks = range(total) if method == "grid" else sorted(random.Random(seed).sample(range(total), min(draws, total)))
    result = []
    for pick in picks:
        setting = {}
        for n in names:
            pick, at = divmod(pick, len(space[n]))
            setting[n] = space[n][at]
        result.append(setting)
    return result


class MacroF1(Evaluator):
    """The macro F1 of a scored frame; the built-in `f1` is weighted by class size."""

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = with_probabilities(dataset).select(F.lit("m").alias("model"), F.col(LABEL).cast("int").alias("y"), "pred")
        return float(metrics.metric_suite(scored).first()["f1_macro"])

    def isLargerBetter(self) -> bool:
        return True


def with_folds(sample: DataFrame, folds: int, key: list[str], mixed: Column | None = None) -> DataFrame:
    """ML-08: stratified folds. The rows of a class are ranked in a repeatable mixed order and dealt in turn, so the fold
    sizes of a class differ by at most one, also for a class of few rows.

    Ranks are running counts over slices of the order, so no class meets in one task. `mixed` defaults to a hash of
    `key`, which should identify a row; equal rows are interchangeable.
    """
    return _dealt(sample, {"fold": F.lit(1)}, folds, key, mixed)


def _dealt(sample: DataFrame, parts: dict[str, Column], folds: int, key: list[str], mixed: Column | None = None) -> DataFrame:
    """The folds of several parts of the rows, dealt in one sort. A part is 1 on its rows and 0 elsewhere; its column is null off the part."""
    order = F.xxhash64(F.lit("fold"), *key) if mixed is None else mixed
    ranks = {f"_rank_{name}": taken for name, taken in parts.items()}
    ranked = running_totals(sample.withColumn("_mixed", order), [LABEL], ["_mixed", *key], ranks)
    dealt = {name: F.when(taken == 1, F.pmod(F.col(f"_rank_{name}") - 1, F.lit(folds)).cast("int")) for name, taken in parts.items()}
    return ranked.withColumns(dealt).drop("_mixed", *ranks)


def search(name: str, sample: DataFrame, folds: int = 5, method: str = "random", draws: int = 5, seed: int = 42,
           space: dict[str, list] | None = None, parallelism: int = 2, fixed: dict | None = None) -> tuple[dict, DataFrame]:
    """ML-08: the settings of best mean macro F1 over the `fold` column, and the table of all tried.

    Tree and linear models go through CrossValidator; the boosted model is cross-validated by setting, as its
    parameters belong to one inner model per class.
    """
    tried = candidates(space or _entry(name, SEARCH_SPACES), method, draws, seed)
    if name == "boosted_trees":
        scores = [_fold_mean(build(name, seed, **((fixed or {}) | s)), sample, folds) for s in tried]
    else:
        estimator = build(name, seed, **(fixed or {}))
        grid = [{estimator.getParam(k): v for k, v in s.items()} for s in tried]
        fitted = CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=MacroF1(), numFolds=folds, foldCol="fold", parallelism=parallelism).fit(sample)
        scores = list(fitted.avgMetrics)
    best = max(range(len(tried)), key=lambda i: (scores[i], -i))
    rows = [(name, i, str(sorted(s.items())), float(scores[i]), i == best) for i, s in enumerate(tried)]
    return tried[best], sample.sparkSession.createDataFrame(rows, "model string, draw int, settings string, f1_macro double, best boolean")


def _fold_mean(estimator: Estimator, sample: DataFrame, folds: int) -> float:
    judge = MacroF1()
    return sum(judge.evaluate(estimator.fit(sample.where(F.col("fold") != k)).transform(sample.where(F.col("fold") == k))) for k in range(folds)) / folds


def tune(name: str, train_rows: DataFrame, test_rows: DataFrame, mixed: Column, ties: list[str], sample_size: int = 50_000,
         folds: int = 5, **options) -> tuple[Trained, DataFrame]:
    """ML-10: search on a stratified sample, refit the winner on all training rows, compare with the default."""
    sample = cut_lineage(with_folds(stratified_sample(train_rows, LABEL, sample_size, mixed, ties), folds, ties))
    settings, _ = search(name, sample, folds, **options)
    original, _ = train([name], train_rows)
    tuned, _ = train([name], train_rows, settings={name: settings})
    before, after = evaluate(original, test_rows, False), evaluate(tuned, test_rows, False)
    return tuned[0], metrics.compare_tuned(before, after, ["accuracy", "f1_macro", "recall_macro", "fpr"])


# ---- curves ------------------------------------------------------------------------------------


def _curve(rows: list[tuple], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows, "point string, size bigint, part string, f1_mean double, f1_std double")


def _fold_scores(estimator: Estimator, rows: DataFrame, folds: int) -> dict[str, tuple[float, float]]:
    """Mean and deviation of macro F1 over folds, for both sides; all folds are scored by one job."""
    scored = None
    for k in range(folds):
        inside = rows.where(F.col("fold") != k)
        model = estimator.fit(inside)
        for part, side in (("train", inside), ("test", rows.where(F.col("fold") == k))):
            part_rows = predict(model, side).select(F.lit(f"{part}|{k}").alias("model"), F.col(LABEL).cast("int").alias("y"), "pred")
            scored = part_rows if scored is None else scored.unionByName(part_rows)
    table = metrics.metric_suite(scored).groupBy(F.split("model", r"\|")[0].alias("part")).agg(F.avg("f1_macro").alias("m"), F.stddev_pop("f1_macro").alias("s"))
    return {r["part"]: (r["m"], r["s"]) for r in table.orderBy("part").collect()}


def learning_curve(name: str, sample: DataFrame, mixed: Column, ties: list[str], sizes: list[float] | None = None, folds: int = 3, settings: dict | None = None) -> DataFrame:
    """ML-12: macro F1 at eight training sizes from 0.1 to 1.0.

    The samples of all sizes are marked together and their folds dealt in one sort, so the rows are moved and written once
    however many sizes there are; what is written is removed at the end.
    """
    shares = sizes or [0.1 + 0.9 * i / 7 for i in range(8)]
    total, rows, given = sample.count(), [], settings or {}
    wanted = {f"_size{i}": max(folds, round(total * share)) for i, share in enumerate(shares)}
    marked = stratified_samples(sample, LABEL, wanted, mixed, ties)
    # A row's marks are bits of whole numbers, 60 in each.
    bits = [list(wanted)[at:at + 60] for at in range(0, len(wanted), 60)]
    packed = {f"_sizes{b}": sum((F.col(m).cast("bigint") * (1 << i) for i, m in enumerate(lot)), F.lit(0).cast("bigint")) for b, lot in enumerate(bits)}
    parts = {m: F.getbit(F.col(f"_sizes{b}"), F.lit(i)).cast("int") for b, lot in enumerate(bits) for i, m in enumerate(lot)}
    dealt = _dealt(marked.withColumns(packed).drop(*wanted), parts, folds, ties).drop(*packed)
    with scratch_folder(sample.sparkSession) as folder:
        dealt.write.parquet(folder)
        written = sample.sparkSession.read.parquet(folder)
        for share, mark in zip(shares, wanted, strict=True):
            part = written.where(F.col(mark).isNotNull()).withColumn("fold", F.col(mark)).drop(*wanted)
            for kind, (mean, std) in _fold_scores(build(name, **given), part, folds).items():
                rows.append((f"{share:.4f}", round(total * share), kind, mean, std))
    return _curve(rows, sample.sparkSession)


def validation_curve(name: str, sample: DataFrame, parameter: str, values: list, key: list[str], folds: int = 3, settings: dict | None = None) -> DataFrame:
    """ML-13: macro F1 over one parameter."""
    part, rows = cut_lineage(with_folds(sample, folds, key)), []
    size = sample.count()
    for value in values:
        for kind, (mean, std) in _fold_scores(build(name, **((settings or {}) | {parameter: value})), part, folds).items():
            rows.append((str(value), size, kind, mean, std))
    return _curve(rows, sample.sparkSession)


# ---- persistence -------------------------------------------------------------------------------


def save_model(trained: Trained, folder: str, tuned: bool = False) -> str:
    """ML-15."""
    path = f"{folder.rstrip('/')}/{trained.name}{'_tuned' if tuned else ''}"
    model = trained.model if isinstance(trained.model, PipelineModel) else PipelineModel([trained.model])
    model.write().overwrite().save(path)
    return path


def load_model(spark: SparkSession, folder: str, name: str) -> PipelineModel:
    """ML-15: the tuned version when there is one, else the original. A tuned model that cannot be read is an error."""
    root = folder.rstrip("/")
    tuned = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}_tuned")
    there = tuned.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(tuned)
    return PipelineModel.load(f"{root}/{name}{'_tuned' if there else ''}")
