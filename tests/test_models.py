"""Features, metrics, training, explanation and oversampling."""

import random
import re

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from flowguard.operators import features, metrics, neighbours, resample
from flowguard.operators.distributed import mix
from flowguard.plans import explain, forest, small_queries, training


def by_id():
    return mix(F.col("id"))


@pytest.fixture(scope="module")
def mixed_frame(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(400):
        a = float(rng.normal())
        rows.append((i, a, float(rng.normal(5, 10)), 0.99 * a + float(rng.normal(0, 0.01)), 1.0, float(rng.normal(0, 1e-5)), a,
                     str(rng.choice(["TypeA", "TypeB", "TypeC"])), "BENIGN" if rng.random() < 0.8 else "DDoS"))
    return spark.createDataFrame(rows, "id bigint, numeric_1 double, numeric_2 double, numeric_3 double, constant_col double, low_var_col double, duplicate_col double, categorical_col string, target string").cache()


NAMES = ["numeric_1", "numeric_2", "numeric_3", "constant_col", "low_var_col", "duplicate_col", "categorical_col"]


def test_split(mixed_frame):
    marked = features.stratified_split(mixed_frame, "target", by_id(), ["id"])
    shares = {r["split"]: (r["n"], r["d"]) for r in marked.groupBy("split").agg(F.count("*").alias("n"), F.avg((F.col("target") == "DDoS").cast("double")).alias("d")).collect()}
    assert abs(shares["test"][0] - 80) <= 1 and abs(shares["test"][1] - shares["train"][1]) < 0.05


def test_split_without_strata(spark):
    df = spark.createDataFrame([(i, "rare" if i == 0 else "x") for i in range(10)], "id bigint, y string")
    assert features.stratified_split(df, "y", by_id(), ["id"]).where("split = 'test'").count() == 2


def test_sample_size_is_exact(mixed_frame):
    assert features.stratified_sample(mixed_frame, "target", 30, by_id(), ["id"]).count() == 30
    assert sum(features.sample_quotas({"a": 7, "b": 5, "c": 1}, 6).values()) == 6


def test_scaling(mixed_frame):
    for method in ("standard", "minmax", "robust"):
        scaler = features.fit_scaler(mixed_frame, ["numeric_1", "constant_col"], method)
        row = features.scale(mixed_frame, scaler).agg(F.avg("numeric_1").alias("m"), F.stddev_pop("numeric_1").alias("s"), F.min("numeric_1").alias("lo"), F.max("numeric_1").alias("hi"),
                                                      F.median("numeric_1").alias("mid"), F.max("constant_col").alias("k")).first()
        assert abs(row["k"]) < 1e-12
        expected = {"standard": (row["m"], 0.0, row["s"], 1.0), "minmax": (row["lo"], 0.0, row["hi"], 1.0), "robust": (row["mid"], 0.0, 0.0, 0.0)}[method]
        assert expected[0] == pytest.approx(expected[1], abs=1e-7) and expected[2] == pytest.approx(expected[3], abs=1e-7)
    with pytest.raises(ValueError):
        features.fit_scaler(mixed_frame, ["numeric_1"], "other")


def test_one_hot_unknown_value(spark, mixed_frame):
    known = features.categories(mixed_frame, "target")
    unseen = spark.createDataFrame([("TypeZ",)], "categorical_col string")
    row = features.one_hot(unseen, known).first().asDict()
    assert row == {"categorical_col_TypeA": 0.0, "categorical_col_TypeB": 0.0, "categorical_col_TypeC": 0.0}
    with pytest.raises(ValueError):
        features.categories(mixed_frame, "target", most=2)


def test_preprocessing(spark, mixed_frame, tmp_path):
    fitted, selection = features.fit_preprocessing(mixed_frame, NAMES, "target", by_id(), ["id"], keep=4)
    assert selection.constant == ["constant_col"] and selection.low_variance == ["low_var_col"]
    assert selection.duplicate == ["duplicate_col"] and selection.correlated == ["numeric_3"]
    assert len(selection.selected) == 4
    fitted.write().overwrite().save(str(tmp_path / "pre"))
    again = PipelineModel.load(str(tmp_path / "pre")).transform(mixed_frame)
    assert [str(r) for r in again.collect()] == [str(r) for r in fitted.transform(mixed_frame).collect()]
    reasons = {r["feature"]: (r["selected"], r["stage"], r["rfe_rank"]) for r in selection.summary(spark).collect()}
    assert reasons["constant_col"] == (False, "constant", None)
    with pytest.raises(ValueError):
        features.select_features(features.label_indexer(mixed_frame, "target").transform(mixed_frame), ["constant_col"], "target", "label_index", by_id(), ["id"])


def test_class_weights_sum_to_rows(mixed_frame):
    rows = features.class_weights(mixed_frame, "target").collect()
    assert sum(r["rows"] * r["weight"] for r in rows) == pytest.approx(400)


def _auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ordered = s[order]
    i = 0
    while i < len(s):
        j = i
        while j + 1 < len(s) and ordered[j + 1] == ordered[i]:
            j += 1
        ranks[order[i:j + 1]] = (i + j) / 2 + 1
        i = j + 1
    n1 = y.sum()
    return (ranks[y].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize("task", [1_000_000, 40])
def test_binary_auc_uses_class_one(spark, task):
    rng = np.random.default_rng(1)
    y = rng.random(300) < 0.3
    s = np.round(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1), 2)
    df = spark.createDataFrame([("m", int(a), int(b > 0.5), [float(1 - b), float(b)]) for a, b in zip(y, s)], "model string, y int, pred int, probabilities array<double>")
    row = metrics.area_scores(metrics.score_steps(df, rows_per_task=task)).first()
    assert row["roc_auc"] == pytest.approx(_auc(y, s))


def test_confusion_edges(spark):
    df = spark.createDataFrame([("m", 0, 0), ("m", 0, 1)], "model string, y int, pred int")
    row = metrics.metric_suite(df).first()
    assert (row["accuracy"], row["recall_macro"], row["balanced_accuracy"], row["mcc"]) == (0.5, 0.25, 0.5, 0.0)
    assert row["fnr"] == 0.25 and row["specificity"] == pytest.approx(0.25)


def test_ranking_skips_missing_columns(spark):
    df = spark.createDataFrame([("a", 0.5, 0.2), ("b", 0.5, 0.1)], "model string, f1_macro double, fpr double")
    assert [r["model"] for r in metrics.rank_models(df).orderBy("rank").collect()] == ["b", "a"]
    notes = {r["model"]: r for r in metrics.model_remarks(metrics.rank_models(df)).collect()}
    assert "Lowest FPR" in notes["b"]["strengths"] and "Best F1" in notes["b"]["strengths"] and notes["a"]["strengths"] == []
    assert notes["a"]["weaknesses"] == ["f1_below_0.7", "fpr_above_0.01"]


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x = rng.normal(size=4)
        rows.append((i, *map(float, x), float(0 if x[0] > -0.3 else 1 if x[1] > 0 else 2)))
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, label_index double")
    return VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(df).withColumn("weight", F.lit(1.0)).cache()


def test_every_registered_model_trains(learnable):
    quick = {"random_forest": {"numTrees": 5, "maxDepth": 5}, "extra_trees": {"numTrees": 5, "maxDepth": 5}, "decision_tree": {"maxDepth": 5},
             "logistic_regression": {"maxIter": 10}, "boosted_trees": {"maxIter": 2, "maxDepth": 3}}
    best, ranked = training.train_and_rank([*quick, "absent"], learnable, learnable, settings=quick)
    rows = ranked.collect()
    assert {r["model"] for r in rows} == set(quick) and best.name in quick
    assert all(0 <= r["f1_macro"] <= 1 and r["roc_auc"] > 0.5 for r in rows)
    assert training.run_metadata(best, learnable, list("abcd")).first()["rows"] == 600


def test_a_model_that_fails_is_no_result(learnable, monkeypatch):
    """a table without a registered model that failed looked whole."""
    def broken(seed, weighted, **given):
        raise OSError("no space left")
    monkeypatch.setitem(training.REGISTRY, "broken", broken)
    quick = {"decision_tree": {"maxDepth": 2}}
    with pytest.raises(RuntimeError, match="'broken' failed: OSError: no space left"):
        training.train_and_rank(["decision_tree", "broken"], learnable, learnable, settings=quick)
    with pytest.warns(UserWarning, match="not ranked.*no space left"):
        _, ranked = training.train_and_rank(["decision_tree", "broken"], learnable, learnable, settings=quick, skip_failed=True)
    assert [r["model"] for r in ranked.collect()] == ["decision_tree"]


def test_unknown_model():
    with pytest.raises(ValueError):
        training.build("absent")
    with pytest.raises(ValueError):
        training.search("absent", None)


def test_scoring_saving_and_external(spark, learnable, tmp_path):
    fitted = training.Trained("decision_tree", training.build("decision_tree", maxDepth=4).fit(learnable), 0.0)
    training.save_model(fitted, str(tmp_path))
    scored = training.predict(training.load_model(spark, str(tmp_path), "decision_tree"), learnable)
    assert scored.select(F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1))).first()[0] < 1e-9
    table = training.prediction_table(scored, "decision_tree", ["BENIGN", "DDoS"], ["id"])
    assert table.columns[1:] == ["Attack_Type", "Prediction_Confidence", "Risk_Score", "Risk_Level", "Class_Probabilities", "Model_Name", "Prediction_Time_ms"]
    assert {r[0] for r in table.select("Attack_Type").distinct().collect()} <= {"BENIGN", "DDoS", "2"}
    assert table.where("Risk_Score < 0 OR Risk_Score > 100").count() == 0
    other = training.external_model(lambda part: ((part["a"] > 0).astype(int), None), ["a"], "id bigint, a double")(learnable.select("id", "a"))
    row = training.prediction_table(other, "plain", ["BENIGN", "DDoS"], ["id"]).first()
    assert row["Prediction_Confidence"] == 1.0 and row["Class_Probabilities"] == {row["Attack_Type"]: 1.0}


def test_boosted_probabilities_sum_to_one(learnable):
    model = training.build("boosted_trees", early_stopping=True, maxIter=2, maxDepth=3).fit(learnable.withColumn("is_validation", F.col("id") % 10 == 0))
    scored = training.predict(model, learnable)
    assert scored.select(F.max(F.abs(F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x) - 1))).first()[0] < 1e-9


def test_best_round_waits_for_its_patience():
    assert training.best_round([5, 4, 3, 3.5, 3.4, 2, 1], 3) == 7
    assert training.best_round([5, 4, 3, 3.5, 3.4, 3.2, 1], 3) == 3
    assert training.best_round([1.0], 10) == 1 and training.best_round([3, 2, 1], 10) == 3


def test_boosting_stops_at_the_best_round(learnable):
    noise = learnable.withColumn("label_index", (F.xxhash64("id") % 2 == 0).cast("double")).withColumn("is_validation", F.col("id") % 3 == 0)
    model = training.build("boosted_trees", early_stopping=True, maxIter=15, maxDepth=4, patience=2).fit(noise)
    assert all(1 <= s.getNumTrees < 15 for s in model.stages)


def test_search(learnable):
    folded = training.with_folds(learnable, 3, ["id"])
    assert {r["id"]: r["fold"] for r in folded.collect()} == {r["id"]: r["fold"] for r in training.with_folds(learnable.where("id < 600").repartition(5), 3, ["id"]).collect()}
    assert {r["fold"] for r in folded.collect()} == {0, 1, 2}
    best, table = training.search("decision_tree", folded, 3, "grid", space={"maxDepth": [1, 4]})
    assert best == {"maxDepth": 4} and table.where("best").count() == 1
    boosted, _ = training.search("boosted_trees", folded, 3, "random", 1, space={"maxIter": [1], "maxDepth": [2, 3]})
    assert set(boosted) == {"maxIter", "maxDepth"}
    draws = training.candidates(training.SEARCH_SPACES["random_forest"], draws=5)
    assert len({str(d) for d in draws}) == 5 and draws == training.candidates(training.SEARCH_SPACES["random_forest"], draws=5)


def test_explanations(spark, learnable):
    model = training.build("random_forest", numTrees=5, maxDepth=5).fit(learnable)
    tree = explain.tree_importance(spark, model, list("abcd"), "f")
    assert sum(r["normalized_importance"] for r in tree.collect()) == pytest.approx(1.0)
    shuffled = explain.permutation_importance(model, learnable.limit(300), "id", list("abcd"), "f", repeats=2)
    rows = {r["feature"]: r for r in explain.join_importances(tree, shuffled).collect()}
    assert rows["a"]["permutation_mean"] > rows["c"]["permutation_mean"] and rows["a"]["permutation_rank"] <= 2
    assert all(r["permutation_normalized"] >= 0 for r in rows.values())
    curve = explain.partial_dependence(model, learnable.limit(100), list("abcd"), ["a"], 5).where("class = 0").orderBy("value").collect()
    assert len(curve) == 5 and curve[0]["average"] < curve[-1]["average"]
    linear = training.build("logistic_regression", maxIter=5).fit(learnable)
    assert {r["raw_importance"] for r in explain.tree_importance(spark, linear, list("abcd"), "l").collect()} == {0.25}


def test_shapley_adds_up(learnable):
    model = training.build("random_forest", numTrees=4, maxDepth=4).fit(learnable)
    rows, base = learnable.where("id < 12"), learnable.where("id >= 300 AND id < 310")
    values = explain.shapley_values(model, rows, "id", base, "id", list("abcd"))
    sums = {(r["key"], r["class"]): r["s"] for r in values.groupBy("key", "class").agg(F.sum("contribution").alias("s")).collect()}
    mean = training.predict(model, base).select(F.avg(F.get("probabilities", F.lit(1)))).first()[0]
    for r in training.predict(model, rows).select("id", F.get("probabilities", F.lit(1)).alias("p")).collect():
        assert sums[r["id"], 1] == pytest.approx(r["p"] - mean, abs=1e-9)
    assert explain.global_explanation(values).where("rank = 1").first()["feature"] in "ab"
    local = explain.local_explanation(values)
    assert local.count() == 10 and {"a_contribution", "a_value"} <= set(local.columns)


def _class_rows(spark, copies):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        point = [1.0, 1.0] if copies and i % 3 == 0 else [rng.gauss(0, 3), rng.gauss(0, 1)]
        rows.append((i, "small" if i < 60 else "mid" if i < 140 else "big", point))
    return spark.createDataFrame(rows, "id bigint, y string, v array<double>"), rows


@pytest.mark.parametrize("copies", [False, True])
def test_neighbours_are_exact(spark, copies):
    df, rows = _class_rows(spark, copies)
    found = {r["id"]: r["neighbours"] for r in resample.nearest_in_class(df, "y", "v", 5, block_rows=7, fan=3).collect()}
    for i, y, point in rows:
        best = sorted(np.hypot(point[0] - q[0], point[1] - q[1]) for j, z, q in rows if z == y and j != i)[:5]
        assert np.allclose(sorted(np.hypot(point[0] - q[0], point[1] - q[1]) for q in found[i]), best)


def test_blocks_follow_the_distance_not_the_spread_of_values(spark):
    """One wide dimension beside two narrow ones: blocks are cut along the wide one, so few of them are within reach."""
    rng = np.random.default_rng(5)
    points = np.column_stack([rng.integers(0, 60_000, 4000), rng.integers(0, 11, 4000), rng.integers(0, 9, 4000)]).astype(float)
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id bigint, v array<double>")
    boxes = resample._box_order(rows, "v", 3, 4000, 100).groupBy("z").agg(F.count("*").alias("n"), *[(F.max(F.col("v")[d]) - F.min(F.col("v")[d])).alias(f"s{d}") for d in range(3)]).collect()
    assert sum(b["n"] for b in boxes) == 4000 and len(boxes) >= 40 and max(b["n"] for b in boxes) < 400
    assert max(b["s0"] for b in boxes) < 60_000 / 16  # an equal share of cuts for each dimension leaves 60,000 / 8 or more
    odd = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [3.0, 4.0])], "id bigint, v array<double>")
    assert resample._box_order(odd, "v", 2, 4, 1).where("z IS NULL").count() == 0


def test_smote_balances(spark):
    df, rows = _class_rows(spark, False)
    out = resample.smote(df, "y", "v", block_rows=11)
    counts = {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts == {("big", False): 100, ("mid", False): 80, ("mid", True): 20, ("small", False): 60, ("small", True): 40}
    assert sorted(map(str, out.collect())) == sorted(map(str, resample.smote(df, "y", "v", block_rows=11).collect()))
    low, high = min(q[0] for _, z, q in rows if z == "small"), max(q[0] for _, z, q in rows if z == "small")
    assert out.where("synthetic AND y = 'small'").where((F.col("vector")[0] < low) | (F.col("vector")[0] > high)).count() == 0


def test_smote_of_a_single_row_class(spark):
    df = spark.createDataFrame([(i, "one" if i == 0 else "many", [float(i)]) for i in range(20)], "id bigint, y string, v array<double>")
    assert resample.smote(df, "y", "v").count() == 2


def test_folds_of_every_class_differ_by_at_most_one(spark):
    rows = [(i, float(0 if i < 7 else 1 if i < 400 else 2)) for i in range(900)] + [(i, None) for i in range(3)]
    df = spark.createDataFrame(rows, "id bigint, label_index double")
    found = training.with_folds(df, 5, ["id"])
    counts = {}
    for r in found.groupBy("label_index", "fold").count().collect():
        counts.setdefault(r["label_index"], {})[r["fold"]] = r["count"]
    for label, n in ((0.0, 7), (1.0, 393), (2.0, 500), (None, 3)):
        sizes = [counts[label].get(k, 0) for k in range(5)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    again = {(r["id"], r["label_index"]): r["fold"] for r in training.with_folds(df.repartition(3), 5, ["id"]).collect()}
    assert again == {(r["id"], r["label_index"]): r["fold"] for r in found.collect()}


def test_logistic_penalty_follows_the_rows(spark, learnable):
    """The penalty of a summed loss does not weaken when every row is doubled; weights count as rows."""
    few = learnable.limit(100).cache()
    assert training.build("logistic_regression").fit(few).getRegParam() == 1 / 100
    doubled = few.unionByName(few)
    assert training.build("logistic_regression").fit(doubled).getRegParam() == 1 / 200
    heavy = few.withColumn("weight", F.lit(2.0))
    assert training.build("logistic_regression", weighted=True, c=4.0).fit(heavy).getRegParam() == 1 / 800
    same = training.build("logistic_regression").fit(doubled).coefficientMatrix.toArray()
    # The same loss but for rounding: both end within the tolerance of the optimiser.
    assert np.allclose(same, training.build("logistic_regression", weighted=True).fit(heavy).coefficientMatrix.toArray(), atol=0.05)
    assert training.build("logistic_regression", regParam=0.5).fit(few).getRegParam() == 0.5


@pytest.mark.parametrize("name, settings", [("decision_tree", {}), ("random_forest", {"maxDepth": 9}), ("extra_trees", {}), ("decision_tree", {"maxDepth": 0})])
def test_batch_walk_equals_the_model(spark, learnable, name, settings):
    """The same shares to the last bit, also for absent values; and through a pipeline."""
    model = training.build(name, **settings).fit(learnable)
    odd = learnable.withColumn("a", F.when(F.col("id") % 7 == 0, float("nan")).otherwise(F.col("a"))).drop("features")
    vectors = VectorAssembler(inputCols=list("abcd"), outputCol="features", handleInvalid="keep")
    for some in (learnable, vectors.transform(odd)):
        want = {r["id"]: (list(r["probabilities"]), r["pred"]) for r in training.with_probabilities(model.transform(some)).collect()}
        assert {r["id"]: (list(r["probabilities"]), r["pred"]) for r in training.predict(model, some).collect()} == want
    piped = training.predict(PipelineModel([vectors, model]), odd)
    assert {r["id"]: (list(r["probabilities"]), r["pred"]) for r in piped.collect()} == want
    assert training.predict(model, learnable.limit(0)).collect() == []


def test_no_tree_is_fitted_after_the_patience_ran_out(learnable, monkeypatch):
    noise = learnable.withColumn("label_index", F.pmod(F.xxhash64("id"), F.lit(3)).cast("double")).withColumn("is_validation", F.col("id") % 3 == 0)
    fitted = []
    grow = training.BoostedTrees._tree
    monkeypatch.setattr(training.BoostedTrees, "_tree", lambda self, rows, margins, k, number: fitted.append((number, k)) or grow(self, rows, margins, k, number))
    model = training.build("boosted_trees", early_stopping=True, maxIter=30, maxDepth=4, patience=3).fit(noise)
    kept = {s.getNumTrees for s in model.stages}
    assert len(kept) == 1 and len(model.stages) == 3
    assert max(n for n, _ in fitted) + 1 == kept.pop() + 3 and len(fitted) == len(set(fitted))


def test_boosting_keeps_the_rows_of_a_round_and_lets_them_go(spark, learnable, monkeypatch):
    """the jobs of a round read kept margins; nothing is kept after a fit, nor after one that fails."""
    kept = []
    persist = type(learnable).persist
    monkeypatch.setattr(type(learnable), "persist", lambda self, *given: kept.append(self) or persist(self, *given))
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    training.build("boosted_trees", maxIter=6, maxDepth=2).fit(learnable)
    assert len(kept) == 5 and spark.sparkContext._jsc.getPersistentRDDs().size() == before
    grow = training.BoostedTrees._tree
    monkeypatch.setattr(training.BoostedTrees, "_tree", lambda self, rows, margins, k, number: grow(self, rows, margins, k, number) if number < 2 else 1 / 0)
    with pytest.raises(ZeroDivisionError):
        training.build("boosted_trees", maxIter=6, maxDepth=2).fit(learnable)
    assert len(kept) == 7 and spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_batch_walk_counts_a_repeated_flow_as_often_as_it_comes(spark, tmp_path):
    """every row is scored where it lies, so equal keys do not multiply."""
    rng = np.random.default_rng(12)
    rows = [(i // 2, i // 2, i // 2 % 7, 1, float(i // 2 % 50 + 1), float(rng.integers(0, 2) * 70000 + i // 2), i // 2 % 11 / 100, i // 2 % 9 / 100) for i in range(0, 400)]
    rows += rows[:100]
    made = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
    made.withColumns({"l_returnflag": F.lit("A"), "l_linestatus": F.lit("O"), "l_shipdate": F.lit("1998-01-01").cast("timestamp_ntz")}).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in small_queries.batch_walk(spark, str(tmp_path)).collect()] == [(500, 0, 0)]


def test_boosting_learns_as_well_as_one_against_the_rest(spark, learnable, tmp_path):
    model = training.build("boosted_trees", maxIter=10, maxDepth=3).fit(learnable)
    f1 = training.MacroF1().evaluate(model.transform(learnable))
    from pyspark.ml.classification import GBTClassifier
    shares = learnable
    for k in range(3):
        one = GBTClassifier(labelCol="_is", maxIter=10, stepSize=0.1, maxDepth=3, subsamplingRate=0.8, seed=42, predictionCol=f"p{k}")
        one = one.setRawPredictionCol(f"r{k}").setProbabilityCol(f"probability_{k}")
        shares = one.fit(learnable.withColumn("_is", (F.col("label_index") == k).cast("double"))).transform(shares)
    assert f1 >= training.MacroF1().evaluate(shares) - 1e-9
    path = training.save_model(training.Trained("boosted_trees", model, 0.0), str(tmp_path))
    assert path and [r["pred"] for r in training.predict(training.load_model(spark, str(tmp_path), "boosted_trees"), learnable).orderBy("id").collect()] == [
        r["pred"] for r in training.predict(model, learnable).orderBy("id").collect()]


def _ross(x, y, k):
    """The estimate row by row."""
    from math import inf
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, n))
    kept = [i for i in range(len(x)) if sum(z == y[i] for z in y) > 1]
    total = 0.0
    for i in kept:
        same = sorted(abs(x[j] - x[i]) for j in kept if y[j] == y[i] and j != i)
        near, size = min(k, len(same)), len(same) + 1
        r = same[near - 1]
        m = sum((x[i] - r < x[j] < x[i] + r) if r > 0 else x[j] == x[i] for j in kept)
        total += psi(near) - psi(size) - psi(m)
    return max(0.0, psi(len(kept)) + total / len(kept)) if kept else -inf


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbour_information_equals_brute_force(spark, parts):
    rng = random.Random(parts)
    rows = []
    for i in range(240):
        y = rng.choice(["a", "b", "b", "c"]) if i else "alone"
        rows.append((y, rng.gauss(0, 1) + (y == "b"), float(rng.randrange(5)) + (y == "c"), None if rng.random() < 0.3 else rng.random(), 7.0))
    rows += [(None, 1.0, 1.0, 1.0, 7.0), ("a", float("nan"), float("inf"), 0.5, 7.0)]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "y string, smooth double, few double, gaps double, one double")
        found = {r["feature"]: r["mi_score"] for r in neighbours.neighbour_information(df, ["smooth", "few", "gaps", "one"], "y").collect()}
        for at, name in enumerate(["smooth", "few", "gaps", "one"], 1):
            kept = [r for r in rows if r[0] is not None and r[at] is not None and abs(r[at]) < float("inf")]
            assert found[name] == pytest.approx(_ross([r[at] for r in kept], [r[0] for r in kept], 3), abs=1e-9), name
        assert [r["mi_score"] for r in neighbours.neighbour_information(df.limit(0), ["few"], "y").collect()] == [0.0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _node_rows(model, rows):
    """Every inner node of every tree: feature, threshold, and the rows that reach it."""
    flat = forest.flatten(model)
    out = []
    for root in flat.roots:
        stack = [(int(root), np.arange(len(rows)))]
        while stack:
            node, at = stack.pop()
            step = int(flat.steps[node])
            left, feature, cut = step >> 32, (step >> 16) & 0xFFFF, step & 0xFFFF
            if left == node:
                continue
            threshold = flat.thresholds[feature][cut]
            below = rows[at, feature] <= threshold
            out.append((feature, threshold, at))
            stack += [(left, at[below]), (left + 1, at[~below])]
    return out


def test_extra_trees_draw_their_thresholds(spark, learnable):
    settings = {"numTrees": 8, "maxDepth": 6, "minInstancesPerNode": 3, "featureSubsetStrategy": "2"}
    model = training.build("extra_trees", **settings).fit(learnable)
    again = training.build("extra_trees", **settings).fit(learnable.repartition(5))
    assert model.toDebugString.split("\n")[1:] == again.toDebugString.split("\n")[1:] and model.getNumTrees == 8
    assert training.build("extra_trees", seed=1, **settings).fit(learnable).toDebugString.split("\n")[1:] != model.toDebugString.split("\n")[1:]
    data = learnable.orderBy("id").toPandas()
    x, y = data[list("abcd")].to_numpy(), data["label_index"].to_numpy()
    inner = _node_rows(model, x)
    optimal = 0
    for feature, threshold, at in inner:
        v = x[at, feature]
        assert v.min() <= threshold < v.max() and 3 <= (v <= threshold).sum() <= len(at) - 3

        def cost(cut):
            sides = [y[at][v <= cut], y[at][v > cut]]
            return sum(len(s) - sum((s == c).sum() ** 2 for c in range(3)) / max(1, len(s)) for s in sides)
        optimal += cost(threshold) <= min(cost(c) for c in np.unique(v)[:-1]) + 1e-9
    assert len(inner) > 100 and optimal < len(inner) / 2
    assert len({f for f, _, at in inner if len(at) == 600}) > 1  # trees differ from the root on
    assert training.MacroF1().evaluate(training.build("extra_trees", numTrees=20, maxDepth=12).fit(learnable).transform(learnable)) > 0.9
    one = learnable.withColumn("label_index", F.lit(1.0))
    assert training.build("extra_trees", numTrees=2).fit(one).totalNumNodes == 2


def test_extra_trees_count_weights(spark):
    rows = [(float(i % 10), float(i % 2), 1.0 if i % 2 else 3.0) for i in range(60)]
    df = VectorAssembler(inputCols=["v"], outputCol="features").transform(spark.createDataFrame(rows, "v double, label_index double, weight double"))
    model = training.build("extra_trees", weighted=True, numTrees=1, maxDepth=1).fit(df)
    flat = forest.flatten(model)
    assert np.allclose(flat.shares[flat.roots[0]], [0.75, 0.25])


def test_moves_are_scored_where_the_rows_lie(spark, learnable, monkeypatch):
    """Dependence, contributions and swaps of a forest: no row is multiplied in Spark, and the results are those of the general way."""
    model = training.build("random_forest", numTrees=4, maxDepth=6).fit(learnable)
    some, base = learnable.where("id < 90").cache(), learnable.where("id >= 300 AND id < 305")

    def found():
        curve = explain.partial_dependence(model, some, list("abcd"), ["a", "c"], 6)
        values = explain.shapley_values(model, some, "id", base, "id", list("abcd"))
        swaps = explain.permutation_importance(model, some, "id", list("abcd"), "f", repeats=2)
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (curve, values)]
        return plans, ({(r["feature"], r["value"], r["class"]): r["average"] for r in curve.collect()},
                       {(r["key"], r["feature"], r["class"], r["value"]): r["contribution"] for r in values.collect()},
                       {r["feature"]: r["permutation_mean"] for r in swaps.collect()})
    plans, fast = found()
    assert "explode(" not in plans[0] and "lag(" not in plans[1]
    monkeypatch.setattr(forest, "flatten", lambda model: None)
    for a, b in zip(fast, found()[1]):
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in b)


def test_contributions_of_a_repeated_row_are_those_of_the_general_way(learnable, monkeypatch):
    model = training.build("random_forest", numTrees=4, maxDepth=4).fit(learnable)
    rows, base = learnable.where("id < 5").cache(), learnable.where("id >= 300 AND id < 310")

    def found():
        values = explain.shapley_values(model, rows.unionByName(rows.where("id < 2")), "id", base, "id", list("abcd"))
        return {(r["key"], r["feature"], r["class"], r["value"]): r["contribution"] for r in values.collect()}
    fast = found()
    monkeypatch.setattr(forest, "flatten", lambda model: None)
    slow = found()
    assert fast.keys() == slow.keys() and all(fast[k] == pytest.approx(slow[k], abs=1e-12) for k in slow)


def test_learning_curve_moves_the_rows_once(learnable, monkeypatch):
    """Folds of every size as if each had its own sample and sort, from one sort of the rows."""
    ties, sizes, mixed = ["id"], [0.1, 0.37, 1.0], F.pmod(F.col("id") * 48271, F.lit(2147483647))
    total = learnable.count()
    want = [{(r["id"], r["fold"]) for r in training.with_folds(features.stratified_sample(learnable, "label_index", max(3, round(total * s)), mixed, ties), 3, ties).collect()}
            for s in sizes]
    sorts, seen, sort = [], [], training.running_totals
    monkeypatch.setattr(training, "running_totals", lambda *given, **more: sorts.append(1) or sort(*given, **more))
    monkeypatch.setattr(training, "_fold_scores", lambda estimator, rows, folds: seen.append({(r["id"], r["fold"]) for r in rows.collect()}) or {"test": (0.5, 0.0)})
    curve = training.learning_curve("decision_tree", learnable, mixed, ties, sizes)
    assert seen == want and [len(s) for s in seen] == [round(total * s) for s in sizes]
    assert len(sorts) == 1 and curve.count() == 3


def test_forest_is_fitted_in_few_tasks_with_sparks_trees(spark, learnable):
    many = learnable.repartition(64, "id")
    few = many.coalesce(2 * spark.sparkContext.defaultParallelism)
    ours = training.build("random_forest", numTrees=4, maxDepth=6).fit(many)
    plain = training.RandomForestClassifier(featuresCol="features", labelCol="label_index", seed=42, numTrees=4, maxDepth=6).fit(few)
    assert ours.toDebugString.splitlines()[1:] == plain.toDebugString.splitlines()[1:]


def test_class_presets_sort_no_rows(spark):
    rows = [(7, None, 1.0, 1), (3, 5.0, None, 1), (3, 6.0, 2.0, 1), (1, 9.0, 9.0, 0), (4, None, 8.0, 2)]
    found = explain.class_presets(spark.createDataFrame(rows, "id bigint, a double, b double, pred int").coalesce(1), "id", [1, 2], ["a", "b"])
    assert "SortAggregate" not in found._jdf.queryExecution().toString()
    normal, tied, last = sorted(map(tuple, found.collect()))
    assert normal == (0, 1, None, None, None) and last == (2, 1, 4, None, 8.0)
    assert tied in [(1, 3, 3, 5.0, None), (1, 3, 3, 6.0, 2.0)]  # of equal ids one whole row


@pytest.mark.parametrize("count, given", [(3000, {"maxDepth": 5}), (14_000, {"maxDepth": 4}), (30_000, {"maxDepth": 3, "featureSubsetStrategy": "0.7", "minInstancesPerNode": 40, "maxBins": 20})])
def test_boosted_trees_are_those_of_spark(spark, count, given):
    """the passes over packed rows grow the trees of Spark's own regressor, which took ten times as long."""
    rng = np.random.default_rng(7)
    a = np.stack([rng.normal(size=count), rng.integers(0, 9, count) / 2.0 - 1, rng.exponential(2, count), rng.integers(0, 2, count)], axis=1)
    y = np.where(a[:, 0] + a[:, 1] > 0.4, 0, np.where(a[:, 2] * a[:, 3] > 1, 1, 2))
    made = spark.createDataFrame([(i, *map(float, x), float(k), float(0.5 + i % 3)) for i, (x, k) in enumerate(zip(a, y, strict=True))], "id bigint, a double, b double, c double, d double, label_index double, weight double")
    rows = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(made).repartition(5, "id").localCheckpoint()
    model = training.build("boosted_trees", seed=11, weighted=True, maxIter=3, stepSize=0.3, **given).fit(rows)
    margins, settings = rows.select("*", *[F.lit(0.0).alias(f"m{k}") for k in range(3)]), {"subsamplingRate": 0.8, "featureSubsetStrategy": "all"} | given
    for number in range(3):
        fitted, margins = [], margins.localCheckpoint()
        for k in range(3):
            share = training._share(["m0", "m1", "m2"], F.lit(k))
            bend = F.greatest(share * (1 - share), F.lit(1e-6))
            aim = F.greatest(F.least(((F.col("label_index") == k).cast("double") - share) / bend, F.lit(4.0)), F.lit(-4.0))
            one = RandomForestRegressor(labelCol="t", weightCol="w", seed=11 + 1000 * number + k, numTrees=1, bootstrap=False, **settings)
            fitted.append(one.fit(margins.withColumns({"t": aim, "w": bend * F.col("weight")})).trees[0])
        for k, tree in enumerate(fitted):
            ours, theirs = (re.split(r"(-?\d+\.\d+(?:E-?\d+)?)", t.toDebugString.split("\n", 1)[1]) for t in (model.stages[k].trees[number], tree))
            assert ours[::2] == theirs[::2] and np.allclose([float(x) for x in ours[1::2]], [float(x) for x in theirs[1::2]], rtol=1e-9, atol=1e-12)
            margins = tree.setPredictionCol("p").transform(margins).withColumn(f"m{k}", F.col(f"m{k}") + 0.3 * F.col("p")).drop("p")


def test_search_compares_near_leaves_only(spark, monkeypatch):
    """all pairs of a block were compared, and neighbours sought for rows that are not copied."""
    rng = np.random.default_rng(3)
    points, ids = np.round(rng.normal(size=(3000, 3)), 2), np.arange(3000)
    points[:300] = points[300:600]
    points[7], seen, squares = [float("nan"), 0.0, 0.0], [], resample._squares
    monkeypatch.setattr(resample, "_squares", lambda a, b: seen.append(len(a) * len(b)) or squares(a, b))
    apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    apart[ids, ids] = np.inf
    want = np.sort(apart, axis=1)[:, :5]
    found = {i: sorted(f["distance"] for f in some) for i, some in zip(*(resample._nearest(points, ids, points, ids, 5)[c].to_pylist() for c in ("id", "found")), strict=True)}
    assert len(found) == 2999 and all(np.allclose(found[i], want[i]) for i in found) and sum(seen) < 3000 * 3000 / 4
    near = resample._nearest(points[:50], ids[:50], points[1000:], ids[1000:], 5, np.full(50, 0.2))
    for i, some in zip(*(near[c].to_pylist() for c in ("id", "found")), strict=True):
        assert {round(f["distance"], 9) for f in some if f["distance"] <= 0.2} == {round(d, 9) for d in sorted(apart[i, 1000:])[:5] if d <= 0.2}
    asked, within = [], resample.nearest_in_class
    monkeypatch.setattr(resample, "nearest_in_class", lambda rows, *given, **more: asked.append(within(rows, *given, **more)) or asked[0])
    rows = spark.createDataFrame([(i, "few" if i < 60 else "most", [float(i % 13), float(i)]) for i in range(140)], "id bigint, y string, v array<double>")
    assert {(r["y"], r["synthetic"]): r["count"] for r in resample.smote(rows, "y", "v").groupBy("y", "synthetic").count().collect()} == {("few", False): 60, ("few", True): 20, ("most", False): 80}
    assert asked[0].count() == 20


def test_neighbours_with_absent_values_and_ids(spark):
    """a row without an id is a neighbour and asks for none; a row with an absent number has no neighbours."""
    rows = [(i, "y", [float(i), 0.0]) for i in range(30)] + [(None, "y", [0.5, 0.0]), (99, "y", [3.0, None]), (98, "y", [float("nan"), 0.0])]
    for block_rows in (10_000, 6):
        found = {r["id"]: r["neighbours"] for r in resample.nearest_in_class(spark.createDataFrame(rows, "id bigint, y string, v array<double>"), "y", "v", 2, block_rows).collect()}
        assert set(found) == set(range(30)) and found[0] == [[0.5, 0.0], [1.0, 0.0]] and sorted(found[7]) == [[6.0, 0.0], [8.0, 0.0]]
