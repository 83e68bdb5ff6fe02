"""Named queries over predictions, and the training, search and explanation jobs."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowguard.operators import features, metrics, resample
from flowguard.plans import explain, training
from flowguard.plans.catalog import query
from flowguard.session import cut_lineage, table_state
from flowguard.sources import views

KEY = views.FLOW_KEY
MODELS = ["alpha", "beta"]
# Model beta is right more often: it errs only where the mixed key ends in 8 or 9.
SCORED_SQL = """
    s AS (SELECT 'alpha' AS model, y, pred, p0, p1, p2 FROM scored
          UNION ALL SELECT 'beta', y, CASE WHEN m % 10 < 8 THEN y ELSE pred END, p1, p2, p0 FROM scored)"""


def _scored(spark, folder):
    scored = views.scored(spark, folder)
    alpha = scored.select(F.lit("alpha").alias("model"), "y", "pred", F.array("p0", "p1", "p2").alias("probabilities"))
    beta = scored.select(F.lit("beta").alias("model"), "y", F.when(F.col("m") % 10 < 8, F.col("y")).otherwise(F.col("pred")).alias("pred"),
                         F.array("p1", "p2", "p0").alias("probabilities"))
    return alpha.unionByName(beta)


def _six(df, digits=6):
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


@query("confusion_matrix", "scored", f"""
    WITH {SCORED_SQL} SELECT model, y, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY model, y)::DOUBLE, 6) AS share
    FROM s GROUP BY model, y, pred""")
def confusion_matrix(spark, folder):
    return _six(metrics.confusion_matrix(_scored(spark, folder)))


CLASS_SQL = SCORED_SQL + """,
    u AS (SELECT model, y AS class, (y = pred)::INT AS d, 1 AS t, 0 AS p FROM s UNION ALL SELECT model, pred, 0, 0, 1 FROM s),
    b AS (SELECT model, class, sum(d)::DOUBLE AS d, sum(t)::DOUBLE AS t, sum(p)::DOUBLE AS p, sum(sum(t)) OVER (PARTITION BY model)::DOUBLE AS n
          FROM u GROUP BY model, class),
    c0 AS (SELECT *, CASE WHEN p = 0 THEN 0 ELSE d / p END AS pr, CASE WHEN t = 0 THEN 0 ELSE d / t END AS re,
                  CASE WHEN n = t THEN 0 ELSE (p - d) / (n - t) END AS fpr, CASE WHEN t = 0 THEN 0 ELSE (t - d) / t END AS fnr,
                  CASE WHEN n = t THEN 0 ELSE (n - t - p + d) / (n - t) END AS spec FROM b),
    c AS (SELECT *, CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM c0)"""
SUITE_SQL = """
    SELECT model, round(sum(d) / max(n), 6) AS accuracy, round(avg(CASE WHEN t > 0 THEN re END), 6) AS balanced_accuracy,
           round(avg(pr), 6) AS precision_macro, round(sum(t * pr) / sum(t), 6) AS precision_weighted,
           round(avg(re), 6) AS recall_macro, round(sum(t * re) / sum(t), 6) AS recall_weighted,
           round(avg(f1), 6) AS f1_macro, round(sum(t * f1) / sum(t), 6) AS f1_weighted,
           round((max(n) * sum(d) - sum(t * p)) / sqrt((max(n) * max(n) - sum(p * p)) * (max(n) * max(n) - sum(t * t))), 6) AS mcc,
           round((max(n) * sum(d) - sum(t * p)) / (max(n) * max(n) - sum(t * p)), 6) AS kappa,
           round(avg(fpr), 6) AS fpr, round(avg(fnr), 6) AS fnr, round(avg(spec), 6) AS specificity
    FROM c GROUP BY model"""


@query("metric_suite", "scored", f"WITH {CLASS_SQL} {SUITE_SQL}")
def metric_suite(spark, folder):
    return _six(metrics.metric_suite(_scored(spark, folder)))


@query("class_report", "scored", f"""
    WITH {CLASS_SQL}
    SELECT model, class::VARCHAR AS class, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1, t AS support FROM c
    UNION ALL SELECT model, 'accuracy', a, a, a, a FROM (SELECT model, round(sum(d) / sum(t), 6) AS a FROM c GROUP BY model)
    UNION ALL SELECT model, 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), sum(t) FROM c GROUP BY model
    UNION ALL SELECT model, 'weighted avg', round(sum(t * pr) / sum(t), 6), round(sum(t * re) / sum(t), 6), round(sum(t * f1) / sum(t), 6), sum(t)
    FROM c GROUP BY model""")
def class_report(spark, folder):
    return _six(metrics.class_report(_scored(spark, folder)))


LONG_SQL = SCORED_SQL + """,
    l AS (SELECT model, y, unnest([0, 1, 2]) AS class, unnest([p0, p1, p2]) AS score FROM s)"""


@query("roc_auc_ovr", "scored", f"""
    WITH {LONG_SQL},
    r AS (SELECT *, rank() OVER (PARTITION BY model, class ORDER BY score) + (count(*) OVER (PARTITION BY model, class, score) - 1) / 2.0::DOUBLE AS rk FROM l),
    a AS (SELECT model, class, count(*) FILTER (y = class) AS n1, count(*) FILTER (y <> class) AS n0, sum(rk) FILTER (y = class) AS rs FROM r GROUP BY ALL)
    SELECT model, round(avg((rs - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0)), 6) AS roc_auc FROM a GROUP BY model""")
def roc_auc(spark, folder):
    return _six(metrics.area_scores(metrics.score_steps(_scored(spark, folder))).select("model", "roc_auc"))


STEP_SQL = LONG_SQL + """,
    g AS (SELECT model, class, score, count(*) FILTER (y = class) AS pos, count(*) FILTER (y <> class) AS neg FROM l GROUP BY ALL),
    st AS (SELECT *, (sum(pos) OVER w)::BIGINT AS tp, (sum(neg) OVER w)::BIGINT AS fp, (sum(pos) OVER (PARTITION BY model, class))::BIGINT AS PP,
                  (sum(neg) OVER (PARTITION BY model, class))::BIGINT AS NN FROM g WINDOW w AS (PARTITION BY model, class ORDER BY score DESC))"""


@query("pr_auc", "scored", f"""
    WITH {STEP_SQL},
    a AS (SELECT model, class, sum(pos * (tp / (tp + fp)::DOUBLE)) / max(PP) AS ap FROM st GROUP BY ALL)
    SELECT model, round(avg(ap), 6) AS pr_auc FROM a GROUP BY model""")
def pr_auc(spark, folder):
    return _six(metrics.area_scores(metrics.score_steps(_scored(spark, folder))).select("model", "pr_auc"))


GRID_SQL = """
    gr AS (SELECT unnest(range(200)) AS point),
    pts AS (SELECT model, class, {x} AS x, {y} AS v, row_number() OVER (PARTITION BY model, class ORDER BY score DESC) AS i FROM st
            UNION ALL SELECT DISTINCT model, class, 0.0::DOUBLE, {start}, 0 FROM st),
    seg AS (SELECT *, lead(x) OVER w AS x2, lead(v) OVER w AS v2 FROM pts WINDOW w AS (PARTITION BY model, class ORDER BY i)),
    val AS (SELECT model, class, point, CASE WHEN x2 IS NULL THEN v ELSE v + (point / 199.0::DOUBLE - x) / (x2 - x) * (v2 - v) END AS v
            FROM seg JOIN gr ON (round(x * 199, 9) <= point AND round(x2 * 199, 9) > point) OR (x2 IS NULL AND point = 199))"""


@query("roc_points", "scored", f"""
    WITH {STEP_SQL}, {GRID_SQL.format(x='fp / NN::DOUBLE', y='tp / PP::DOUBLE', start='0.0::DOUBLE')}
    SELECT model, point, round(point / 199.0::DOUBLE, 6) AS fpr, round(avg(v), 6) AS tpr FROM val GROUP BY model, point""")
def roc_points(spark, folder):
    return _six(metrics.roc_points(metrics.score_steps(_scored(spark, folder))))


@query("pr_points", "scored", f"""
    WITH {STEP_SQL}, {GRID_SQL.format(x='tp / PP::DOUBLE', y='tp / (tp + fp)::DOUBLE', start='1.0::DOUBLE')}
    SELECT model, point, round(point / 199.0::DOUBLE, 6) AS recall, round(avg(v), 6) AS precision FROM val GROUP BY model, point""")
def pr_points(spark, folder):
    return _six(metrics.pr_points(metrics.score_steps(_scored(spark, folder))))


@query("calibration", "scored", f"""
    WITH {SCORED_SQL}
    SELECT model, least(9, floor(p0 * 10)::BIGINT) AS bin, round(avg(p0), 6) AS mean_predicted, round(avg((y = 0)::INT), 6) AS fraction_positive, count(*) AS rows
    FROM s GROUP BY ALL""")
def calibration(spark, folder):
    return _six(metrics.calibration(_scored(spark, folder)))


SUITE_RANK = f"""
    WITH {CLASS_SQL}, q AS ({SUITE_SQL}),
    k AS (SELECT *, row_number() OVER (ORDER BY f1_macro DESC, recall_macro DESC, fpr, model)::INT AS rank FROM q)"""


@query("model_ranking", "scored", f"{SUITE_RANK} SELECT model, rank, f1_macro, recall_macro, fpr FROM k")
def model_ranking(spark, folder):
    return metrics.rank_models(_six(metrics.metric_suite(_scored(spark, folder)))).select("model", "rank", "f1_macro", "recall_macro", "fpr")


AREA_SQL = STEP_SQL.removeprefix(SCORED_SQL) + """,
    ar AS (SELECT model, class, sum(pos * (tp / (tp + fp)::DOUBLE)) / max(PP) AS ap,
                  sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / (max(PP)::DOUBLE * max(NN)) AS auc FROM st GROUP BY ALL),
    aa AS (SELECT model, round(avg(auc), 6) AS roc_auc FROM ar GROUP BY model)"""
LEADER_SQL = SUITE_RANK + AREA_SQL + f""",
    kk AS (SELECT k.*, aa.roc_auc, CASE k.model WHEN 'alpha' THEN 0.5 ELSE 6.0 END::DOUBLE AS prediction_seconds FROM k JOIN aa ON k.model = aa.model),
    le AS ({" UNION ALL ".join(f"SELECT '{title}' AS title, arg_max(model, {'-' if up else ''}{c}) AS model FROM kk" for title, c, up in metrics.LEADERS)})"""


def _ranked(spark, folder):
    """All metrics of the two models; alpha scores in half a second, beta in six."""
    scored = _scored(spark, folder)
    suite = metrics.metric_suite(scored).join(metrics.area_scores(metrics.score_steps(scored)).select("model", "roc_auc"), "model")
    return metrics.rank_models(_six(suite.withColumn("prediction_seconds", F.when(F.col("model") == "alpha", 0.5).otherwise(6.0))))


@query("model_leaders", "scored", f"{LEADER_SQL} SELECT title, model FROM le")
def model_leaders(spark, folder):
    return metrics.model_leaders(_ranked(spark, folder))


def _codes_sql(table):
    return ", ".join(f"CASE WHEN {metric} {sign} {bound} THEN '{code}' END" for code, metric, sign, bound, _ in table)


@query("model_remarks", "scored", f"""{LEADER_SQL}
    SELECT kk.model, concat_ws('|', led, {_codes_sql(metrics.STRENGTHS)}) AS strengths, concat_ws('|', {_codes_sql(metrics.WEAKNESSES)}) AS weaknesses
    FROM kk LEFT JOIN (SELECT model, string_agg(title, '|' ORDER BY title) AS led FROM le GROUP BY model) USING (model)""")
def model_remarks(spark, folder):
    remarks = metrics.model_remarks(_ranked(spark, folder))
    return remarks.select("model", F.array_join("strengths", "|").alias("strengths"), F.array_join("weaknesses", "|").alias("weaknesses"))


COMPARED = ["accuracy", "f1_macro", "recall_macro", "fpr"]


@query("tuned_comparison", "scored", f"""{SUITE_RANK}
    SELECT 'net' AS model, {', '.join(f"a.{m} AS original_{m}, b.{m} AS tuned_{m}, round(b.{m} - a.{m}, 6) AS delta_{m}" for m in COMPARED)},
           0.0::DOUBLE AS original_fit_seconds, 2.0::DOUBLE AS tuned_fit_seconds
    FROM k a, k b WHERE a.model = 'alpha' AND b.model = 'beta'""")
def tuned_comparison(spark, folder):
    suite = _six(metrics.metric_suite(_scored(spark, folder)))
    original = suite.where("model = 'alpha'").withColumns({"model": F.lit("net"), "fit_seconds": F.lit(None).cast("double")})
    tuned = suite.where("model = 'beta'").withColumns({"model": F.lit("net"), "fit_seconds": F.lit(2.0)})
    return _six(metrics.compare_tuned(original, tuned, COMPARED))


OUTCOME_SQL = """CASE WHEN y = 0 AND pred = 0 THEN 'normal' WHEN y <> 0 AND pred = y THEN 'attack'
    WHEN y = 0 AND pred <> 0 THEN 'false_positive' WHEN y <> 0 AND pred = 0 THEN 'false_negative' END"""


@query("outcome_examples", "scored", f"""
    SELECT outcome, {', '.join(KEY)}, y, pred, quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY outcome ORDER BY {', '.join(KEY)}) AS r
      FROM (SELECT *, {OUTCOME_SQL} AS outcome FROM scored) WHERE outcome IS NOT NULL) WHERE r = 1""")
def outcome_examples(spark, folder):
    return metrics.outcome_examples(views.scored(spark, folder), KEY, ["quantity"])


# ---- importances -------------------------------------------------------------------------------

IMPORTANCE_SQL = """
    tr AS (SELECT label AS model, unnest(['quantity', 'discount', 'tax', 'linenumber']) AS feature,
                  unnest([round(stddev_samp(quantity), 6), round(stddev_samp(discount), 6), round(stddev_samp(tax), 6), round(stddev_samp(linenumber), 6)]) AS raw
           FROM flows GROUP BY label),
    tt AS (SELECT model, feature, raw AS raw_importance, round(raw / sum(raw) OVER (PARTITION BY model), 6) AS normalized_importance FROM tr),
    pm AS (SELECT label AS model, unnest(['quantity', 'discount', 'tax']) AS feature, unnest([round(avg(quantity), 6), round(avg(discount), 6), round(avg(tax), 6)]) AS permutation_mean
           FROM flows GROUP BY label)"""


def _importance_tables(spark, folder):
    names = ["quantity", "discount", "tax", "linenumber"]
    flows = views.flows(spark, folder)
    lines = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.stddev_samp(c), 6).alias("raw_importance")) for c in names])
    tree = flows.groupBy(F.col("label").alias("model")).agg(lines.alias("l")).select("model", F.inline("l"))
    share = F.round(F.col("raw_importance") / F.sum("raw_importance").over(Window.partitionBy("model")), 6)
    means = F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.avg(c), 6).alias("permutation_mean")) for c in names[:3]])
    permutation = flows.groupBy(F.col("label").alias("model")).agg(means.alias("l")).select("model", F.inline("l"))
    return tree.withColumn("normalized_importance", share), permutation


@query("importance_join", "flows", f"""
    WITH {IMPORTANCE_SQL} SELECT tt.*, permutation_mean FROM tt JOIN pm ON tt.model = pm.model AND tt.feature = pm.feature""")
def importance_join(spark, folder):
    return explain.join_importances(*_importance_tables(spark, folder))


@query("importance_top", "flows", f"""
    WITH {IMPORTANCE_SQL} SELECT * FROM (SELECT model, (row_number() OVER (PARTITION BY model ORDER BY raw DESC, feature))::INT AS rank, feature,
      round(raw / sum(raw) OVER (PARTITION BY model), 4) AS importance FROM tr) WHERE rank <= 3""")
def importance_top(spark, folder):
    return explain.top_importances(_importance_tables(spark, folder)[0], 3)


@query("importance_fallback", "flows", f"""
    WITH {IMPORTANCE_SQL} SELECT model, feature FROM tt ORDER BY normalized_importance DESC, model, feature LIMIT 5""")
def importance_fallback(spark, folder):
    return explain.importances_of(_importance_tables(spark, folder)[0], "absent", 5).select("model", "feature")


# ---- training ----------------------------------------------------------------------------------

INPUTS = ["quantity", "price", "discount", "tax", "linenumber", "supp"]


def _state(spark, folder):
    return spark.sparkContext.applicationId, table_state(spark, f"{folder}/lineitem.parquet")


_READY: dict[tuple, DataFrame] = {}


def _all_rows(spark, folder):
    """Train and test rows, prepared and written once for the present state of the files."""
    key = _state(spark, folder)
    if key not in _READY:
        _READY[key] = _prepared_rows(spark, folder)
    return _READY[key]


def _training_rows(spark, folder):
    ready = _all_rows(spark, folder)
    return ready.where("split = 'train'"), ready.where("split = 'test'")


def _prepared_rows(spark, folder):
    """Flows whose label follows from the features, split and assembled. The test tables carry labels
    that no feature explains, so a label is derived that a model can learn."""
    flows = views.flows(spark, folder)
    hard = F.when(F.col("quantity") * F.col("discount") > 2.0, "DDoS").when(F.col("price") > 60000, "PortScan").otherwise("BENIGN")
    labelled = features.stratified_split(flows.withColumn("label", hard), "label", views.flow_mix(), KEY)
    weighted = features.with_sample_weight(labelled, "label")
    indexed = features.label_indexer(weighted, "label").transform(weighted)
    ready = VectorAssembler(inputCols=INPUTS, outputCol="features").transform(indexed)
    ready = ready.select(*KEY, "features", "label", "label_index", "weight", "split", "quantity", "discount", F.xxhash64(*KEY).alias("id"))
    # Fits and scoring cost far more per byte than the shuffles whose small partitions adaptive execution joins.
    return cut_lineage(ready.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id"))


_FITTED: dict[tuple, object] = {}


def _forest(train_rows, folder):
    """The registry's forest on the training rows; one fit serves all queries while the files stay as they are."""
    key = _state(train_rows.sparkSession, folder)
    if key not in _FITTED:
        _FITTED[key] = training.build("random_forest").fit(train_rows)
    return _FITTED[key]


CLASSES = ["BENIGN", "DDoS", "PortScan"]


@query("train_compare")
def train_compare(spark, folder):
    rows, test = _training_rows(spark, folder)
    _, ranked = training.train_and_rank(list(training.REGISTRY), rows, test, weighted=True)
    return ranked


@query("grid_search")
def grid_search(spark, folder):
    rows, _ = _training_rows(spark, folder)
    folded = cut_lineage(training.with_folds(features.stratified_sample(rows, "label_index", 50_000, views.flow_mix(), KEY), 5, KEY))
    return training.search("decision_tree", folded, 5, "grid", space={"maxDepth": [5, 10], "minInstancesPerNode": [1, 4]})[1]


@query("folds", "flows", f"""
    SELECT {', '.join(KEY)}, label, ((row_number() OVER (PARTITION BY label ORDER BY m, {', '.join(KEY)}) - 1) % 5)::INT AS fold FROM flows""")
def folds(spark, folder):
    rows = views.flows(spark, folder).select(*KEY, "label", F.col("label").alias("label_index"))
    return training.with_folds(rows, 5, KEY, views.flow_mix()).drop("label_index")


@query("tune_refit")
def tune_refit(spark, folder):
    rows, test = _training_rows(spark, folder)
    return training.tune("decision_tree", rows, test, views.flow_mix(), KEY, space={"maxDepth": [5, 10, 15], "minInstancesPerNode": [1, 2, 4]})[1]


@query("batch_scoring")
def batch_scoring(spark, folder):
    rows, _ = _training_rows(spark, folder)
    scored = training.predict(_forest(rows, folder), _all_rows(spark, folder))
    table = training.prediction_table(scored, "random_forest", CLASSES, KEY)
    return table.withColumn("Class_Probabilities", F.to_json("Class_Probabilities"))


@query("prediction_rows", "scored", f"""
    WITH n AS (SELECT *, ['BENIGN', 'DDoS', 'PortScan'][pred + 1] AS attack, greatest(p0, p1, p2) AS confidence FROM scored),
         r AS (SELECT *, CASE attack WHEN 'BENIGN' THEN round_even((1.0::DOUBLE - confidence) * 20.0::DOUBLE * 100.0::DOUBLE, 0) / 100.0::DOUBLE
                    ELSE round_even((CASE attack WHEN 'PortScan' THEN 50.0 ELSE 90.0 END)::DOUBLE * (0.5::DOUBLE + 0.5::DOUBLE * confidence) * 100.0::DOUBLE, 0) / 100.0::DOUBLE END AS risk FROM n)
    SELECT {', '.join(KEY)}, attack AS "Attack_Type", confidence AS "Prediction_Confidence", risk AS "Risk_Score",
           CASE WHEN risk < 25 THEN 'Low' WHEN risk < 50 THEN 'Medium' WHEN risk < 75 THEN 'High' ELSE 'Critical' END AS "Risk_Level",
           round_even(p0, 4) AS benign, round_even(p1, 4) AS ddos, round_even(p2, 4) AS portscan, 'given' AS "Model_Name", 1.5::DOUBLE AS "Prediction_Time_ms" FROM r""")
def prediction_rows(spark, folder):
    given = views.scored(spark, folder).withColumn("probabilities", F.array("p0", "p1", "p2"))
    table = training.prediction_table(given, "given", CLASSES, KEY, 1.5)
    shares = [F.try_element_at("Class_Probabilities", F.lit(c)).alias(c.lower()) for c in CLASSES]
    return table.select(*KEY, "Attack_Type", "Prediction_Confidence", "Risk_Score", "Risk_Level", *shares, "Model_Name", "Prediction_Time_ms")


@query("early_stopping")
def early_stopping(spark, folder):
    rows, test = _training_rows(spark, folder)
    watch = features.stratified_split(rows.drop("split"), "label_index", views.flow_mix(), KEY, 0.1).withColumn("is_validation", F.col("split") == "test")
    model = training.build("boosted_trees", early_stopping=True, maxDepth=3).fit(watch)
    return training.evaluate([training.Trained("boosted_trees", model, 0.0)], test)


@query("class_presets")
def class_presets(spark, folder):
    rows, _ = _training_rows(spark, folder)
    return explain.class_presets(training.predict(_forest(rows, folder), _all_rows(spark, folder)), "id", [1, 2], ["quantity", "discount"])


@query("permutation_importance")
def permutation_importance(spark, folder):
    rows, test = _training_rows(spark, folder)
    model = _forest(rows, folder)
    shuffled = explain.permutation_importance(model, test, "id", INPUTS, "random_forest")
    return explain.join_importances(explain.tree_importance(spark, model, INPUTS, "random_forest"), shuffled)


@query("partial_dependence")
def partial_dependence(spark, folder):
    rows, test = _training_rows(spark, folder)
    return explain.partial_dependence(_forest(rows, folder), test, INPUTS, INPUTS)


def _shapley(spark, folder, explained):
    """Contributions against a fixed background of 20 training rows, the baseline of the method."""
    rows, test = _training_rows(spark, folder)
    background = features.stratified_sample(rows, "label_index", 20, views.flow_mix(), KEY)
    return explain.shapley_values(_forest(rows, folder), explained(test), "id", background, "id", INPUTS)


@query("shapley_global")
def shapley_global(spark, folder):
    return explain.global_explanation(_shapley(spark, folder, lambda test: test))


@query("shapley_local")
def shapley_local(spark, folder):
    # A local explanation shows ten rows.
    return explain.local_explanation(_shapley(spark, folder, lambda test: test.orderBy("id").limit(10)))


@query("learning_curve")
def learning_curve(spark, folder):
    rows, _ = _training_rows(spark, folder)
    # The folds move the rows, so only what they and the fits read goes along.
    return training.learning_curve("decision_tree", rows.select(*KEY, "features", "label_index"), views.flow_mix(), KEY, settings={"maxDepth": 5})


@query("validation_curve")
def validation_curve(spark, folder):
    rows, _ = _training_rows(spark, folder)
    # The folds move the rows, so only what they and the fits read goes along.
    return training.validation_curve("decision_tree", rows.select(*KEY, "features", "label_index"), "maxDepth", [2, 4, 6], KEY)


SMOTE_SQL = """
    WITH h AS (SELECT CASE WHEN quantity * discount > 2.0 THEN 'DDoS' WHEN price > 60000 THEN 'PortScan' ELSE 'BENIGN' END AS label,
                      l_orderkey, l_partkey, l_suppkey, l_linenumber, price, l_shipdate, m FROM flows),
         c AS (SELECT label, count(*) - floor(0.2::DOUBLE * count(*) + 0.5)::BIGINT AS n FROM h GROUP BY label),
         x AS (SELECT *, max(n) OVER () AS most FROM c)
    SELECT label, false AS synthetic, n AS rows, 0::BIGINT AS outside FROM x UNION ALL SELECT label, true, most - n, 0 FROM x WHERE n < most"""


@query("smote", "flows", SMOTE_SQL)
def smote(spark, folder):
    rows, _ = _training_rows(spark, folder)
    scaled = rows.select("id", "label", vector_to_array("features").alias("v"))
    scaler = features.fit_scaler(scaled.select(*[F.get("v", F.lit(i)).alias(c) for i, c in enumerate(INPUTS)]), INPUTS)
    shaped = scaled.withColumn("v", F.array(*[(F.get("v", F.lit(i)) - scaler[c][0]) / scaler[c][1] for i, c in enumerate(INPUTS)]))
    made = resample.smote(shaped, "label", "v")
    # Every new vector lies between two of its class, so no coordinate leaves the class's range.
    sides = made.where("NOT synthetic").groupBy("label").agg(*[F.struct(F.min(F.get("vector", F.lit(i))).alias("lo"), F.max(F.get("vector", F.lit(i))).alias("hi")).alias(f"b{i}")
                                                               for i in range(len(INPUTS))])
    inside = F.lit(True)
    for i in range(len(INPUTS)):
        inside = inside & F.get("vector", F.lit(i)).between(F.col(f"b{i}.lo") - 1e-9, F.col(f"b{i}.hi") + 1e-9)
    return made.join(F.broadcast(sides), "label").groupBy("label", "synthetic").agg(F.count("*").alias("rows"), F.count_if(~inside).alias("outside"))  # one row per class


@query("smote_neighbours", "flows", """
    WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, min(quantity) AS a, min(round(discount * 100)) AS b, min(round(tax * 100)) AS c, min(supp) AS d, min(m) AS m FROM flows GROUP BY 1),
         q AS (SELECT * FROM p WHERE m % 40 = 0)
    SELECT x.id, array_to_string(list_sort(list(((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b) + (x.c - y.c) * (x.c - y.c) + (x.d - y.d) * (x.d - y.d))::BIGINT))[1:5], ',') AS squares
    FROM q x JOIN q y ON x.id <> y.id GROUP BY x.id""")
def smote_neighbours(spark, folder):
    """Squared distances to the five neighbours from which new rows of the smallest class are made."""
    flows = views.flows(spark, folder).withColumn("m", views.flow_mix())
    least = [F.min(c).cast("double") for c in (F.col("quantity"), F.round(F.col("discount") * 100), F.round(F.col("tax") * 100), F.col("supp"))]
    rows = flows.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(F.array(*least).alias("v"), F.min("m").alias("m"))
    named = rows.withColumn("label", F.when(F.col("m") % 40 == 0, "rare").when(F.col("m") % 40 < 9, "few").otherwise("most")).where("label <> 'most'")
    found = resample.nearest_in_class(named, "label", "v", 5).where("label = 'rare'")
    square = F.transform("neighbours", lambda n: F.aggregate(F.zip_with("vector", n, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, x: t + x).cast("bigint"))
    return found.select("id", F.array_join(F.transform(F.array_sort(square), lambda s: s.cast("string")), ",").alias("squares"))
