"""Named queries that clean, validate, profile and prepare whole flow tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowguard.functions.risk import traffic_type
from flowguard.operators import cleaning, features, neighbours, profiling
from flowguard.plans.catalog import query
from flowguard.sources import flow_files, views

NUMBERS = views.FLOW_NUMBERS
TIES = views.FLOW_KEY
REPAIRED = ["quantity", "price", "linetext", "discount", "tax", "one", "quantity_full", "quantity_copy", "price_linear", "empty"]


def _six(df, *skip):
    """Round the measures so that both engines print the same digits."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return df.select(*[F.round(c, 6).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns])


def _tall_sql(columns, template, source):
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, {template.format(c=c)} FROM {source}" for c in columns)


# ---- cleaning ----------------------------------------------------------------------------------


def _filled_sql(fill):
    cells = ", ".join(f"coalesce({c}, (SELECT coalesce({fill.format(c=c)}, 0.0) FROM repaired))::DOUBLE AS {c}" for c in REPAIRED)
    return f"SELECT DISTINCT l_orderkey, l_partkey, {cells}, label FROM repaired"


def _rounded_flows(df):
    return _six(df.withColumnRenamed("Label", "label"))


def _round_sql(inner):
    return "SELECT l_orderkey, l_partkey, label, " + ", ".join(f"round({c}, 6) AS {c}" for c in REPAIRED) + f" FROM ({inner})"


@query("impute_median", "repaired", _round_sql(_filled_sql("quantile_cont({c}, 0.5)")))
def impute_median(spark, folder):
    return _rounded_flows(cleaning.clean_flows(views.dirty_flows(spark, folder), "label", "median"))


@query("impute_mean", "repaired", _round_sql(_filled_sql("avg({c})")))
def impute_mean(spark, folder):
    return _rounded_flows(cleaning.clean_flows(views.dirty_flows(spark, folder), "label", "mean"))


@query("impute_zero", "repaired", _round_sql(_filled_sql("max(0.0)")))
def impute_zero(spark, folder):
    return _rounded_flows(cleaning.clean_flows(views.dirty_flows(spark, folder), "label", "zero"))


@query("clean_flows", "repaired", """
    SELECT count(*) AS rows, count(DISTINCT label) AS classes, count(*) FILTER (price IS NULL) AS gaps FROM (SELECT DISTINCT * FROM repaired)""")
def clean_rows(spark, folder):
    named = cleaning.strip_names(views.dirty_flows(spark, folder))
    repaired = cleaning.infinite_to_null(cleaning.coerce_numbers(named, "Label"), "Label").dropDuplicates()
    return repaired.agg(F.count("*").alias("rows"), F.count_distinct("Label").alias("classes"), F.count_if(F.col("price").isNull()).alias("gaps"))


@query("drop_duplicates", "dirty", "SELECT DISTINCT l_orderkey, l_partkey, quantity, price, linetext, discount, tax, one, quantity_full, quantity_copy, price_linear, empty, label FROM dirty")
def drop_duplicates(spark, folder):
    return views.dirty_flows(spark, folder).withColumnRenamed(" Label ", "label").dropDuplicates()


@query("align_features", "dirty", """
    SELECT l_orderkey, l_partkey, CASE WHEN isfinite(price) THEN price ELSE 0.0 END AS price, 0.0::DOUBLE AS absent,
           coalesce(TRY_CAST(trim(linetext) AS DOUBLE), 0.0) AS linetext, CASE WHEN isfinite(tax) THEN tax ELSE 0.0 END AS tax,
           coalesce(quantity, 0.0) AS quantity FROM dirty""")
def align(spark, folder):
    return cleaning.align_features(views.dirty_flows(spark, folder), ["price", "absent", "linetext", "tax", "quantity"], ["l_orderkey", "l_partkey"])


@query("request_defaults", "dirty", "SELECT l_orderkey, coalesce(quantity, 7.0) AS quantity, 3.0::DOUBLE AS absent FROM dirty")
def request_defaults(spark, folder):
    return cleaning.fill_request_defaults(views.dirty_flows(spark, folder).select("l_orderkey", "quantity"), {"quantity": 7.0, "absent": 3.0})


MERGE_PART = "SELECT l_orderkey, l_partkey, quantity, price, label FROM flows WHERE status = '{s}'"


@query("strict_merge", "flows", "SELECT l_orderkey, l_partkey, quantity, price, label FROM flows")
def strict_merge(spark, folder):
    flows = views.flows(spark, folder)
    left = flows.where("status = 'F'").selectExpr("l_orderkey", "l_partkey", "quantity as ` quantity`", "price", "label as ` label `")
    right = flows.where("status <> 'F'").select("label", "price", "quantity", "l_partkey", "l_orderkey")
    return flow_files.strict_union([left, right])


@query("loose_merge", "flows", """
    SELECT l_orderkey, quantity, NULL::DOUBLE AS price, label FROM flows WHERE status = 'F'
    UNION ALL SELECT l_orderkey, NULL, price, label FROM flows WHERE status <> 'F'""")
def loose_merge(spark, folder):
    flows = views.flows(spark, folder)
    left = flows.where("status = 'F'").select("l_orderkey", "quantity", "label")
    return flow_files.loose_union([left, flows.where("status <> 'F'").select("l_orderkey", "price", "label")])


# ---- validation and profiling ------------------------------------------------------------------

DIRTY = ["l_orderkey", "l_partkey", "quantity", "price", "linetext", "discount", "tax", "one", "quantity_full", "quantity_copy",
         "price_linear", "empty", "label"]
DIRTY_DOUBLES = {"quantity", "price", "discount", "tax", "one", "quantity_full", "quantity_copy", "price_linear", "empty"}


def _dirty(spark, folder):
    return views.dirty_flows(spark, folder).withColumnRenamed(" Label ", "label")


def _missing_sql(c):
    return f"({c} IS NULL OR isnan({c}))" if c in DIRTY_DOUBLES else f"({c} IS NULL)"


@query("missing_values", "dirty", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) FILTER {_missing_sql(c)} AS missing, round(count(*) FILTER {_missing_sql(c)} * 100.0::DOUBLE / count(*), 6) AS missing_pct,"
    f" count(*) FILTER {_missing_sql(c)} = count(*) AS is_empty FROM dirty" for c in DIRTY))
def missing_values(spark, folder):
    return _six(profiling.missing_values(_dirty(spark, folder)))


@query("duplicate_rows", "dirty", """
    SELECT sum(n - 1)::BIGINT AS duplicate_rows, round(sum(n - 1) * 100.0::DOUBLE / sum(n), 6) AS duplicate_pct
    FROM (SELECT count(*) AS n FROM dirty GROUP BY ALL)""".replace("SELECT count(*) AS n FROM dirty GROUP BY ALL", f"SELECT count(*) AS n FROM dirty GROUP BY {', '.join(DIRTY)}"))
def duplicate_rows(spark, folder):
    return _six(profiling.duplicate_rows(_dirty(spark, folder)))


@query("infinite_values", "dirty", "SELECT feature, infinite FROM (" + _tall_sql(
    sorted(DIRTY_DOUBLES), "count(*) FILTER (isinf({c})) AS infinite", "dirty") + ") WHERE infinite > 0")
def infinite_values(spark, folder):
    return profiling.infinite_values(_dirty(spark, folder))


@query("mixed_numeric", "dirty", """
    SELECT 'linetext' AS feature, count(*) FILTER (linetext IS NOT NULL AND TRY_CAST(trim(linetext) AS DOUBLE) IS NULL) AS invalid FROM dirty""")
def mixed_numeric(spark, folder):
    return profiling.mixed_text(_dirty(spark, folder), "label")


@query("duplicate_columns", "dirty", """
    SELECT 'quantity_full' AS kept, 'quantity_copy' AS copy FROM dirty
    HAVING count(*) FILTER (quantity_full = quantity_copy) = count(*)""")
def duplicate_columns(spark, folder):
    return spark.createDataFrame(profiling.duplicate_columns(_dirty(spark, folder)), "kept string, copy string")


def _constant_sql(c):
    value = f"(CASE WHEN NOT {_missing_sql(c)} THEN {c} END)"
    low = "false"
    if c == "price":
        value = f"(CASE WHEN isfinite(price) THEN price END)"
        low = f"bool_or(isinf(price)) OR var_samp({value}) < 0.000001"
    elif c in DIRTY_DOUBLES | {"l_orderkey", "l_partkey"} and c != "price_linear":
        low = f"count(DISTINCT {value}) > 1 AND (var_samp({value}) IS NULL OR var_samp({value}) < 0.000001)"
    return f"SELECT '{c}' AS feature, count(DISTINCT {value}) <= 1 AS is_constant, {low} AS is_low_variance FROM dirty"


@query("constant_columns", "dirty", " UNION ALL ".join(_constant_sql(c) for c in DIRTY))
def constant_columns(spark, folder):
    return profiling.constant_columns(_dirty(spark, folder))


@query("validation_summary", "dirty", f"""
    WITH d AS (SELECT count(*) AS n, sum(c) AS t FROM (SELECT count(*) AS c FROM dirty GROUP BY {', '.join(DIRTY)})),
         g AS (SELECT sum(missing) AS missing FROM ({_tall_sql(DIRTY, 'count(*) FILTER (X) AS missing', 'dirty')}))
    SELECT 'total_rows' AS metric, t::DOUBLE AS value FROM d UNION ALL SELECT 'total_columns', {len(DIRTY)}
    UNION ALL SELECT 'duplicate_rows_count', t - n FROM d UNION ALL SELECT 'duplicate_rows_percentage', round((t - n) * 100.0::DOUBLE / t, 6) FROM d
    UNION ALL SELECT 'missing_values_count', missing FROM g
    UNION ALL SELECT 'overall_null_percentage', round(missing * 100.0::DOUBLE / (t * {len(DIRTY)}), 6) FROM g, d
    UNION ALL SELECT 'constant_features_count', count(*) FILTER (c <= 1) FROM (CONSTANTS)
    UNION ALL SELECT 'duplicate_columns_count', (count(*) FILTER (quantity_full = quantity_copy) = count(*))::INT FROM dirty
    UNION ALL SELECT 'infinite_values_count', count(*) FILTER (isinf(price)) FROM dirty""".replace(
        _tall_sql(DIRTY, 'count(*) FILTER (X) AS missing', 'dirty'),
        " UNION ALL ".join(f"SELECT count(*) FILTER {_missing_sql(c)} AS missing FROM dirty" for c in DIRTY)).replace(
        "CONSTANTS", " UNION ALL ".join(f"SELECT count(DISTINCT CASE WHEN NOT {_missing_sql(c)} THEN {c} END) AS c FROM dirty" for c in DIRTY)))
def validation_summary(spark, folder):
    return _six(profiling.validation_summary(_dirty(spark, folder)))


@query("class_distribution", "flows", """
    SELECT label AS class, count(*) AS rows, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percentage,
           min(count(*)) OVER () * 100.0 / sum(count(*)) OVER () < 5.0 AS imbalanced FROM flows GROUP BY label""")
def class_distribution(spark, folder):
    return _six(profiling.class_distribution(views.flows(spark, folder), "label"))


@query("traffic_types", "flows", """
    SELECT CASE WHEN label = 'N' THEN 'Benign' ELSE 'Malicious' END AS traffic_type, count(*) AS rows FROM flows GROUP BY ALL""")
def traffic_types(spark, folder):
    named = views.flows(spark, folder).withColumn("label", F.when(F.col("label") == "N", " benign").otherwise(F.col("label")))
    return named.groupBy(traffic_type(F.col("label")).alias("traffic_type")).agg(F.count("*").alias("rows"))


STATS_SQL = ("round(avg({c}), 9) AS mean, round(stddev_samp({c}), 9) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS p25,"
             " round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS max,"
             " round(var_samp({c}), 4) AS variance")


@query("feature_statistics", "flows", _tall_sql(NUMBERS, STATS_SQL, "flows"))
def feature_statistics(spark, folder):
    table = profiling.feature_statistics(views.flows(spark, folder), NUMBERS)
    return _six(table.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9), "variance": F.round("variance", 4)}), "mean", "std")


@query("key_features", "flows", f"""
    SELECT feature, round(variance, 4) AS variance FROM ({_tall_sql(NUMBERS, "var_samp({c}) AS variance", "flows")})
    WHERE variance > 0.00001 ORDER BY 2 DESC, feature LIMIT 4""")
def key_features(spark, folder):
    table = profiling.key_features(profiling.feature_statistics(views.flows(spark, folder), NUMBERS), 4)
    return table.select("feature", F.round("variance", 4).alias("variance"))


def _box_sql(c, extra=""):
    return (f"SELECT '{c}' AS feature, count(*) FILTER ({c} < lo OR {c} > hi) AS outliers,"
            f" round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0::DOUBLE / count(*), 6) AS outlier_pct, round(min(q1), 6) AS q1,"
            f" round(min(q3), 6) AS q3, round(min(q3) - min(q1), 6) AS iqr{extra.format(c=c)} FROM flows, (SELECT q1, q3, q1 - 1.5::DOUBLE * (q3 - q1) AS lo,"
            f" q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM flows))")


@query("iqr_outliers", "flows", " UNION ALL ".join(_box_sql(c) for c in NUMBERS))
def iqr_outliers(spark, folder):
    return _six(profiling.iqr_outliers(views.flows(spark, folder), NUMBERS))


@query("box_stats", "flows", " UNION ALL ".join(_box_sql(
    c, ", min({c}) FILTER ({c} >= lo AND {c} <= hi) AS whisker_low, max({c}) FILTER ({c} >= lo AND {c} <= hi) AS whisker_high") for c in NUMBERS))
def box_stats(spark, folder):
    return _six(profiling.iqr_outliers(views.flows(spark, folder), NUMBERS, whiskers=True))


CORRELATED = ["quantity", "price", "discount", "quantity_copy", "price_linear"]
CORRELATED_SQL = "(SELECT quantity, price, discount, quantity AS quantity_copy, price * 2.0 + 1.0 AS price_linear FROM flows)"


def _correlated(spark, folder):
    return views.flows(spark, folder).select("quantity", "price", "discount", F.col("quantity").alias("quantity_copy"), (F.col("price") * 2.0 + 1.0).alias("price_linear"))


def _pair_sql(source):
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS coefficient FROM {source}"
                              for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:])


@query("pearson_matrix", "flows", _pair_sql(CORRELATED_SQL))
def pearson_table(spark, folder):
    df = _correlated(spark, folder)
    return _six(profiling.matrix_table(df, profiling.pearson_matrix(df, CORRELATED)))


@query("pearson_pairs", "flows", f"SELECT * FROM ({_pair_sql(CORRELATED_SQL)}) WHERE abs(coefficient) > 0.9")
def pearson_pairs(spark, folder):
    df = _correlated(spark, folder)
    return _six(profiling.strong_pairs(profiling.matrix_table(df, profiling.pearson_matrix(df, CORRELATED))))


RANKED_SQL = "(SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in CORRELATED) + f" FROM {CORRELATED_SQL})"


@query("spearman_matrix", "flows", _pair_sql(RANKED_SQL))
def spearman_table(spark, folder):
    df = _correlated(spark, folder)
    return _six(profiling.matrix_table(df, profiling.spearman_matrix(df, CORRELATED)))


@query("spearman_pairs", "flows", f"SELECT * FROM ({_pair_sql(RANKED_SQL)}) WHERE abs(coefficient) > 0.9")
def spearman_pairs(spark, folder):
    df = _correlated(spark, folder)
    return _six(profiling.strong_pairs(profiling.matrix_table(df, profiling.spearman_matrix(df, CORRELATED))))


GAPPY = ["quantity", "discount", "tax", "quantity_full", "price_linear", "empty"]


def _gappy_sql(ranked):
    """Every pair over the rows where both are present, null and NaN being absent."""
    lines = []
    for i, a in enumerate(GAPPY):
        for b in GAPPY[i + 1:]:
            rows = f"SELECT {a}::DOUBLE AS a, {b}::DOUBLE AS b FROM dirty WHERE NOT {_missing_sql(a)} AND NOT {_missing_sql(b)}"
            if ranked:
                rows = "SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in "ab") + f" FROM ({rows})"
            lines.append(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr(a, b), 6) AS coefficient FROM ({rows})")
    return " UNION ALL ".join(lines)


@query("pearson_dirty", "dirty", _gappy_sql(False))
def pearson_dirty(spark, folder):
    df = _dirty(spark, folder)
    return _six(profiling.matrix_table(df, profiling.pearson_matrix(df, GAPPY)))


@query("spearman_dirty", "dirty", _gappy_sql(True))
def spearman_dirty(spark, folder):
    df = _dirty(spark, folder)
    return _six(profiling.matrix_table(df, profiling.spearman_matrix(df, GAPPY)))


WIDE = [f"w{i}" for i in range(28)]
WIDE_SQL = ", ".join(f"CASE WHEN m % {i + 5} <> 0 THEN quantity * {i % 5} + discount * {i * i % 7 * 100} + tax * {(i * 3) % 11 * 100} + linenumber END AS w{i}" for i in range(28))


def _wide_flows(spark, folder):
    m = views.flow_mix()
    return views.flows(spark, folder).select(*[F.when(m % (i + 5) != 0, F.col("quantity") * (i % 5) + F.col("discount") * (i * i % 7 * 100)
                                                      + F.col("tax") * ((i * 3) % 11 * 100) + F.col("linenumber")).alias(f"w{i}") for i in range(28)])


@query("pearson_wide", "flows", f"WITH w AS (SELECT {WIDE_SQL} FROM flows) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr({a}, {b}), 6) AS coefficient FROM w" for i, a in enumerate(WIDE) for b in WIDE[i + 1:]))
def pearson_wide(spark, folder):
    df = _wide_flows(spark, folder)
    return _six(profiling.matrix_table(df, profiling.pearson_matrix(df, WIDE)))


HOLED = [f"h{i}" for i in range(28)]
HOLED_SQL = ", ".join(f"CASE WHEN (m // {i + 3}) % {i + 5} > 0 THEN {c} END AS {h}" for i, (c, h) in enumerate(zip([NUMBERS[i % len(NUMBERS)] for i in range(28)], HOLED)))


def _ranked_pair_sql(a, b):
    def rank(c):
        return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return (f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr(x, y), 6) AS coefficient FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM w"
            f" WHERE {a} IS NOT NULL AND {b} IS NOT NULL)")


@query("spearman_wide", "flows", f"WITH w AS MATERIALIZED (SELECT {HOLED_SQL} FROM flows) " + " UNION ALL ".join(
    _ranked_pair_sql(a, b) for i, a in enumerate(HOLED) for b in HOLED[i + 1:]))
def spearman_wide(spark, folder):
    # 28 columns, all with gaps: every pair has ranks of its own.
    m = views.flow_mix()
    df = views.flows(spark, folder).select(*[
        F.when(F.floor(m / (i + 3)) % (i + 5) > 0, F.col(NUMBERS[i % len(NUMBERS)])).alias(h) for i, h in enumerate(HOLED)])
    return _six(profiling.matrix_table(df, profiling.spearman_matrix(df, HOLED)))


@query("top_variance_matrix", "flows", """
    SELECT feature_1, feature_2, coefficient FROM (
      SELECT 'price' AS feature_1, 'supp' AS feature_2, round(corr(price, supp), 6) AS coefficient FROM flows
      UNION ALL SELECT 'price', 'quantity', round(corr(price, quantity), 6) FROM flows
      UNION ALL SELECT 'supp', 'quantity', round(corr(supp, quantity), 6) FROM flows)""")
def top_variance_matrix(spark, folder):
    table = profiling.top_variance_correlations(views.flows(spark, folder), NUMBERS, 3)
    first = F.when((F.col("feature_1") == "price") | (F.col("feature_2") == "price"), F.lit("price")).otherwise(F.lit("supp"))
    second = F.when(F.col("feature_1") == first, F.col("feature_2")).otherwise(F.col("feature_1"))
    return _six(table.select(first.alias("feature_1"), second.alias("feature_2"), "coefficient"))


def _bars_sql(part="'all'"):
    return " UNION ALL ".join(
        f"SELECT {part} AS part, '{c}' AS feature, least(29, floor(({c} - lo) / w))::INT AS bin, lo, w, count(*) AS rows FROM flows,"
        f" (SELECT min({c}) AS lo, (max({c}) - min({c})) / 30 AS w FROM flows) GROUP BY ALL" for c in NUMBERS)


@query("histogram30", "flows", f"""
    SELECT part, feature, bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, rows FROM ({_bars_sql()})""")
def histogram30(spark, folder):
    return _six(profiling.histogram(views.flows(spark, folder), NUMBERS))


@query("density_grid", "flows", f"""
    WITH bars AS (SELECT part, feature, rows, lo + bin * w AS b0, lo + (bin + 1) * w AS b1, (lo + bin * w + lo + (bin + 1) * w) / 2 AS centre
                  FROM ({_bars_sql("CASE WHEN label = 'N' THEN 'Benign' ELSE 'Malicious' END")})),
         s AS (SELECT part, feature, sum(rows) AS n, min(b0) AS lo, max(b1) AS hi,
                      sqrt(greatest(0.0, sum(rows * centre * centre) / sum(rows) - pow(sum(rows * centre) / sum(rows), 2))) * pow(sum(rows), -0.2) AS h
               FROM bars GROUP BY ALL),
         g AS (SELECT part, feature, n, h, p AS point, lo + p * (hi - lo) / 19 AS x FROM s, (SELECT unnest(range(20))::INT AS p))
    SELECT g.part, g.feature, point, round(x, 4) AS x,
           round(sum(rows * exp(-0.5 * pow((x - centre) / h, 2)) / (n * h * sqrt(2 * pi()))), 9) AS density
    FROM g JOIN bars USING (part, feature) GROUP BY ALL""".replace("GROUP BY ALL\"", "GROUP BY ALL"))
def density_grid(spark, folder):
    split = F.when(F.col("label") == "N", "Benign").otherwise("Malicious")
    table = profiling.density(views.flows(spark, folder), NUMBERS, 30, 20, split)
    return table.select("part", "feature", "point", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))


@query("missingness_matrix", "dirty", """
    SELECT DISTINCT l_orderkey, l_partkey, quantity IS NULL AS quantity, linetext IS NULL AS linetext, tax IS NULL OR isnan(tax) AS tax, true AS empty FROM dirty""")
def missingness(spark, folder):
    return profiling.missingness_matrix(_dirty(spark, folder), ["l_orderkey", "l_partkey"], rows=None).distinct()


# ---- features ----------------------------------------------------------------------------------

@query("one_hot", "flows", """
    SELECT l_orderkey, l_partkey, quantity, (status = 'F')::INT::DOUBLE AS "status_F", (status = 'O')::INT::DOUBLE AS "status_O" FROM flows""")
def one_hot(spark, folder):
    df = views.flows(spark, folder).select("l_orderkey", "l_partkey", "quantity", "status")
    return features.one_hot(df, features.categories(df))


@query("label_encode", "flows", """
    SELECT l_orderkey, l_partkey, label, (dense_rank() OVER (ORDER BY label) - 1)::DOUBLE AS label_index FROM flows""")
def label_encode(spark, folder):
    df = views.flows(spark, folder).select("l_orderkey", "l_partkey", "label")
    return features.label_indexer(df, "label").transform(df)


KEY_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber, price, l_shipdate"
NUMBERED = f"""SELECT *, row_number() OVER (PARTITION BY label ORDER BY m, {KEY_SQL}) AS r, count(*) OVER (PARTITION BY label) AS n,
    count(*) OVER () AS t FROM flows"""


@query("stratified_split", "flows", f"""
    SELECT {KEY_SQL}, label, CASE WHEN r <= floor(0.2::DOUBLE * n + 0.5) THEN 'test' ELSE 'train' END AS split FROM ({NUMBERED})""")
def stratified_split(spark, folder):
    return features.stratified_split(views.flows(spark, folder), "label", views.flow_mix(), TIES).select(*TIES, "label", "split")


@query("stratified_sample", "flows", f"""
    WITH q AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM flows GROUP BY label),
         f AS (SELECT *, floor(1001 * n / t::DOUBLE) AS base, 1001 * n / t::DOUBLE - floor(1001 * n / t::DOUBLE) AS rest FROM q),
         e AS (SELECT *, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= 1001 - sum(base) OVER () THEN 1 ELSE 0 END AS quota FROM f)
    SELECT {', '.join('s.' + k.strip() for k in KEY_SQL.split(','))}, s.label FROM ({NUMBERED}) s JOIN e ON s.label = e.label WHERE s.r <= e.quota""")
def stratified_sample(spark, folder):
    return features.stratified_sample(views.flows(spark, folder), "label", 1001, views.flow_mix(), TIES).select(*TIES, "label")


@query("undersample", "flows", f"""
    SELECT {KEY_SQL}, label FROM ({NUMBERED}) WHERE r <= (SELECT min(c) FROM (SELECT count(*) AS c FROM flows GROUP BY label))""")
def undersample(spark, folder):
    return features.undersample(views.flows(spark, folder), "label", views.flow_mix(), TIES).select(*TIES, "label")


@query("balance_table", "flows", """
    SELECT label AS class, count(*) AS before_rows, min(count(*)) OVER () AS after_rows FROM flows GROUP BY label""")
def balance_table(spark, folder):
    flows = views.flows(spark, folder)
    return features.balance_table(flows, features.undersample(flows, "label", views.flow_mix(), TIES), "label")


@query("class_weights", "flows", """
    SELECT label AS class, count(*) AS rows, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM flows GROUP BY label""")
def class_weights(spark, folder):
    return _six(features.class_weights(views.flows(spark, folder), "label"))


@query("sample_weights", "flows", """
    WITH w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE AS weight FROM flows GROUP BY label)
    SELECT flows.label, count(*) AS rows, round(sum(weight), 3) AS total FROM flows JOIN w ON flows.label = w.label GROUP BY flows.label""")
def sample_weights(spark, folder):
    weighted = features.with_sample_weight(views.flows(spark, folder), "label")
    return weighted.groupBy("label").agg(F.count("*").alias("rows"), F.round(F.sum("weight"), 3).alias("total"))


def _scale_sql(centre, spread):
    cells = ", ".join(f"round(({c} - (SELECT {centre.format(c=c)} FROM flows)) / (SELECT {spread.format(c=c)} FROM flows), 6) AS {c}" for c in NUMBERS)
    return f"SELECT l_orderkey, l_partkey, {cells} FROM flows"


def _scaled(spark, folder, method):
    df = views.flows(spark, folder).select("l_orderkey", "l_partkey", *NUMBERS)
    return df, features.fit_scaler(df, NUMBERS, method)


@query("scale_standard", "flows", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, folder):
    return _six(features.scale(*_scaled(spark, folder, "standard")))


@query("scale_minmax", "flows", _scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, folder):
    return _six(features.scale(*_scaled(spark, folder, "minmax")))


@query("scale_robust", "flows", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, folder):
    return _six(features.scale(*_scaled(spark, folder, "robust")))


@query("inverse_scale", "flows", f"SELECT l_orderkey, l_partkey, {', '.join(f'round({c}, 6) AS {c}' for c in NUMBERS)} FROM flows")
def inverse_scale(spark, folder):
    df, scaler = _scaled(spark, folder, "standard")
    return _six(features.unscale(features.scale(df, scaler), scaler))


SELECTION = ["quantity", "price", "discount", "tax", "one", "quantity_copy", "price_linear"]
SELECTION_SQL = "(SELECT *, 1.0::DOUBLE AS one, quantity AS quantity_copy, price * 2.0 + 1.0 AS price_linear, discount / 10000 AS tiny FROM flows)"


def _wide(spark, folder):
    return views.flows(spark, folder).withColumns({
        "one": F.lit(1.0), "quantity_copy": F.col("quantity"), "price_linear": F.col("price") * 2.0 + 1.0, "tiny": F.col("discount") / 10000})


@query("variance_filter", "flows", "SELECT * FROM (" + _tall_sql(
    [*SELECTION, "tiny"], "CASE WHEN var_samp({c}) = 0 THEN 'constant' WHEN var_samp({c}) < 0.0001 THEN 'low' END AS reason", SELECTION_SQL) + ") WHERE reason IS NOT NULL")
def variance_filter(spark, folder):
    constant, low = features.variance_filter(_wide(spark, folder), [*SELECTION, "tiny"])
    return spark.createDataFrame([(c, "constant") for c in constant] + [(c, "low") for c in low], "feature string, reason string")


@query("correlation_filter", "flows", f"""
    SELECT feature_2 AS feature FROM ({_pair_sql(CORRELATED_SQL)}) WHERE abs(coefficient) > 0.9 GROUP BY feature_2""")
def correlation_filter(spark, folder):
    dropped = features.correlation_filter(profiling.pearson_matrix(_correlated(spark, folder), CORRELATED), CORRELATED)
    return spark.createDataFrame([(c,) for c in dropped], "feature string")


def _mi_sql(c):
    edges = f"(SELECT list_distinct(quantile_cont({c}, [{', '.join(str(i / 20) for i in range(1, 20))}])) AS e FROM flows)"
    return f"SELECT '{c}' AS feature, len(list_filter(e, lambda z: {c} > z)) AS bin, label AS y, count(*) AS n FROM flows, {edges} GROUP BY ALL"


@query("mutual_information", "flows", f"""
    WITH j AS ({' UNION ALL '.join(_mi_sql(c) for c in NUMBERS)}),
         s AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS x, sum(n) OVER (PARTITION BY feature, y) AS k FROM j)
    SELECT feature, round(greatest(0.0, sum(n / t::DOUBLE * ln(n * t::DOUBLE / (x * k)))), 8) AS mi_score FROM s GROUP BY feature""")
def mutual_information(spark, folder):
    table = features.mutual_information(views.flows(spark, folder), NUMBERS, "label")
    return table.select("feature", F.round("mi_score", 8).alias("mi_score"))


@query("neighbour_information", "flows", f"""
    WITH f AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, label AS y, {c} AS v FROM flows" for c in NUMBERS)}),
         d AS (SELECT feature, y, v, least({', '.join(f"greatest(coalesce(v - lag(v, {j}) OVER w, 'inf'::DOUBLE), coalesce(lead(v, {3 - j}) OVER w - v, 'inf'::DOUBLE))" for j in range(4))}) AS r
               FROM f WINDOW w AS (PARTITION BY feature, y ORDER BY v)),
         u AS (SELECT feature, y, v, min(r) AS r, count(*) AS n FROM d GROUP BY ALL),
         c AS (SELECT feature, v, sum(n) OVER (PARTITION BY feature ORDER BY v) AS upto FROM (SELECT feature, v, sum(n) AS n FROM u GROUP BY ALL)),
         q AS (SELECT *, CASE WHEN r > 0 THEN v + r ELSE v END AS below, CASE WHEN r > 0 THEN v - r ELSE v END AS most FROM u),
         a AS (SELECT q.*, coalesce(c.upto, 0) AS strict FROM q ASOF LEFT JOIN c ON q.feature = c.feature AND q.below > c.v),
         b AS (SELECT a.*, coalesce(c.upto, 0) AS loose FROM a ASOF LEFT JOIN c ON a.feature = c.feature AND a.most >= c.v),
         m AS (SELECT feature, y, n, (CASE WHEN r > 0 THEN strict - loose ELSE loose - strict END)::BIGINT AS m FROM b),
         h AS (SELECT k, -0.5772156649015329::DOUBLE + coalesce(sum(1.0::DOUBLE / k) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS psi
               FROM range(1, (SELECT count(*) + 1 FROM flows)) t(k)),
         s AS (SELECT feature, y, sum(n)::BIGINT AS rows, sum(n * psi) AS inner_psi FROM m JOIN h ON m.m = h.k GROUP BY ALL),
         t AS (SELECT feature, sum(s.rows)::BIGINT AS rows, sum(inner_psi) AS inner_psi, sum(s.rows * (h.psi - (SELECT psi FROM h WHERE k = 3))) AS classes FROM s JOIN h ON s.rows = h.k GROUP BY feature)
    SELECT feature, round(greatest(0.0, psi - (classes + inner_psi) / t.rows), 6) AS mi_score FROM t JOIN h ON t.rows = h.k""")
def neighbour_information(spark, folder):
    table = neighbours.neighbour_information(views.flows(spark, folder), NUMBERS, "label")
    return table.select("feature", F.round("mi_score", 6).alias("mi_score"))


@query("rfe_select")
def rfe_select(spark, folder):
    df = _wide(spark, folder)
    indexed = features.label_indexer(df, "label").transform(df)
    return features.select_features(indexed, [*SELECTION, "tiny", "linenumber", "supp"], "label", "label_index", views.flow_mix(), TIES, keep=4).summary(spark)


@query("preprocessed_flows")
def preprocessed_flows(spark, folder):
    split = features.stratified_split(views.flows(spark, folder), "label", views.flow_mix(), TIES)
    fitted, _ = features.fit_preprocessing(split.where("split = 'train'"), [*NUMBERS, "status"], "label", views.flow_mix(), TIES, keep=5, carry=["l_orderkey", "split"])
    return fitted.transform(split).drop("features")
