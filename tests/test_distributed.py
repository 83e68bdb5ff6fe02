"""The split forms give what one task would, however the work is cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.operators import distributed as d
from flowguard.operators import enrich, profiling


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.6 else f"g{rng.randrange(5)}", 5.0 if rng.random() < 0.4 else rng.gauss(0, 100), rng.randrange(1000)) for i in range(4000)]
    return spark.createDataFrame(rows, "id bigint, g string, v double, w bigint").repartition(6).cache()


def test_running_totals_split(skewed):
    whole = d.running_totals(skewed, ["g"], ["v", "id"], {"t": F.col("w")})
    split = d.running_totals(skewed, ["g"], ["v", "id"], {"t": F.col("w")}, rows_per_task=150)
    assert sorted(whole.collect()) == sorted(split.collect())


def test_running_totals_without_groups(skewed):
    whole = d.running_totals(skewed, [], ["v", "id"], {"t": F.col("w")})
    split = d.running_totals(skewed, [], ["v", "id"], {"t": F.col("w")}, rows_per_task=150)
    assert sorted(whole.collect()) == sorted(split.collect())


def test_slices_keep_the_order(skewed):
    sliced = d.add_slices(skewed, ["v", "id"], 8).select("v", "id", d.SLICE).orderBy("v", "id").collect()
    numbers = [r[2] for r in sliced]
    assert numbers == sorted(numbers) and len(set(numbers)) >= 4


@pytest.mark.parametrize("task", [2, 30, 700])
def test_percentiles_by_narrowing(spark, skewed, task):
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    frame = skewed.withColumn("n", F.when(F.col("id") % 3 > 0, F.col("v"))).withColumn("c", F.lit(1.0)).withColumn("e", F.lit(None).cast("double"))
    names = ["v", "w", "n", "c", "e"]
    short = d.exact_percentiles(frame, names, probabilities)
    long = d.exact_percentiles(frame, names, probabilities, rows_per_task=task)
    values = frame.select("v").toPandas()["v"]
    assert np.allclose(short["v"], np.quantile(values, probabilities))
    for c in names[:4]:
        assert np.allclose(short[c], long[c]), c
    assert long["e"] == [None] * 7


def test_percentiles_ignore_nan_and_keep_infinity(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (3.0,), (None,)], "v double")
    for limits in ({}, {"rows_per_task": 1}):
        assert d.exact_percentiles(df, ["v"], [0.0, 0.5], **limits)["v"] == [1.0, 3.0]


def test_pick_lowest_split(skewed):
    quotas = {"hot": 1234, "g0": 10, "g1": 0, "g2": 5000}
    mixed = d.mix(F.col("id"), F.col("w"))
    short = d.pick_lowest(skewed, "g", quotas, mixed, ["id"])
    split = d.pick_lowest(skewed, "g", quotas, mixed, ["id"], rows_in_bucket=1)
    assert sorted(short.collect()) == sorted(split.collect())
    lowest = {g: sorted((m, i) for i, h, m in skewed.select("id", "g", mixed).collect() if h == g)[:n] for g, n in quotas.items()}
    assert {r["id"] for r in split.where("picked").collect()} == {i for some in lowest.values() for _, i in some}
    counts = {r[0]: r[1] for r in split.where("picked").groupBy("g").count().collect()}
    assert counts["hot"] == 1234 and counts["g0"] == 10 and "g1" not in counts


def test_previous_and_carry_over_slices(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else "x", rng.randrange(10_000), i) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, at bigint, seq bigint")
    sliced = df.withColumn(d.SLICE, F.floor(F.col("at") / 500))
    flag = F.when(F.col("seq") % 7 == 0, F.col("seq"))
    out = d.carry_forward(d.previous_value(sliced, ["k"], ["at", "seq"], F.col("at"), "p"), ["k"], ["at", "seq"], flag, "c")
    found = {r["seq"]: (r["p"], r["c"]) for r in out.collect()}
    for key in ("hot", "x"):
        before = carried = None
        for k, at, seq in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            carried = seq if seq % 7 == 0 else carried
            assert found[seq] == (before, carried)
            before = at


def test_lookup_join_forms_agree(spark, skewed):
    dimension = spark.createDataFrame([("hot", 1), ("g1", 2)], "g string, x int")
    whole = d.lookup_join(skewed, dimension, ["g"]).select("id", "x")
    salted = d.lookup_join(skewed, dimension, ["g"], broadcast_rows=1, salts=3, hot_share=0.1).select("id", "x")
    assert sorted(whole.collect(), key=str) == sorted(salted.collect(), key=str)


def test_group_counts_refuses_keys(skewed):
    with pytest.raises(ValueError):
        d.group_counts(skewed, "id", max_groups=100)


def test_spearman_with_ties_and_split(spark, skewed):
    frame = skewed.select("v", F.col("w").cast("double").alias("w"), (F.col("v") + F.col("w")).alias("s"))
    pandas = frame.toPandas().corr(method="spearman")
    for limit, few in ((1_000_000, 20_000), (100, 1500), (100, 0)):
        found = profiling.spearman_matrix(frame, ["v", "w", "s"], rows_per_task=limit, few_values=few)
        assert all(abs(r - pandas.loc[a, b]) < 1e-9 for (a, b), r in found.items())


def _holed(spark):
    rng = random.Random(11)
    cell = lambda share: None if rng.random() < share else float("nan") if rng.random() < 0.1 else float(rng.randrange(40))
    names = [f"c{i}" for i in range(26)]
    rows = [tuple(cell(1.0 if i == 25 else 0.05 * (i % 4)) for i in range(26)) for _ in range(300)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)), names


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlations_are_per_pair_at_any_width(spark, method):
    frame, names = _holed(spark)
    pandas = frame.toPandas().corr(method=method)
    found = (profiling.pearson_matrix if method == "pearson" else profiling.spearman_matrix)(frame, names)
    assert len(found) == 325
    for (a, b), r in found.items():
        assert (r is None and np.isnan(pandas.loc[a, b])) or abs(r - pandas.loc[a, b]) < 1e-9, (a, b)


def test_spearman_of_many_values_writes_no_rows_nor_ranks(spark, monkeypatch):
    """columns of many values, one with a value in most rows, infinities and gaps; neither rows nor ranks of values are written."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 6)).round(2)
    x[:, 1] = np.where(rng.random(2000) < 0.7, 1.25, x[:, 1])
    x[:, 2] = np.where(rng.random(2000) < 0.05, np.inf, np.where(rng.random(2000) < 0.05, -np.inf, x[:, 2]))
    x[:, 4] += x[:, 0]
    x[:, 5] = 3.5
    x[rng.random(x.shape) < np.array([0.0, 0.3, 0.1, 0.6, 0.2, 0.1])] = np.nan
    names = [f"c{i}" for i in range(6)]
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)).repartition(3)
    monkeypatch.setattr(profiling, "cut_lineage", lambda df: pytest.fail("rows were written"))
    wanted = {(a, b): frame.toPandas()[[a, b]].dropna().rank().corr().loc[a, b] for i, a in enumerate(names) for b in names[i + 1:]}
    for few, per_task in ((50, 100), (0, 1_000_000), (0, 300)):
        found = profiling.spearman_matrix(frame, names, rows_per_task=per_task, few_values=few)
        for pair, r in wanted.items():
            assert (found[pair] is None and np.isnan(r)) or abs(found[pair] - r) < 1e-9, pair


def test_mix_uses_every_key(spark):
    keys = [F.col(f"k{i}") for i in range(9)]
    rows = [tuple(int(i == j) for i in range(9)) for j in range(9)]
    frame = spark.createDataFrame(rows, ", ".join(f"k{i} bigint" for i in range(9)))
    assert frame.select(d.mix(*keys).alias("m")).distinct().count() == 9


def test_bursts_of_a_busy_client_end_soon(spark):
    busy = spark.range(200_000).select(F.lit("a").alias("client_ip"), F.timestamp_micros(F.col("id") * 10).alias("ts"))
    row = enrich.request_bursts(busy).agg(F.max("in_window").alias("most"), F.count("*").alias("n")).first()
    assert (row["most"], row["n"]) == (200_000, 200_000)


def test_bursts_against_brute_force(spark):
    rng = random.Random(5)
    rows = [("a" if rng.random() < 0.8 else "b", rng.randrange(400)) for _ in range(500)]
    df = spark.createDataFrame(rows, "client_ip string, s bigint").withColumn("ts", F.timestamp_seconds("s"))
    found = {(r["client_ip"], r["s"]): (r["in_window"], r["limited"]) for r in enrich.request_bursts(df, limit=70).withColumn("s", F.unix_seconds("ts")).collect()}
    for client, s in set(rows):
        n = sum(c == client and s - 60 < t <= s for c, t in rows)
        assert found[client, s] == (n, n > 70)


@pytest.mark.parametrize("held", [3, 100_000])
def test_percentiles_by_bits(spark, held):
    """Signs, zeros, infinities, neighbours in the last bit, and one value that fills a third of the column."""
    rng = np.random.default_rng(2)
    near = 1.0
    column = [0.0, -0.0, float("inf"), float("-inf"), 1e-310, -1e-310, 1e308, -1e308, None, float("nan")] + [2.5] * 300
    for _ in range(200):
        column.append(near)
        near = float(np.nextafter(near, 2))
    column += [float(x) for x in rng.normal(size=400) * 10.0 ** rng.integers(-9, 9, 400)]
    df = spark.createDataFrame([(v, float(i % 3), i) for i, v in enumerate(column)], "v double, few double, whole bigint").repartition(5)
    probabilities = [i / 40 for i in range(41)]
    found = d.exact_percentiles(df, ["v", "few", "whole"], probabilities, rows_per_task=held)
    kept = sorted(v for v in column if v is not None and v == v)
    for p, got in zip(probabilities, found["v"]):
        place = p * (len(kept) - 1)
        low, high = kept[int(np.floor(place))], kept[int(np.ceil(place))]
        want = low if low == high else low + (high - low) * (place - np.floor(place))
        assert got == want or (got != got and want != want)
    assert found["whole"] == list(np.quantile(np.arange(len(column)), probabilities)) and set(found["few"]) == {0.0, 1.0, 2.0}
    bits = d.ordered_bits(np.array(kept))
    assert (np.diff(bits) >= 0).all() and [d.from_bits(int(b)) for b in bits] == kept


def test_pick_several_agrees_with_single_picks(skewed):
    sets = {"a": {"hot": 3, "cold": 1}, "b": {"hot": 40, "cold": 10_000}, "c": {}}
    mixed = d.mix(F.col("id"))
    for held in (1, 50_000):
        found = {r["id"]: r for r in d.pick_several(skewed, "g", sets, mixed, ["id"], rows_in_bucket=held).collect()}
        for name, quotas in sets.items():
            assert {i for i, r in found.items() if r[name]} == {r["id"] for r in d.pick_lowest(skewed, "g", quotas, mixed, ["id"]).where("picked").collect()}
