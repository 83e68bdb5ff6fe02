"""Calibration and rejection of languages on the given documents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.llm import hashed, language

PROBES = ["\u042d\u0442\u043e \u043f\u0440\u043e\u0441\u0442\u043e\u0435 \u043f\u0440\u0435\u0434\u043b\u043e\u0436\u0435\u043d\u0438\u0435 \u043d\u0430 \u0440\u0443\u0441\u0441\u043a\u043e\u043c \u044f\u0437\u044b\u043a\u0435.",
          "\u8fd9\u662f\u4e00\u4e2a\u7b80\u5355\u7684\u4e2d\u6587\u53e5\u5b50\u3002", "T\u00e4m\u00e4 on yksinkertainen suomenkielinen lause, jossa on monta sanaa."]


@pytest.fixture(scope="module")
def rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    learned = docs.where((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    return docs, learned


@pytest.fixture(scope="module")
def sample(rows):
    found = hashed.collect_features(rows[1], "text", ["doc_id", "lang"], language._groups, 1 << language.BITS)
    return hashed.as_arrays(found), found.column("lang").to_pylist()


def test_same_model_in_any_row_order_and_temperature_inside_its_grid(sample):
    features, labels = sample
    first = language.fit(features, labels, epochs=3)
    order = np.random.default_rng(1).permutation(len(labels))
    again = language.fit([features[i] for i in order], [labels[i] for i in order], epochs=3)
    assert (first.table == again.table).all() and (first.temperature, first.least) == (again.temperature, again.least)
    assert 1 < first.temperature < 1000 and 0 < first.least < 1


def test_held_out_answers_are_right_calibrated_and_strangers_are_rejected(spark, rows):
    docs, _ = rows
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.train(docs.where(~held))
    found = language.identify(docs.where(held), model, carry=("doc_id", "lang")).where("lang IS NOT NULL AND lang_pred <> 'und'").toPandas()
    right = (found["lang"] == found["lang_pred"]).to_numpy()
    score = found["score"].to_numpy()
    assert right.mean() > 0.97 and found["accepted"].mean() > 0.8 and right[found["accepted"]].mean() > 0.98
    bins = np.minimum((score * 10).astype(int), 9)
    error = sum(abs(right[bins == b].mean() - score[bins == b].mean()) * (bins == b).mean() for b in range(10) if (bins == b).any())
    print("accuracy", right.mean(), "accepted", found["accepted"].mean(), "calibration error", error, "temperature", model.temperature, "least", model.least)
    assert error < 0.1
    for text in PROBES:
        assert not model.predict(text)[2], text


def test_few_rows_and_languages():
    one = [(np.array([1, 2], np.int32), np.array([0.5, 0.5], np.float32))]
    assert language.fit([], []).labels == []
    assert language.fit(one, ["en"]).labels == ["en"]
    two = language.fit(one * 6 + [(np.array([7], np.int32), np.array([1.0], np.float32))] * 6, ["en"] * 6 + ["de"] * 6)
    assert two.labels == ["de", "en"] and two.temperature >= 1
