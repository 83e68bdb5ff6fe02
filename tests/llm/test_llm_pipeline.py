"""The pipeline's stages against brute force, each on what the stage before it kept."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from flowguard.llm import decontaminate, quality, simhash


@pytest.fixture(scope="module")
def steps(spark, folder):
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        found.append((docs, docs := stage(spark, docs, folder).cache()))
    return found


def ids(frame):
    return Counter(r[0] for r in frame.select("doc_id").collect())


def test_stages_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns
    assert steps[-1][1].columns == [*steps[-1][0].columns, "shard", "slot"]


def test_quality_stage(spark, folder, steps):
    before, after = steps[0]
    model = quality.train(before.select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet"))
    rows = before.collect()
    want = {r.doc_id for r in rows if not quality.base_failed(*[quality.measure(r.text)[i] for i in (0, 4)]) and model.good(r.text) >= quality.LEAST_GOOD}
    assert ids(after) == Counter(want)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    clean = [r.doc_id for r in rows if labels.get(r.doc_id) == 1 and not quality.base_failed(*[quality.measure(r.text)[i] for i in (0, 4)])]
    assert len(set(clean) - want) <= len(clean) / 50


def test_near_duplicate_stage(steps):
    before, after = steps[1]
    rows = sorted((r.doc_id, simhash.fingerprint(r.text)) for r in before.collect())
    kept = []
    parent = {i: i for i, _ in rows}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if (a ^ b).bit_count() <= 2:
                x, y = top(i), top(j)
                parent[max(x, y)] = min(x, y)
    kept = {i for i in parent if top(i) == i}
    assert ids(after) == Counter(kept)


def test_benchmark_stage(spark, folder, steps):
    before, after = steps[2]
    phrases = decontaminate.phrases_of([(str(r.item_id), r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()])
    windows = {" ".join(str(c) for c in w) for group in phrases.windows for w in group}
    want = Counter()
    for r in before.collect():
        words = decontaminate.words_of(r.text)
        codes = [str(phrases.codes.get(w, 0)) for w in words]
        hit = {j for n in {g.shape[1] for g in phrases.windows} for i in range(len(words) - n + 1) if " ".join(codes[i:i + n]) in windows for j in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(words)):
            want[r.doc_id] += 1
    assert ids(after) == want


def test_mixing_stage(steps):
    before, after = steps[3]
    counts = ids(after)
    assert set(counts) <= set(ids(before)) and max(counts.values()) <= 3
    words = F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("w")
    have = {r.source: r.w for r in before.groupBy("source").agg(words).collect()}
    took = {r.source: r.w for r in after.groupBy("source").agg(words).collect()}
    largest = {r.source: r.w for r in before.groupBy("source").agg(F.max(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("w")).collect()}
    from test_llm_rows import brute_targets
    for source, target in brute_targets(have).items():
        assert abs(took.get(source, 0) - target) <= largest[source] / 2 + 1e-6
    assert {(r.doc_id, r.text, r.source) for r in after.collect()} <= {(r.doc_id, r.text, r.source) for r in before.collect()}


def test_sharding_stage(steps):
    before, after = steps[4]
    rows = after.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in before.collect())
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and all(r.slot < sizes[r.shard] for r in rows)


def test_run_is_repeatable(spark, folder, steps):
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.shard, r.slot) for r in again.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in steps[-1][1].collect())


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    body = " ".join(f"w{i}" for i in range(40))
    rows = [(1, body, "en", "a", 5, "s"), (1, body, "en", "a", 5, "s"), (None, body + " x", None, None, None, None), (2, None, None, "b", 0, ""),
            (3, "", "en", "b", 0, ""), (4, "w " * 50_000, "en", "a", 1, ""), (5, body[::-1], "de", None, 1, "t")]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long, shard string")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        found = docs.collect()
        assert (not given and not found) or {r.doc_id for r in found} <= {1, None, 5}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]


def test_ten_operators_and_the_pipeline_are_registered():
    names = list(entry.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11))
