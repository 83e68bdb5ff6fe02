"""Columns of any name, many equal rows and missing identities, for the operators that keep whole rows."""

from collections import Counter

import pytest

from flowguard.llm import common, mixing, paragraphs, sharding, simhash, urls, wrappers

ODD = ["a.b", "__id", "__digest", "__hash", "__terms", "row", "hash", "order", "key", "unit", "c0", "tick`ed", "copies_", "stratum"]
LONG = "one two three four five six seven eight nine ten. "
ROWS = [(i if i % 3 else None, "text " * (i % 4) + LONG + f"mail{i}@example.org", "hot" if i % 2 else None, f"http://h{i % 2}.example.com/{i}", "<p>" + "word " * 30 + "</p>") for i in range(24)]


@pytest.fixture(scope="module")
def docs(spark):
    schema = "doc_id long, text string, source string, url string, html string, size long, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in ODD)
    return spark.createDataFrame([(*r, len(r[1]), *range(len(ODD))) for r in ROWS + ROWS[:6]], schema)


@pytest.mark.parametrize("name, run", [
    ("shards", lambda d: sharding.assign_shards(d, 3)), ("mix", lambda d: mixing.mix(d)), ("urls", lambda d: urls.judge_pages(d)), ("pages", lambda d: wrappers.extract_pages(d.drop("text"))),
    ("passages", lambda d: paragraphs.remove_repeats(d)), ("near", lambda d: simhash.one_of_each(d))])
def test_any_column_names(docs, name, run):
    found = run(docs)
    assert set(ODD) <= set(found.columns) and len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    assert len(rows) == len(ROWS) + 6 or name == "near"
    for r in rows:
        assert [r[n] for n in ODD] == list(range(len(ODD)))
    assert run(docs.limit(0)).columns == found.columns and run(docs.limit(0)).collect() == []


def test_equal_rows_are_numbered_and_spread(spark):
    rows = [(None, "s", 5)] * 9000 + [(1, "s", 5)] * 3 + [(2, None, None)]
    found = common.copies(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(3), "copy", lot=1000).collect()
    assert Counter(tuple(r)[:3] for r in found) == Counter(rows)
    assert sorted(r.copy for r in found if r.doc_id is None) == list(range(9000))


@pytest.mark.parametrize("per_task", [50, 1_000_000])
def test_a_third_without_identity_in_shards_and_mix(spark, per_task):
    rows = [(None if i % 3 == 0 else i, "hot" if i % 5 else f"s{i % 4}", 7 if i % 2 else i % 50 + 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    placed = sharding.assign_shards(df, 7, rows_per_task=per_task).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in placed) == Counter(rows)
    sizes = Counter(r.shard for r in placed)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in placed if r.shard == s) == list(range(n)) for s, n in sizes.items())
    hot = Counter(r.shard for r in placed if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= len({r.source for r in placed})  # rounding at the two ends of a shard
    again = sharding.assign_shards(df.repartition(9), 7, rows_per_task=per_task).collect()
    assert sorted(map(str, again)) == sorted(map(str, placed))
    mixed = mixing.mix(df)
    assert Counter((r.doc_id, r.source, r.size) for r in mixed.collect()) == Counter(rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))


def test_the_row_that_stays_is_the_same_in_any_order(spark):
    rows = [(1, LONG, "b"), (1, LONG, "a"), (2, LONG, "c"), (None, "other " * 9, "y"), (None, "other " * 9, "x")]
    for _ in range(2):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        assert sorted((r.doc_id or 0, r.source) for r in simhash.one_of_each(df).collect()) == [(0, "x"), (1, "a")]
        rows = rows[::-1]
