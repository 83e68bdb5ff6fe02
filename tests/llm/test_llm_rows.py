"""Sharding, mixing and address filters."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from flowguard.llm import mixing, sharding, urls


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(cap * sizes[s] for s in capped)
        target = {s: left * weight[s] / max(1, sum(weight[f] for f in free)) for s in free} | {s: float(cap * sizes[s]) for s in capped}
        above = {s for s in free if target[s] > cap * sizes[s]}
        if not above:
            return target
        capped |= above


SOURCES = [
    {"a": 1000, "b": 50, "c": 3, "é": 700, None: 20},
    {"z": 10},
    {"b": 0, "a": 0},
    {f"s{i}": (i * 37) % 101 + 1 for i in range(40)},
    {"a": 100000, "b": 1, "c": 1, "d": 1, "e": 1},
]


@pytest.mark.parametrize("sizes", SOURCES)
def test_targets_equal_repeated_sharing(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {None if r.key == "n" else r.key[1:]: r.target for r in mixing.targets(rows).collect()}
    want = brute_targets(sizes)
    assert set(found) == set(want)
    for s in want:
        assert found[s] == pytest.approx(want[s], rel=1e-12, abs=1e-9)


def mixed(spark, rows, **options):
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return mixing.mix(frame, **options).collect()


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_mix_meets_its_targets_and_caps(spark, fan):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", (i * i) % 97 + 1) for i in range(900)] + [(None, None, 5), (None, None, 5), (7, "s0", None), (8, "hot", 0)]
    found = mixed(spark, rows, fan=fan)
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter(rows)
    taken, target, largest = Counter(), {}, defaultdict(int)
    for r in found:
        size = r.size or 0
        taken[r.source] += size * r.copies
        target[r.source], largest[r.source] = r.target, max(largest[r.source], size)
        assert 0 <= r.copies <= 3
        assert r.copies in (int(r.target / r.source_size), int(r.target / r.source_size) + 1)
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s] / 2 + 1e-6
    assert sorted(map(str, found)) == sorted(map(str, mixed(spark, rows, fan=fan)))


def test_extra_copies_follow_the_open_shares(spark):
    """Over many seeds every row is taken about as often as its source's rate says, whatever its size."""
    rows = [(i, "ab"[i % 2], 10 + i) for i in range(40)]
    total, rate = Counter(), {}
    for seed in range(40):
        for r in mixed(spark, rows, seed=seed, fan=8):
            total[r.doc_id] += r.copies
            rate[r.doc_id] = r.target / r.source_size
    assert sum(abs(total[i] / 40 - rate[i]) for i in total) / 40 < 0.12


def test_mix_of_nothing_and_clashing_columns(spark):
    assert mixed(spark, []) == []
    frame = spark.createDataFrame([(1, "a", 5, 9, "k", 1.0)], "doc_id long, source string, size long, copies int, key string, target double")
    row = mixing.mix(frame).first()
    assert (row.copies, row.key, row.target, row.source_size) == (1, "k", 5.0, 5)


def sharded(spark, rows, shards, **options):
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return sharding.assign_shards(frame, shards, **options)


@pytest.mark.parametrize("shards", [1, 5, 24])
def test_shards_are_even_gapless_and_mixed(spark, shards):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", i) for i in range(997)] + [(None, None, 1), (None, None, 1), (3, "hot", 3)]
    found = sharded(spark, rows, shards).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter(rows)
    slots, mixture = defaultdict(list), defaultdict(Counter)
    for r in found:
        slots[r.shard].append(r.slot)
        mixture[r.shard][r.source] += 1
    assert sorted(slots) == list(range(shards))
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    n = Counter(r[1] for r in rows)
    for shard in mixture.values():
        for source, whole in n.items():
            assert abs(shard[source] - whole / shards) <= 2


def test_slices_do_not_change_shards(spark):
    rows = [(i, f"s{i % 4 // 2}", i) for i in range(300)]
    found = [sorted(sharded(spark, rows, 7, slices=k).collect()) for k in (1, 3, 4096)]
    assert found[0] == found[1] == found[2]


def test_shards_of_nothing_and_clashing_columns(spark):
    assert sharded(spark, [], 3).collect() == []
    frame = spark.createDataFrame([(1, "a", 9, 8, "o", 7)], "doc_id long, source string, shard int, slot int, order string, n int")
    row = sharding.assign_shards(frame, 2).first()
    assert (row.shard, row.slot, row.order, row.n) == (0, 0, "o", 7)
    with pytest.raises(ValueError):
        sharding.assign_shards(frame, 0)


URLS = [
    ("http://WWW.Example.ORG/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/en/12#f", "example.org", "/en/12", "example.org/en/1", "block"),
    ("https://a.org/en/1", "a.org", "/en/1", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("ftp://x.com/fr/a://b", "x.com", "/fr/a://b", "com/fr/", "allow"),
    ("x.com/de/", "", "", None, "allow"),
    ("://com/de/", "com", "/de/", "com/de/", "block"),
    ("http://b.org", "b.org", "", None, "allow"),
    ("http://b.org?/", "b.org", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://a\nb.org/x\ny", "a\nb.org", "/x\ny", "org/", "allow"),
]


def test_rules_fit_hosts_and_paths(spark):
    frame = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_pages(frame).collect()}
    assert found == {i: u[1:] for i, u in enumerate(URLS)}


def test_reputation_blocks_hosts_with_blocked_pages(spark):
    rows = [(i, f"http://bad.shop.com/de/{i}") for i in range(60)] + [(100 + i, f"http://good.com/fr/{i}") for i in range(60)]
    rows += [(200, "http://bad.shop.com/en/"), (201, "http://good.com/en/"), (202, "http://other.com/en/"), (203, "http://x.net/"), (203, "http://x.net/")]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    found = {r.page_id: r.verdict for r in urls.judge_pages(frame).where("page_id >= 200").collect()}
    assert found == {200: "block", 201: "allow", 202: "allow", 203: "allow"}
    known = {r.host: (r.mean, r.low) for r in urls.reputations(_outcomes(frame)).collect()}
    assert known["bad.shop.com"][1] > 0.5 > known["other.com"][1]
    assert known["good.com"][0] < known["x.net"][0] < known["bad.shop.com"][0]


def _outcomes(frame):
    host, path = urls.host_and_path(F.col("url"))
    suffix, domain = urls.suffix_and_domain(host)
    return frame.select(host.alias("host"), suffix.alias("suffix"), domain.alias("domain"), urls.best_rule(host, path)[1].alias("verdict"))


def test_registered_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.co.uk", "x.y.com", "com", "", "localhost"]
    frame = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix, domain = urls.suffix_and_domain(F.col("host"))
    assert [tuple(r) for r in frame.select(suffix, domain).collect()] == [
        ("co.uk", "b.co.uk"), ("co.uk", "co.uk"), ("co.uk", "b.co.uk"), ("com", "y.com"), ("com", "com"), ("", ""), ("localhost", "localhost")]


def test_addresses_of_nothing_and_clashing_columns(spark):
    assert urls.judge_pages(spark.createDataFrame([], "page_id long, url string")).collect() == []
    row = urls.judge_pages(spark.createDataFrame([("http://a.org/", 1, 2, "v", 3)], "url string, host int, n int, verdict string, mean int")).first()
    assert (row.host, row.n, row.verdict, row.mean) == ("a.org", 2, "allow", 3)
