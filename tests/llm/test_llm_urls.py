"""The whole address query against its SQL, on pages of many suffixes where the posterior blocks."""

import random

import duckdb

from flowguard.llm import oracle, queries


def test_posterior_blocks_and_allows_as_the_sql_does(spark, tmp_path):
    rng = random.Random(3)
    urls = []
    for i in range(40):  # hosts below .com whose judged pages are mostly blocked, or mostly allowed
        host = f"h{i % 8}.{'bad' if i % 2 else 'good'}.com"
        urls += [f"https://{host}/{'de' if i % 2 else 'fr'}/{i}", f"http://{host.upper()}/other/{i}", f"http://{host}"]
    for suffix in ("co.uk", "com.au", "de", "github.io", "uk"):
        urls += [f"http://{'www.' * rng.randint(0, 2)}site{i}.{suffix}/en/{i}?q#f" for i in range(6)] + [f"http://{suffix}/", f"http://a.example.org.{suffix}/es/"]
    urls += [f"http://x{i}.example.org/{'es' if i % 3 else 'en'}/{i}" for i in range(30)] + [None, "", "no scheme", "a://b://c/d", "://", "http:///path"]
    folder = str(tmp_path)
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{folder}/pages.parquet")
    found = sorted(map(str, (tuple(r) for r in queries.op5_urls(spark, folder).select("page_id", "host", "path", "rule", "verdict").collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    assert found == sorted(map(str, con.sql(f"SELECT page_id, host, path, rule, verdict FROM ({oracle.SQL['op5_urls']})").fetchall()))
    free = [r for r in queries.op5_urls(spark, folder).collect() if r.rule is None]
    assert {r.verdict for r in free} == {"allow", "block"}
    assert {r.verdict for r in free if ".bad.com" in r.host} == {"block"} and {r.verdict for r in free if ".good.com" in r.host} == {"allow"}
