"""Archives: what is written is read back, whatever the byte ranges and whatever the members hold."""

import gzip
import hashlib
import os
import random
import zlib
from base64 import b32encode

import pytest

from flowguard.llm import queries, warc

SCHEMA = "page_id long, url string, html string, digest string, kind string, `n.x` int, row int"
LONG = "naïve é<p>" * 3000


def planned(spark, rows, **options):
    return warc.plan_records(spark.createDataFrame([(*r, "d", "k", 1, 2) for r in rows], SCHEMA).repartition(3), **options)


def brute(rows, least=0):
    groups = {}
    for page, url, html in rows:
        groups.setdefault(html or "", []).append((page is None, page or 0, url is None, url or "", page))
    out = []
    for html, members in groups.items():
        body = html.encode()
        digest = b32encode(hashlib.sha1(body).digest()).decode()
        for i, m in enumerate(sorted(members)):
            again = i > 0 and len(body) >= least
            out.append((m[4], len(body), digest, "revisit" if again else "response", min(members)[4] if again else None))
    return sorted(out, key=str)


def seen(frame):
    rows = [(r.identity, r.payload_bytes, r.payload_digest, r.kind, r.refers_to) for r in frame.collect()]
    number = lambda t: int(t) if t else None
    return sorted([(number(i), n, d, k, number(f.split(":")[2]) if f else None) for i, n, d, k, f in rows], key=str)


ROWS = [(i, f"http://h/{i}", ["", None, "same", LONG, f"own {i}"][i % 5]) for i in range(60)]
ROWS += [(None, None, "same"), (None, None, "none"), (None, "u", "none"), (3, "http://h/3", "x"), (3, "http://h/3", "x"), (3, "a", "x"), (5, "evil\r\nWARC-Type: x", "y")]
ROWS += [(700, None, "crowd")] * 900 + [(701, None, "crowd")] * 9 + [(None, None, None)] * 40


@pytest.mark.parametrize("least", [0, 5])
def test_archives_give_back_every_page(spark, tmp_path, monkeypatch, least):
    monkeypatch.setattr(warc, "COPIES", 64)
    folder = str(tmp_path / "a")
    warc.write_archives(planned(spark, ROWS, least=least), folder)
    found = warc.read_archives(spark, folder)
    assert seen(found) == brute(ROWS, least)
    whole = found.where("kind = 'response'").collect()
    assert all(r.sound and len(r.payload) == r.payload_bytes for r in whole)
    assert {r.payload.decode() for r in whole} == {h or "" for _, _, h in ROWS}
    assert {r.uri for r in whole} >= {None, "http://h/3", "evil%0D%0AWARC-Type: x"}
    for name in os.listdir(folder):
        if name.startswith("part-"):  # any gzip reader takes the files
            assert gzip.decompress((tmp_path / "a" / name).read_bytes()).count(b"WARC/1.1\r\n") >= 0


def test_large_members_keep_a_zero_end():
    for content in (b"", b"x" * 10, os.urandom(1 << 20), b"a" * ((1 << 24) + 5)):
        packed = warc.member(content) + b"\0"
        assert gzip.decompress(packed) == content
        for part in (packed[-5:],):
            assert part[-1] == 0


def records(draw, count):
    """Members whose stored (uncompressed) blocks carry magic, broken headers and whole other records."""
    nested = gzip.compress(warc.record("response", "page:n:x", "999", None, "d", b"n", 1, warc.payload_digest(b"n")))
    out = []
    for i in range(count):
        payload = b"".join(draw.choice([b"text ", warc.MAGIC, warc.MAGIC + b"\x00" * 9, nested, bytes(draw.randrange(256) for _ in range(draw.randrange(40)))])
                           for _ in range(draw.randrange(12)))
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        content = warc.record("response", f"page:{i}:x", str(i), None, "d", payload, len(payload), warc.payload_digest(payload))
        out.append((str(i), payload, packer.compress(content) + packer.flush()))
    return out


@pytest.mark.parametrize("width", [37, 64, 101, 500, 4096])
def test_any_byte_ranges_and_magic_inside_members(spark, tmp_path, width):
    draw = random.Random(width)
    want = []
    for number in range(3):
        made = records(draw, 25)
        (tmp_path / f"a{number}.warc").write_bytes(b"".join(m for _, _, m in made) + b"\0" * (number * 5))
        want += [(i, p) for i, p, _ in made]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(width))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = warc.read_archives(spark, str(tmp_path)).coalesce(4).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted((r.identity, bytes(r.payload)) for r in found) == sorted(want)
    assert all(r.sound for r in found)


def test_damaged_members_are_told(spark, tmp_path):
    made = [warc.member(warc.record("response", f"page:{i}:x", str(i), "u", "d", b"p" * 500, 500, warc.payload_digest(b"p" * 500))) + b"\0" for i in range(4)]
    broken = bytearray(made[1])
    broken[-6] ^= 255
    (tmp_path / "a.warc").write_bytes(made[0] + bytes(broken) + made[2] + made[3][:-20])
    wrong = warc.member(warc.record("response", "page:9:x", "9", "u", "d", b"p", 1, "AAAA")) + b"\0"
    (tmp_path / "b.warc").write_bytes(wrong + gzip.compress(b"no record"))
    (tmp_path / "c.warc").write_bytes(b"")
    found = warc.read_archives(spark, str(tmp_path)).collect()
    assert sorted(r.identity for r in found if r.sound) == ["0", "2"]
    assert sum(not r.sound for r in found) >= 3 and [r.identity for r in found if not r.sound and r.identity] == ["9"]


def test_empty_table(spark, tmp_path):
    folder = str(tmp_path / "a")
    warc.write_archives(planned(spark, []), folder)
    assert warc.read_archives(spark, folder).collect() == []


def test_query_reads_every_page(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted([tuple(r) for r in queries.op13_warc(spark, folder).collect()], key=str) == brute(rows)
