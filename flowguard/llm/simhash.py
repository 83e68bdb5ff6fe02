"""SimHash near-duplicates, linked through deletion-variant signatures of fingerprint segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import carried, plain_names
from flowguard.llm.components import components
from flowguard.session import cut_lineage

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Members of a bucket that are compared by an equality join; the members of larger buckets are indexed again.
BUCKET = 24
#: Fingerprints whose variants one task makes.
NODES_PER_TASK = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is set in over half of the XXH64 hashes of the text's shingles; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        runs = words
    else:
        runs = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    hashes = np.fromiter((xxhash.xxh64_intdigest(r, SEED) for r in runs), np.uint64)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i:i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), shingle: int = SHINGLE) -> DataFrame:
    """`carry` columns and `fp` (64 bits as a signed integer) of every whole text."""
    rows, at, kept, kinds = carried(docs, text, carry, ["fp"])
    schema, names = ", ".join([*kinds, "fp bigint"]), [*kept, "fp"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), pa.array(found)], names=names)
    return rows.mapInArrow(mark, schema)


def links(marks: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (`u`, `v`) that connect the distinct fingerprints (`fp`) of `marks` exactly as all pairs within two bits do.

    Two fingerprints within two bits agree, in one of their two 32-bit segments, in all but at most one bit. So each
    fingerprint is indexed under 64 variants, a segment with one bit left out, and members of a variant are joined and
    verified. A variant with more than `bucket` members would need all pairs of a crowd; its members are indexed again,
    under themselves and the 64 fingerprints one bit away: two of them share such a point if and only if they differ in
    at most two bits, and a point has at most 65 members, which are linked to the smallest. Nothing is left out.
    """
    nodes = cut_lineage(marks.select("fp").distinct())
    # The few bytes of a node become 64 keys, so the nodes are dealt by their count and not by their bytes.
    tasks = max(int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() // NODES_PER_TASK)
    keys = nodes.repartition(tasks, "fp").select("fp", F.expr(
        "explode(transform(sequence(0, 63), j -> shiftleft(cast(j as bigint), 32)"
        " | (shiftrightunsigned(fp, if(j < 32, 0, 32)) & 4294967295L & ~shiftleft(1L, j % 32)))) as key"))
    sizes = cut_lineage(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1"))
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS
    pairs = sizes.where("n = 2").select("u", "v").where(near)
    members = cut_lineage(keys.join(sizes.where("n > 2").select("key", "n"), "key"))
    few = members.where(F.col("n") <= bucket)
    joined = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key").where("u < v").where(near).select("u", "v")
    crowd = members.where(F.col("n") > bucket).select("fp").distinct()
    points = crowd.select("fp", F.expr("explode(concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))) as point"))
    shared = points.groupBy("point").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    stars = shared.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v")
    return pairs.unionByName(joined).unionByName(stars)


def group(docs: DataFrame, text: str = "text", identity: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """`identity`, `digest` of the text, `fp`, `root` (one per group) and `component_id` (smallest identity of the group) of every row.

    Groups are the connected components of the links; equal fingerprints are one node, so thousands of copies cost one.
    Null and wordless texts have fingerprint zero and are linked like any other. A null identity takes part in links but
    is never the smallest; a group of nulls has a null component. Empty tables give empty results.
    """
    rows = docs.select(F.col(identity), F.col(text), F.xxhash64(F.col(text)).alias("digest"))
    marks = cut_lineage(fingerprints(rows, text, (identity, "digest"), shingle))
    found = components(links(marks))
    firsts = marks.groupBy("fp").agg(F.min(identity).alias("first"))
    rooted = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marks.join(rooted.select("fp", "root").join(named, "root"), "fp").select(identity, "digest", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", identity: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """The row with the smallest identity of every group (null last, then by the text's hash), all columns kept.

    Of rows that agree in identity and text but differ elsewhere the least by their other columns stays, so a rerun
    chooses alike; of equal rows one stays. Columns of any name are kept; an empty table gives an empty result.
    """
    rows, names, of = plain_names(docs, [])
    key, body = of[identity], of[text]
    groups = group(rows.select(key, body), body, key, shingle)
    stays = groups.groupBy("root").agg(F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("digest"))).alias("s"))
    kept = stays.select(F.col("s.id").alias("id"), F.col("s.digest").alias("digest"))
    hashed = rows.withColumn("hash", F.xxhash64(F.col(body)))
    met = hashed.join(kept, F.col(key).eqNullSafe(F.col("id")) & (F.col("hash") == F.col("digest")), "left_semi")
    sortable = [c for c, f in zip(rows.columns, rows.schema.fields) if c != body and "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    one = met.groupBy(key, "hash").agg(F.min_by(F.struct(*rows.columns), F.struct(*sortable)).alias("row"))
    return one.select("row.*").toDF(*names)
