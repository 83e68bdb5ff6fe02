"""Removal of repeated text by line hashing: lines, long ones cut where their own words say, are hashed and all but the earliest cut out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowguard.llm.common import key_of, plain_names, small_join
from flowguard.llm.passages import _letters, _mixed, _span_hashes, without, words_of
from flowguard.session import cut_lineage

#: A line is cut before a word whose hash is the least among so many words on either side, so a cut depends on these only.
REACH = 3
MOST_WORDS = 16
#: Repeats go where they fill a line of so many words, or where so many words of them follow each other.
LINE_WORDS, RUN_WORDS = 8, 16
OTHER = np.uint64(0xD6E8FEB86659FD93)


def cuts(hashes: np.ndarray, line: np.ndarray) -> np.ndarray:
    """First words of the units of a text, given the hash and the line of each of its words."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    pair = _mixed(hashes ^ np.roll(hashes, -1) * OTHER)
    pair[-1] = _mixed(hashes[-1:])[0]
    least = np.ones(n, bool)
    for off in range(1, REACH + 1):
        least[off:] &= pair[off:] < pair[:-off]
        least[:-off] &= pair[:-off] <= pair[off:]
    least[:REACH] = False  # fewer words on one side say less
    first = np.flatnonzero(least | np.append(True, line[1:] != line[:-1]))
    ends = np.append(first[1:], n)
    long = np.flatnonzero(ends - first > MOST_WORDS)  # words that repeat have no least one: cut by count from the last cut
    return np.sort(np.concatenate([first, *[np.arange(first[i] + MOST_WORDS, ends[i], MOST_WORDS) for i in long]]))


class Units:
    """Units of a text: their spans in words and code points, their lines and 128-bit digests."""

    def __init__(self, text: str):
        self.starts, self.ends, hashes, self.codes = words_of(text)
        newline = np.concatenate([[0], np.cumsum(self.codes == 10)])
        lines = newline[self.starts] if len(self.starts) else np.zeros(0, np.int64)
        self.first = cuts(hashes, lines)
        self.last = np.append(self.first[1:], len(hashes))[:len(self.first)]
        self.line = lines[self.first]
        self.low = _span_hashes(hashes, self.first, self.last).view(np.int64)
        self.high = _span_hashes(_mixed(hashes + OTHER), self.first, self.last).view(np.int64)

    def __len__(self) -> int:
        return len(self.first)

    def removals(self, repeated: np.ndarray, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
        """Spans (code points, end exclusive) to cut, given which units occur earlier; punctuation goes with the word before it."""
        words = self.last - self.first
        cut = np.zeros(len(self), bool)
        for group, least in ((self.line, line_words), (np.cumsum(~repeated), run_words)):
            if len(group):
                kept = np.bincount(group, np.where(repeated, 0, words), group.max() + 1) if group is self.line else np.zeros(group.max() + 1)
                mass = np.bincount(group, np.where(repeated, words, 0), group.max() + 1)
                cut |= repeated & (kept[group] == 0) & (mass[group] >= least)
        word, space, _ = _letters()
        spans: list[tuple[int, int]] = []
        before = -2
        for i in np.flatnonzero(cut).tolist():
            end = int(self.ends[self.last[i] - 1])
            while end < len(self.codes) and not word[self.codes[end]] and not space[self.codes[end]]:
                end += 1
            if i == before + 1:
                spans[-1] = (spans[-1][0], end)
            else:
                spans.append((int(self.starts[self.first[i]]), end))
            before = i
        return spans


def _digests(docs: DataFrame) -> DataFrame:
    """`low`, `high`, `id`, `body` and `unit` of every unit of `docs` (`id`, `body`, `text`)."""
    kind = docs.schema["id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Units(t) for t in batch.column(2).to_pylist()]
            sizes = np.array([len(u) for u in found], np.int64)
            at = pa.array(np.repeat(np.arange(len(found)), sizes))
            parts = [np.concatenate([x, *y]) for x, y in ((np.zeros(0, np.int64), [u.low for u in found]), (np.zeros(0, np.int64), [u.high for u in found]),
                                                          (np.zeros(0, np.int64), [np.arange(n) for n in sizes]))]
            yield pa.RecordBatch.from_arrays([pa.array(parts[0]), pa.array(parts[1]), batch.column(0).take(at), batch.column(1).take(at), pa.array(parts[2].astype(np.int32))],
                                             names=["low", "high", "id", "body", "unit"])
    return docs.mapInArrow(digest, f"low bigint, high bigint, id {kind}, body bigint, unit int")


def remove_repeats(docs: DataFrame, text: str = "text", identity: str = "doc_id", line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """Every row of `docs` with its text cut, and `n_units`, `n_repeated`, `n_removed_chars` and `removed` (spans in the original text).

    Units are normalised lines (words in lower case), and long lines are cut into paragraphs of some seven words where the
    words themselves say so, wherever they stand. Digests of 128 bits are grouped over all documents; units are ranked by
    identity (nulls last), then by place, and all occurrences but the earliest are repeats. Repeats are cut where they
    fill a line of `line_words` words or where `run_words` words of them follow each other; what two writers share by
    chance is shorter. A passage that is shared from the middle of a sentence loses all units that lie inside it.

    A digest is first reduced to its count and earliest place, so a line that a third of all documents share is one row
    before anything is joined; only repeated digests are joined back, by a join whose hot keys Spark splits. Null texts
    stay null and have no units. Rows that agree in identity and text are one document. Empty tables give empty results.
    Columns of the added names are replaced; any other names are kept, dots included.
    """
    made = ["n_units", "n_repeated", "n_removed_chars", "removed"]
    plain, own, of = plain_names(docs, made)
    kept, at, key = plain.columns, own.index(text), of[identity]
    rows = plain.withColumn("hash", F.xxhash64(f"c{at}")).withColumn("name", key_of(F.col(key)))
    # Texts are told apart by their hash only under identities that have several, so that it costs no room in the others' units.
    several = rows.where(f"c{at} is not null").groupBy("name").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("name", F.lit(True).alias("several"))
    body = F.when(F.col("several"), F.col("hash")).otherwise(0).cast("bigint")
    rows = small_join(rows, several, ["name"], ["hash"]).withColumn("hash", F.when(F.col(f"c{at}").isNotNull(), body)).drop("name", "several")
    found = _digests(rows.select(F.col(key).alias("id"), F.col("hash").alias("body"), F.col(f"c{at}").alias("text")).where("text is not null"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "body", "unit")
    # Written, so that both sides of the join are plain exchanges, which Spark can split where a digest is hot.
    firsts = cut_lineage(found.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n"))
    later = found.join(firsts, ["low", "high"]).where(~place.eqNullSafe(F.col("first")))
    marked = later.groupBy("id", "body").agg(F.collect_set("unit").alias("units"))
    joined = rows.join(marked, F.col(key).eqNullSafe(F.col("id")) & (F.col("hash") == F.col("body")), "left").select(*kept, "units")
    schema = ", ".join([f"{c} {f.dataType.simpleString()}" for c, f in zip(kept, plain.schema.fields)]
                       + ["n_units int, n_repeated int, n_removed_chars int, removed array<struct<start:int,end:int>>"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, counts, spans = [], [], []
            for t, marks in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist()):
                units = Units(t or "")
                repeated = np.zeros(len(units), bool)
                repeated[marks or []] = True
                spans.append(units.removals(repeated, line_words, run_words) if marks else [])
                left.append(t if t is None else without(t, spans[-1]))
                counts.append((len(units), len(marks or []), 0 if t is None else len(t) - len(left[-1])))
            columns = [batch.column(i) for i in range(len(kept))]
            columns[at] = pa.array(left, pa.string())
            columns += [pa.array([c[i] for c in counts], pa.int32()) for i in range(3)]
            columns.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])
    return joined.mapInArrow(cut, schema).toDF(*own, *made)
